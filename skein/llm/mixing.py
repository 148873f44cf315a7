"""Mixing sources to target shares of the total size."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

_UNIT = "doc_id bigint, source string, n_tokens bigint, base int, p double"
_COLUMNS = ["doc_id", "source", "n_tokens", "base", "p"]
_EPS = 1e-9
#: Up to so many sources (some MB) what is known of each is broadcast; beyond, it is shuffled.
FEW_SOURCES = 100_000
#: Units of a block and source, of sizes from the largest to the smallest, that stay fractional
#: until the landing: rounding a dozen of mixed sizes together meets the expected size closely.
RESERVE = 12


def flight(units: list[list[float]], rng: random.Random) -> None:
    """Move the inclusion probabilities `units[i] = [p, size]` in the null space of the two
    constraints, sum of p and sum of p * size, until at most two of them are fractional.

    Three fractional units at a time: along the null vector, forwards or backwards with the odds
    that keep every expectation, until one of them reaches 0 or 1 and the next takes its place.
    """
    open_: list[int] = []
    for i, unit in enumerate(units):
        if _EPS < unit[0] < 1 - _EPS:
            open_.append(i)
        else:
            unit[0] = float(round(unit[0]))
        while len(open_) == 3:
            a, b, c = (units[j] for j in open_)
            u = (c[1] - b[1], a[1] - c[1], b[1] - a[1])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            most = [math.inf, math.inf]
            for x, d in zip((a, b, c), u, strict=True):
                if d:
                    up, down = ((1 - x[0]) / d, x[0] / d) if d > 0 else (-x[0] / d, (x[0] - 1) / d)
                    most = [min(most[0], up), min(most[1], down)]
            step = most[0] if rng.random() * (most[0] + most[1]) < most[1] else -most[1]
            for x, d in zip((a, b, c), u, strict=True):
                x[0] += step * d
                if x[0] < _EPS or x[0] > 1 - _EPS:
                    x[0] = float(round(x[0]))
            open_ = [j for j in open_ if _EPS < units[j][0] < 1 - _EPS]


def landing(units: list[list[float]]) -> None:
    """Round what is still fractional, `RESERVE` + 2 units at most: to the choice whose size is
    nearest to the expected one, and of those to the one whose count is."""
    left = [u for u in units if 0 < u[0] < 1]
    if not left:
        return
    p, size = np.array([u[0] for u in left]), np.array([u[1] for u in left])
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs(picks @ size - p @ size)
    near = np.flatnonzero(off <= off.min() + 1e-6)
    best = picks[near[np.argmin(np.abs(picks[near].sum(axis=1) - p.sum()))]]
    for u, x in zip(left, best, strict=True):
        u[0] = float(x)


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """How often each source is taken: shares times the greatest total that lets no source exceed
    its repeats. Sources with a target but no text are left out, and the others keep their shares
    against each other; `shares` reports both."""
    wanted = [(s, share, cap) for s, share, cap in targets if s is not None and share and cap and totals.get(s)]
    if not wanted:
        return {}
    total = min(cap * totals[s] / share for s, share, cap in wanted)
    return {s: min(float(cap), share * total / totals[s]) for s, share, cap in wanted}


def mix(sized: DataFrame, targets: list[tuple[str, float, int]], seed: int = 7, block: int = 100_000) -> DataFrame:
    """The chosen documents of `sized(doc_id, source, n_tokens)` with their `repeats`: each source
    reaches its target share of all tokens, at the greatest total that `max_repeats` allows.

    `targets` lists (source, target_share, max_repeats), one per source; the list is a setting, and
    so is what is kept per source on the driver. Documents of other sources, without a source or
    without tokens are not chosen. Every document of a source is taken floor(r) times, and once
    more by the cube method with probability r - floor(r), balanced on the source's tokens and
    documents. Repeated rows are units of their own. A source without text is left out (see
    `plan`); if no source has text the mix is empty.

    Each partition flies the units it reads, a source's in blocks, whatever share a source has,
    the largest first; two units and `RESERVE` more of mixed sizes stay fractional per source and
    block. In each later round a source's open units meet in as few groups as `block` asks for;
    where one group holds them all they are rounded together, else about a dozen a group go on. So
    a source's open units shrink by a factor of thousands a round, however many sources there are.
    """
    spark = sized.sparkSession
    names = spark.createDataFrame([(s,) for s in dict.fromkeys(s for s, _, _ in targets if s is not None)], "source string")
    known = sized.where(F.col("n_tokens") > 0).join(names, "source", "left_semi").select("doc_id", "source", "n_tokens")
    totals = {r["source"]: r["t"] for r in known.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    rates = plan(totals, targets)
    if not rates:
        return sized.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats")).where(F.lit(False))
    few = F.broadcast if len(rates) <= FEW_SOURCES else (lambda df: df)
    units = known.join(few(spark.createDataFrame([(s, float(r)) for s, r in rates.items()], "source string, r double")), "source").select(
        "doc_id", "source", "n_tokens", F.floor("r").cast("int").alias("base"), (F.col("r") - F.floor("r")).alias("p")
    )

    def fly(salt: int, whole: bool):
        """Fly the units of a source that meet; `whole` takes a task's units at once and lands the
        sources whose units are all there."""

        def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
            t = pd.concat(held).sort_values(["source", "n_tokens", "doc_id"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
            p = t["p"].to_numpy(copy=True)
            sizes, ids = t["n_tokens"].to_numpy(), t["doc_id"].to_numpy()
            for (source, part), rows in t.groupby(["source", "part"] if whole else ["source", "base"]).indices.items():
                work = [[p[i], float(sizes[i])] for i in rows]
                kept = set((np.geomspace(1, len(work), RESERVE) - 1).astype(int).tolist())
                flight([w for i, w in enumerate(work) if i not in kept], random.Random(f"{seed}/{salt}/{source}/{part}/{ids[rows[0]]}"))
                if whole and t["parts"].iat[rows[0]] == 1:
                    landing(work)
                p[rows] = [w[0] for w in work]
            t["p"] = p
            return t[_COLUMNS]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            n = 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= block and not whole:
                    yield flush(held)
                    held, n = [], 0
            if n:
                yield flush(held)

        return run

    done: list[DataFrame] = []
    state, level = materialize(units.mapInPandas(fly(0, False), _UNIT), "units"), 0
    while True:
        done.append(state.where("p = 0 or p = 1"))
        open_ = state.where("p > 0 and p < 1")
        left, level = {r["source"]: r["n"] for r in open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}, level + 1
        if not left:
            break
        parts = spark.createDataFrame([(s, -(-n // block)) for s, n in left.items()], "source string, parts bigint")
        groups = -(-2 * sum(left.values()) // block)
        spread = open_.join(few(parts), "source").withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.col("parts")))
        spread = spread.repartition(groups, "source", "part") if groups > 1 else spread.coalesce(1)
        state = materialize(spread.mapInPandas(fly(level, True), _UNIT), "units")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p")).cast("int").alias("repeats")).where("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of `targets`: target and reached share, tokens, documents, greatest repeats, and the
    tokens of the largest document taken, which is how finely a share can be met."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"), F.max("n_tokens").alias("largest")
    )
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("all_tokens"))
    joined = targets.join(got, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce("largest", F.lit(0)).alias("largest"),
    )
