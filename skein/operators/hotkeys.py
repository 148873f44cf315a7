"""Per-key results when a few keys hold most rows.

`hot_keys` finds the heavy keys, and `key_profile` counts rows and selects exact quantiles for
every key, without ever bringing the rows of one key together. Both refine histograms of mergeable
counts 16 bits at a time, only inside the bins that can still hold what is sought: keys are sought
in bins of their hash, ranks in bins of the values' order, after rows have collapsed to (key,
value) cells with map-side combine. `split_join` joins a skewed side to a unique one by
broadcasting the right rows of the proven few heavy keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize

_DIGIT = 16
_LEVELS = 4


def ordinal(value: Column) -> Column:
    """An order-preserving bigint for a double: the IEEE-754 magnitude bits with the sign applied.

    NaN sorts above infinity, as in Spark; -0.0 equals 0.0; null stays null.
    """
    size = F.abs(value)
    guess = F.least(F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-1022)), F.lit(1023))
    two_to = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = (
        F.when(size < two_to(guess), guess - 1)
        .when((guess < 1023) & (size >= two_to(F.least(guess + 1, F.lit(1023)))), guess + 1)
        .otherwise(guess)
    )
    tiny = size < F.lit(2.0**-1022)
    fraction = (size / two_to(exponent) - 1.0) * F.lit(float(2**52))
    bits = F.when(tiny, (size / F.lit(2.0**-1074)).cast("bigint")).otherwise(
        (exponent + 1023).cast("bigint") * F.lit(2**52) + fraction.cast("bigint")
    )
    return (
        F.when(value.isNull(), F.lit(None).cast("bigint"))
        .when(F.isnan(value), F.lit(2**63 - 1))
        .when(size == F.lit(float("inf")), F.lit(2047 * 2**52) * F.signum(value).cast("bigint"))
        .when(size == 0, F.lit(0).cast("bigint"))
        .otherwise(F.when(value < 0, -bits).otherwise(bits))
    )


def _prefix(ord_col: Column, level: int) -> Column:
    return F.shiftright(ord_col, 64 - _DIGIT * (level + 1))


def key_profile(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | None = None,
    quantiles: dict[str, float] | None = None,
    salts: int = 16,
) -> DataFrame:
    """One row per distinct `keys` of `df`: `n_rows`, `n_values` (non-null), `sum_value`,
    `min_value`, `max_value`, and for each `name: q` of `quantiles` the exact value at rank
    `max(1, ceil(q * n_values))` (nearest rank, from below).

    Null keys form a group of their own; null values count as rows only; a group without values
    has null statistics. NaN is the greatest value, -0.0 equals 0.0; ties need no rule, equal
    values being equal. An empty `df` gives no rows. Columns other than the keys are ignored, so
    they may have any name.

    No task holds more of one key than 65,536 histogram bins: cells are spread by (key, value),
    and each refinement joins cells to (key, bin) under a salt.
    """
    quantiles = quantiles or {}
    names = [f"k{i}" for i in range(len(keys))]
    v = (value if value is not None else F.lit(None)).cast("double")
    v = F.when(v == 0, F.lit(0.0)).otherwise(v)
    cells = (
        df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], v.alias("v"))
        .groupBy(*names, "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    if quantiles:
        cells = materialize(cells, "cells")  # read by the totals and by every level
    totals = cells.groupBy(*names).agg(
        F.sum("c").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("n_values"),
        F.sum(F.col("v") * F.col("c")).alias("sum_value"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
    )
    if quantiles:
        ranks = _select(cells.where("v is not null").withColumn("o", ordinal(F.col("v"))), names, list(quantiles.values()), salts)
        wide = ranks.groupBy(*names).agg(
            *[F.max(F.when(F.col("q") == i, F.col("v"))).alias(n) for i, n in enumerate(quantiles)]
        )
        wide = wide.withColumnsRenamed({n: f"r_{n}" for n in names})
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"r_{n}")) for n in names])
        totals = totals.join(wide, same, "left").drop(*[f"r_{n}" for n in names])
    return totals.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def _select(cells: DataFrame, names: list[str], qs: list[float], salts: int) -> DataFrame:
    """(keys, q, v): the value at each wanted rank, by refining histograms level by level."""
    done: list[DataFrame] = []
    open_: DataFrame | None = None
    for level in range(_LEVELS):
        if open_ is None:
            group = names
            binned = cells
        else:
            group = [*names, "q"]
            wanted = open_.select(
                *[F.col(n).alias(f"w_{n}") for n in names], "q", "rank",
                F.col("bin").alias("w_bin"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("w_salt"),
            )
            on = reduce(
                lambda a, b: a & b,
                [F.col(n).eqNullSafe(F.col(f"w_{n}")) for n in names],
                (_prefix(F.col("o"), level - 1) == F.col("w_bin")) & (F.pmod(F.xxhash64("o"), F.lit(salts)).cast("int") == F.col("w_salt")),
            )
            binned = cells.join(wanted, on).drop("w_bin", "w_salt", *[f"w_{n}" for n in names])
        hist = binned.groupBy(*group, _prefix(F.col("o"), level).alias("bin")).agg(
            F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            *([F.first("rank").alias("rank")] if open_ is not None else []),
        )
        by = Window.partitionBy(*group)
        upto = F.sum("c").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("below", upto - F.col("c"))
        if open_ is None:
            hist = hist.withColumn("n", F.sum("c").over(by))
            rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))).cast("bigint")
            here = F.filter(
                F.array(*[F.struct(F.lit(i).alias("q"), rank(q).alias("rank")) for i, q in enumerate(qs)]),
                lambda t: (t["rank"] > F.col("below")) & (t["rank"] <= F.col("below") + F.col("c")),
            )
            found = hist.withColumn("t", F.explode(here)).select(
                *names, F.col("t.q").alias("q"), (F.col("t.rank") - F.col("below")).alias("rank"), "bin", "lo", "hi"
            )
        else:
            found = hist.where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("c"))).select(
                *names, "q", (F.col("rank") - F.col("below")).alias("rank"), "bin", "lo", "hi"
            )
        found = materialize(found, "ranks")
        resolved = F.col("lo").eqNullSafe(F.col("hi"))
        done.append(found.where(resolved).select(*names, "q", F.col("lo").alias("v")))
        open_ = found.where(~resolved)
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(field, hot_key, n_rows): for each of `keys` the values, as text, that hold at least `share`
    of all rows of `df`; at most 1/share rows a key. Null is no value, but its rows count towards
    all; an empty `df` gives no rows; columns of any name may stand beside the keys.

    Exact, by refining histograms: the rows are counted by the first 16 bits of the value's hash,
    and only bins that hold enough rows are counted again by the next 16, until every bin left
    holds one hash. Last the values within these bins are counted themselves, so values that share
    a hash are told apart. Counts merge before each shuffle, and at most 1/share bins a key, a
    proven bound, are broadcast to the next level.
    """
    one = [F.struct(F.lit(k).alias("field"), F.col(f"`{k}`").cast("string").alias("hot_key")) for k in keys]
    rows = df.select(F.explode(F.array(*one)).alias("x")).select("x.*").withColumn("h", F.when(F.col("hot_key").isNotNull(), F.xxhash64("hot_key")))
    open_, least = None, 1
    for level in range(_LEVELS):
        within = rows if open_ is None else _inside(rows, open_, level - 1)
        hist = within.groupBy("field", _prefix(F.col("h"), level).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        if open_ is None:
            hist = materialize(hist, "bins")
            total = hist.where(F.col("field") == keys[0]).agg(F.sum("c")).first()[0] or 0
            least = max(1, math.ceil(share * total - 1e-6))  # a share that is met exactly counts
        open_ = materialize(hist.where(F.col("bin").isNotNull() & (F.col("c") >= least)).select("field", "bin", (F.col("lo") == F.col("hi")).alias("one")), "bins")
        if open_.where("not one").isEmpty():
            break
    return _inside(rows, open_, level).groupBy("field", "hot_key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def _inside(rows: DataFrame, bins: DataFrame, level: int) -> DataFrame:
    few = F.broadcast(bins.select(F.col("field").alias("in_field"), "bin"))
    return rows.join(few, (F.col("field") == F.col("in_field")) & (_prefix(F.col("h"), level) == F.col("bin")), "left_semi")


def split_join(left: DataFrame, right: DataFrame, key: str, fraction: float = 0.002) -> DataFrame:
    """Left outer join of `left` to `right`, unique by `key`, when a few keys hold most of `left`.

    Keys holding at least `fraction` of the non-null rows of `left` number 1/fraction at most;
    only their rows of `right` are broadcast. All other rows are shuffled by key. Null keys match
    nothing and are kept. Columns of `right` must not clash with those of `left` but for the key.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.select(key, "__n"), "heavy")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    heavy = counts.where(F.col("__n") >= max(2.0, fraction * total)).select(F.col(key).alias("__heavy"))
    few = F.broadcast(heavy)
    hot = left.join(few, F.col(key) == F.col("__heavy"), "left_semi")
    cold = left.join(few, F.col(key) == F.col("__heavy"), "left_anti")
    hot_right = right.join(few, F.col(key) == F.col("__heavy"), "left_semi")
    return cold.join(right, key, "left").unionByName(hot.join(F.broadcast(hot_right), key, "left"))
