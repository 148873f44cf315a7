"""What changed between consecutive full snapshots.

Keys are hashed to shards; inside a shard each key has a persistent ordinal, each generation is a
compressed bitmap of the ordinals it holds, and its values are a vector aligned to them. AND-NOT
of neighbouring bitmaps gives additions and removals, AND with unequal vectors the changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPAN = 1 << 16


class Bitmap:
    """A compressed set of ordinals: per 65,536 ordinals either a sorted array, if up to 4,096 are
    set, or their bits."""

    def __init__(self, boxes: dict[int, np.ndarray]):
        self.boxes = boxes

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        """uint16 values, sorted and unique: kept, or turned to 8 KB of bits."""
        if len(low) <= 4096:
            return low.astype(np.uint16)
        bits = np.zeros(_SPAN, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _bits(box: np.ndarray) -> np.ndarray:
        if box.dtype == np.uint8:
            return box
        bits = np.zeros(_SPAN, np.uint8)
        bits[box] = 1
        return np.packbits(bits)

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        ordinals = np.unique(np.asarray(ordinals, np.int64))
        high = ordinals // _SPAN
        names, at = np.unique(high, return_index=True)
        return cls({int(h): cls._pack(part % _SPAN) for h, part in zip(names, np.split(ordinals, at[1:]), strict=True)} if len(names) else {})

    def _each(self, other: Bitmap, arrays, bits) -> Bitmap:
        out = {}
        for h, a in self.boxes.items():
            b = other.boxes.get(h, np.empty(0, np.uint16))
            if a.dtype == b.dtype == np.uint16:
                low = arrays(a, b)
            else:
                low = np.flatnonzero(np.unpackbits(bits(self._bits(a), self._bits(b))))
            if len(low):
                out[h] = self._pack(low)
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._each(other, lambda a, b: np.setdiff1d(a, b, assume_unique=True), lambda a, b: a & ~b)

    def and_(self, other: Bitmap) -> Bitmap:
        return self._each(other, lambda a, b: np.intersect1d(a, b, assume_unique=True), lambda a, b: a & b)

    def ordinals(self) -> np.ndarray:
        parts = [
            (box.astype(np.int64) if box.dtype == np.uint16 else np.flatnonzero(np.unpackbits(box))) + h * _SPAN
            for h, box in sorted(self.boxes.items())
        ]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def json_form(text: Column) -> Column:
    """A form of JSON text in which key order and spacing don't count; text that is no JSON, null
    included, stands for itself."""
    return F.coalesce(F.concat(F.lit("j"), F.to_json(F.try_parse_json(text))), F.concat(F.lit("t"), text))


def ordered_generations(deliveries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(project, generation_id, seq, last) of the generations that have rows: their number in the
    order of `first_published_at`, ties by id, and the project's last number. A generation that is
    in no catalogue comes first."""
    have = deliveries.select("project", "generation_id").distinct()
    when = catalog.groupBy("generation_id").agg(F.min("first_published_at").alias("at"))
    by = Window.partitionBy("project").orderBy(F.col("at").asc_nulls_first(), "generation_id")
    return have.join(when, "generation_id", "left").select(
        "project", "generation_id", F.row_number().over(by).alias("seq"), F.count(F.lit(1)).over(Window.partitionBy("project")).cast("int").alias("last")
    )


_OUT = "project string, k0 string, k1 string, k2 string, seq int, change_kind string"


def _shard(table: pa.Table) -> pa.Table:
    """The changes inside one shard: one row per key, with its generations and their values.

    Projects share the shard's ordinals, and bitmaps are kept by the number of a generation in its
    project, so one AND-NOT compares neighbouring generations of all projects at once.
    """
    lists = table.column("held").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    seq, value, check = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("seq", "value", "check"))
    # the shard's dictionary: a key's ordinal is its rank by first appearance, then by key, so
    # later generations never renumber it
    born = np.full(table.num_rows, np.iinfo(np.int64).max)
    np.minimum.at(born, row, seq)
    by_key = pa.compute.sort_indices(table.append_column("born", pa.array(born)), [(c, "ascending") for c in ("born", "project", "k0", "k1", "k2")]).to_numpy()
    ordinal_of = np.empty(table.num_rows, np.int64)
    ordinal_of[by_key] = np.arange(table.num_rows)
    ordinal = ordinal_of[row]
    last = table.column("last").to_numpy()[by_key]

    order = np.lexsort((check, value, seq))  # of several values of a key the greatest is written last
    bounds = np.flatnonzero(np.r_[True, np.diff(seq[order]) > 0, True])
    spans = {int(seq[order[i]]): order[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)} if len(seq) else {}

    def aligned(s: int) -> tuple[Bitmap, np.ndarray, np.ndarray]:
        """The bitmap of generation number s, the ordinals it holds, and their values in step: two
        hashes, 128 bits. Both follow the generation's rows, not the shard's."""
        rows = spans[s]
        rows = rows[np.argsort(ordinal[rows], kind="stable")]
        held = ordinal[rows]
        last_of = np.r_[held[1:] != held[:-1], True]  # of equal ordinals the last row counts
        rows = rows[last_of]
        return Bitmap.of(ordinal[rows]), ordinal[rows], np.stack([value[rows], check[rows]])

    out: list[tuple[np.ndarray, int, str]] = []
    none = (Bitmap({}), np.empty(0, np.int64), np.empty((2, 0), np.int64))
    before, before_s = none, None
    for s in sorted(spans):
        if before_s != s - 1:
            before = none
        now = aligned(s)
        if s > 1:
            out.append((now[0].and_not(before[0]).ordinals(), s, "added"))
            both = now[0].and_(before[0]).ordinals()
            if len(both):
                a, b = (x[2][:, np.searchsorted(x[1], both)] for x in (now, before))
                out.append((both[(a != b).any(axis=0)], s, "changed"))
        after = Bitmap.of(ordinal[spans[s + 1]]) if s + 1 in spans else Bitmap({})
        gone = now[0].and_not(after).ordinals()
        out.append((gone[last[gone] > s], s + 1, "removed"))
        before, before_s = now, s
    ordinals = np.concatenate([o for o, _, _ in out]) if out else np.empty(0, np.int64)
    named = table.select(["project", "k0", "k1", "k2"]).take(pa.array(by_key[ordinals]))
    seqs = np.concatenate([np.full(len(o), s, np.int32) for o, s, _ in out]) if out else np.empty(0, np.int32)
    kinds = np.concatenate([np.full(len(o), k, object) for o, _, k in out]) if out else np.empty(0, object)
    return named.append_column("seq", pa.array(seqs, pa.int32())).append_column("change_kind", pa.array(kinds, pa.string()))


#: Up to so many generations (about 20 MB) their table is broadcast; beyond, it is shuffled.
_FEW_GENERATIONS = 200_000


def snapshot_changes(snapshots: DataFrame, generations: DataFrame, keys: list[str], values: list[Column], rows_per_shard: int = 400_000) -> DataFrame:
    """Per project and generation but the first, the keys (`k0`, `k1`, `k2`; absent ones '')
    added, removed or changed against the generation before.

    `snapshots` has project, generation_id, up to three string `keys` and what `values` read;
    `generations` comes from `ordered_generations`. Repeated rows count once; of rows of a key
    that differ within a generation, one decides, the same on every run. Null key parts are a
    value of their own; null values equal each other. Rows of a generation that `generations`
    lacks, or without a project, are left out. A generation without rows here has lost all keys.

    Rows are gathered per key, repeated ones collapsing before the shuffle, and keys are spread
    over shards by their hash, so neither a large project nor a large generation meets in a task.
    The shard count follows the row count.
    """
    few = generations.count() <= _FEW_GENERATIONS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    parts = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] + [F.lit("").alias(f"k{i}") for i in range(len(keys), 3)]
    told = [c for v in values for c in (F.isnull(v), v)]  # a hash alone passes over nulls
    # 128 bits: a key whose values differ passes for unchanged with odds of one to 2^128
    rows = snapshots.select("project", "generation_id", *parts, F.xxhash64(*told).alias("value"), F.xxhash64(F.lit(1), *told).alias("check"))
    shards = max(1, -(-snapshots.count() // rows_per_shard))
    by_key = (
        rows.join(small(generations), ["project", "generation_id"])
        .groupBy("project", "k0", "k1", "k2")
        .agg(F.max("last").alias("last"), F.collect_set(F.struct("seq", "value", "check")).alias("held"))
        .withColumn("shard", F.pmod(F.xxhash64("project", "k0", "k1", "k2"), F.lit(shards)).cast("int"))
    )
    found = by_key.groupBy("shard").applyInArrow(_shard, _OUT)
    return found.join(small(generations.select("project", "seq", "generation_id")), ["project", "seq"]).drop("seq")
