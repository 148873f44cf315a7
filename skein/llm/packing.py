"""Filling containers of fixed capacity with whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

_MEMBER = "struct<doc_id bigint, part int, start_token bigint, n_tokens int>"
_BIN = f"size int, members array<{_MEMBER}>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, items taken from the largest down, each into the fullest bin that has
    room. Bins are kept by their free space, and a bit mask names the spaces that occur, so an
    item costs one look-up however many bins are open."""
    bins = np.empty(len(sizes), np.int64)
    by_space: dict[int, list[int]] = {}
    mask = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        roomy = mask >> size
        if roomy:
            space = (roomy & -roomy).bit_length() - 1 + size
            here = by_space[space]
            b = here.pop()
            if not here:
                mask &= ~(1 << space)
        else:
            b, space, n = n, capacity, n + 1
        bins[i] = b
        left = space - size
        by_space.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


def _merge(table: pa.Table, capacity: int) -> pa.RecordBatch:
    """The bins of a block, best-fitted into fewer; member lists are concatenated column-wise."""
    members = table.column("members").combine_chunks()
    sizes = table.column("size").to_numpy()
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    taken = members.take(pa.array(order))
    starts = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
    lengths = np.r_[0, np.cumsum(np.diff(taken.offsets.to_numpy()))]
    offsets = np.r_[lengths[starts], lengths[-1]].astype(np.int32)
    merged = pa.ListArray.from_arrays(pa.array(offsets), taken.flatten(), type=members.type)
    return pa.RecordBatch.from_arrays([pa.array(np.add.reduceat(sizes[order], starts).astype(np.int32)), merged], names=["size", "members"])


def pack(items: DataFrame, capacity: int, block: int = 100_000) -> DataFrame:
    """Windows of at most `capacity` tokens holding all of `items(doc_id, n_tokens)`: one row per
    window with `size` and `members`, an array of (doc_id, part, start_token, n_tokens).

    An item is placed whole, as part 0, unless it is longer than a window; then it is cut into
    full windows and a rest. Items without tokens, without a size or without an id need no place
    and get none. Repeated items are placed as often as they come. Ties go to the earlier item.

    Each partition best-fits blocks of at most `block` items where they are read. Best fit leaves
    no two windows of a block that would go into one, so what can still be merged are few small
    windows among those with room for the smallest. Windows without that room are done; the others
    are ranged by size, `block` a group and the smallest together, and best-fitted again as items,
    round after round, until not even the two smallest windows left go into one. No group exceeds
    `block` items by more than the ranges' unevenness, and no window's list exceeds `capacity`
    members.
    """
    cuts = F.expr(
        f"transform(sequence(0, cast((n_tokens - 1) div {capacity} as int)), i -> named_struct('doc_id', cast(doc_id as bigint), 'part', i, "
        f"'start_token', cast(i as bigint) * {capacity}, 'n_tokens', cast(least({capacity}, n_tokens - cast(i as bigint) * {capacity}) as int)))"
    )
    parts = items.where("n_tokens > 0 and doc_id is not null").select(F.explode(cuts).alias("m")).select(F.col("m.n_tokens").alias("size"), F.array("m").alias("members"))

    def fit(batches: Iterator[pa.RecordBatch], most: int = block) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                room = most - n
                held.append(batch.slice(0, room))
                n += held[-1].num_rows
                batch = batch.slice(room)
                if n == most:
                    yield _merge(pa.Table.from_batches(held), capacity)
                    held, n = [], 0
        if n:
            yield _merge(pa.Table.from_batches(held), capacity)

    done: list[DataFrame] = []
    open_ = materialize(parts.mapInArrow(fit, _BIN), "bins")
    while True:
        two = [r["size"] for r in open_.select("size").orderBy("size").limit(2).collect()]
        if len(two) < 2 or sum(two) > capacity:
            break
        roomy = F.col("size") <= capacity - two[0]
        done.append(open_.where(~roomy))
        open_ = open_.where(roomy)
        groups = -(-open_.count() // block)
        # sorted, so the two smallest are in one block however uneven the ranges are
        spread = open_.coalesce(1) if groups == 1 else open_.repartitionByRange(groups, "size", F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["part"]))
        open_ = materialize(spread.sortWithinPartitions("size").mapInArrow(lambda batches: fit(batches, 2 * block), _BIN), "bins")
    out = open_
    for d in done:
        out = out.unionByName(d)
    return out


def windows(packed: DataFrame) -> DataFrame:
    """One row per placed part: `window_id` (the first member's id and part), `window_tokens`,
    `position`, `doc_id`, `part`, `start_token`, `n_tokens`."""
    first = F.col("members")[0]
    return packed.select(
        F.concat_ws("-", first["doc_id"], first["part"]).alias("window_id"), F.col("size").alias("window_tokens"), F.posexplode("members").alias("position", "m")
    ).select("window_id", "window_tokens", "position", "m.*")
