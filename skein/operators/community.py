"""Communities of a call graph and bounded, connected selections of edges."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import qn_package
from skein.operators.cycles import hooked
from skein.operators.reach import components
from skein.session import materialize, release

#: Up to so many edges, what is left of a graph is clustered in one task, by the same rule.
SMALL = 5_500_000
#: Votes that one task looks at together.
CHUNK = 1_000_000
#: What a move gains that is none.
_NONE = -(1 << 62)
#: Up to so many edges of a project, or what is left of them, are capped in one task, by the same rule.
CAPPED = 250_000


def _mix(n: int) -> tuple[int, int]:
    """Factor and offset by which round `n` spreads ids; products stay within 63 bits."""
    return 1103515245 + 2 * (n * 40503 % 65536), n * 12345 % 65536


def _grouped_cumsum(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The running sum of x within each group, in the order given."""
    order = np.sort(group.astype(np.int64) << 32 | np.arange(len(group))) & (1 << 32) - 1
    run = np.cumsum(x[order])
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(group) else np.empty(0, np.int64)
    base = np.repeat(run[first] - x[order][first], np.diff(np.r_[first, len(group)]))
    out = np.empty_like(run)
    out[order] = run - base
    return out


def _sought(e: tuple, k: np.ndarray, comm: np.ndarray, weight: np.ndarray, total: int, todo: np.ndarray, gain: np.ndarray, to: np.ndarray) -> None:
    """Sets `gain` and `to` of the nodes `todo` to their best move; a gain of 0 is none. The rule as it
    is; `_settled` finds the same moves by votes that it keeps, and tests hold it against this."""
    a, b, w = e
    gain[todo] = 0
    if not todo.all():
        at = np.flatnonzero(todo[a])
        a, b, w = a[at], b[at], w[at]
    if not len(a):
        return
    c = comm[b]
    key = a.astype(np.int64) * len(weight) + c
    order = np.argsort(key, kind="stable")  # edges are in the order of `a`, so most of it is there
    key, w = key[order], w[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    votes = np.add.reduceat(w, starts)
    at = order[starts]
    va, vc = a[at], c[at]
    del key, w, order, starts, c, at
    home = vc == comm[va]
    stay = np.zeros(len(k), np.int64)
    stay[va[home]] = votes[home]
    g = (votes - stay[va]) * total - k[va] * (weight[vc] - weight[comm[va]] + k[va])
    up = (g > 0) & ~home
    va, vc, g = va[up], vc[up], g[up]
    if not len(va):
        return
    first = np.flatnonzero(np.r_[True, va[1:] != va[:-1]])
    most = np.maximum.reduceat(g, first)
    best = np.flatnonzero(g == np.repeat(most, np.diff(np.r_[first, len(va)])))
    best = best[np.r_[True, va[best][1:] != va[best][:-1]]]  # of equal ones the least community
    gain[va[best]], to[va[best]] = g[best], vc[best]


def _order(gain: np.ndarray, h: np.ndarray, va: np.ndarray) -> np.ndarray:
    """The order from the greatest to the least (gain, h, va); h is below 2 to the power of 31."""
    by = np.argsort(-gain)
    rank = np.empty(len(gain), np.int64)
    rank[by] = np.cumsum(np.r_[False, gain[by][1:] != gain[by][:-1]][: len(gain)])
    # as much of h as one number has room for beside the rank and the place, which sorts several times as fast
    bits = len(gain).bit_length()
    cut = max(0, 31 + int(rank.max(initial=0)).bit_length() + bits - 63)
    key = np.sort((rank << 31 | (1 << 31) - 1 - h) >> cut << bits | np.arange(len(gain)))
    order, key = key & (1 << bits) - 1, key >> bits
    same = key[1:] == key[:-1]
    at = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    again = order[at]
    order[at] = again[np.lexsort((-va[again], -h[again], rank[again]))]
    return order


def _chosen_moves(ids: np.ndarray, k: np.ndarray, comm: np.ndarray, gain: np.ndarray, to: np.ndarray, n_labels: int, n: int, room: tuple | None = None) -> np.ndarray:
    """The nodes that move in round `n`, of those with a gain. `room`: two vectors of a place for each
    label that hold the number of nodes, and do so again afterwards."""
    va = np.flatnonzero(gain)
    factor, offset = _mix(n)
    h = (ids[va] % 2147483647 * factor + offset) % 2147483629
    va = va[_order(gain[va], h, va)]
    vc, own = to[va], comm[va]
    # the first move that takes into each community, and the first that takes from it: of equal places the last written stays
    into, out = room if room else (np.full(n_labels, len(gain), np.int32), np.full(n_labels, len(gain), np.int32))
    r = np.arange(len(va), dtype=np.int32)[::-1]
    into[vc[::-1]], out[own[::-1]] = r, r
    ok = (into[vc] < out[vc]) & (into[own] >= out[own])
    for x in (into, out):
        x[vc] = x[own] = len(gain)
    va, vc, own = va[ok], vc[ok], own[ok]
    before = _grouped_cumsum(vc, k[va]) + _grouped_cumsum(own, k[va]) - 2 * k[va]
    return va[gain[va] - k[va] * before > 0]


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of `w` of each; none is negative."""
    if not len(key):
        return key, w
    bits = int(w.max()).bit_length()
    if int(key.max()).bit_length() + bits < 64:  # both in one number, which sorts several times as fast
        key = key << bits
        key |= w
        key.sort()
        w = key & (1 << bits) - 1
        key >>= bits
    else:
        order = np.argsort(key)
        key, w = key[order], w[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts], np.add.reduceat(w, starts)


def _chunks(nodes: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`nodes` and their `count`, in parts of some `CHUNK` in all, or of one node."""
    part = np.cumsum(count) // CHUNK
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(nodes)]
    return ((nodes[i:j], count[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j)


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray | slice:
    """The places start, start + 1, ... of each span, one span after another."""
    end = np.cumsum(count)
    if (start[1:] == start[:-1] + count[:-1]).all():
        return slice(int(start[0]), int(start[0] + end[-1])) if len(start) else slice(0, 0)
    return np.repeat(start - end + count, count) + np.arange(end[-1])


class _Votes:
    """For every node the weight of its edges to each community beside it. The votes of a node take
    the places of its edges, as many as are needed, in the order of the communities."""

    def __init__(self, e: tuple, n: int) -> None:
        a, self.b, self.w = e
        self.row = np.searchsorted(a, np.arange(n + 1, dtype=a.dtype))
        self.comm, self.votes, self.count = np.empty(len(a), np.int32), np.empty(len(a), np.int64), np.zeros(n, np.int64)

    def degree(self, nodes: np.ndarray) -> np.ndarray:
        return self.row[nodes + 1] - self.row[nodes]

    def beside(self, nodes: np.ndarray) -> np.ndarray:
        return self.b[_spans(self.row[nodes], self.degree(nodes))]

    def count_again(self, nodes: np.ndarray, comm: np.ndarray) -> None:
        bits = int(comm.max(initial=0)).bit_length()
        for some, degree in _chunks(nodes, self.degree(nodes)):
            at = _spans(self.row[some], degree)
            key, votes = _summed(np.repeat(np.arange(len(some)), degree) << bits | comm[self.b[at]], self.w[at])
            i = key >> bits
            self.count[some] = count = np.bincount(i, minlength=len(some))
            at = _spans(self.row[some], count)
            self.comm[at], self.votes[at] = key & (1 << bits) - 1, votes

    def seek(self, nodes: np.ndarray, k: np.ndarray, comm: np.ndarray, weight: np.ndarray, total: int, gain: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Sets `gain` and `to` of `nodes` to their best move; a gain of 0 is none. Returns what
        each would gain by its best move, be it less than 0."""
        found = []
        for some, count in _chunks(nodes, self.count[nodes]):
            at = _spans(self.row[some], count)
            c, votes = self.comm[at], self.votes[at]
            i = np.repeat(np.arange(len(some)), count)
            own, held = comm[some], k[some]
            home = np.flatnonzero(c == own[i])
            stay = np.zeros(len(some), np.int64)
            stay[i[home]] = votes[home]
            g = votes * total
            g -= held[i] * weight[c]
            g -= (stay * total + held * (held - weight[own]))[i]
            g[home] = _NONE
            most = np.maximum.reduceat(g, np.cumsum(count) - count)
            up = most > 0
            best = np.flatnonzero(g == np.where(up, most, 1 - _NONE)[i])
            best = best[np.r_[True, i[best][1:] != i[best][:-1]]] if len(best) else best  # of equal ones the least community
            gain[some] = np.where(up, most, 0)
            to[some[i[best]]] = c[best]
            found.append(most)
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _settled(e: tuple, ids: np.ndarray, k: np.ndarray, comm: np.ndarray, n_labels: int, total: int) -> np.ndarray:
    """`comm` after rounds over the edges (a, b, w) of nodes 0..len(ids), in the order of a, until no
    move gains. See `communities` for the rule; all numbers are whole, so joins give the same, and so
    does `_sought` for all nodes in every round.

    Votes are counted again beside nodes that moved only. Of other nodes a move is sought again unless
    none can gain: a node that would have gained `most` <= 0 gains at most k more for each unit that
    its own community has grown by and that any other, not left by all, has lost (`lost`, summed over
    rounds). So none gains while the weight of its own and `lost` are together within `bound`, nor if
    in this round its own has not grown and none beside it has lost.
    """
    comm = comm.astype(np.int32)
    weight = np.zeros(n_labels, np.int64)
    np.add.at(weight, comm, k)
    gain, to = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
    bound = np.full(len(ids), np.iinfo(np.int64).max)
    room, change = (np.full(n_labels, len(ids), np.int32), np.full(n_labels, len(ids), np.int32)), np.zeros(n_labels, np.int8)
    votes = _Votes(e, len(ids))
    nodes = np.flatnonzero(votes.row[1:] > votes.row[:-1])
    votes.count_again(nodes, comm)
    n = lost = 0
    while True:
        most = votes.seek(nodes, k, comm, weight, total, gain, to)
        bound[nodes] = np.where(most > 0, -1, weight[comm[nodes]] + lost + -most // np.maximum(k[nodes], 1))
        if not gain.any():
            return comm
        va = _chosen_moves(ids, k, comm, gain, to, n_labels, n, room)
        own, held = comm[va], weight[comm[va]]
        np.subtract.at(weight, own, k[va])
        np.add.at(weight, to[va], k[va])
        comm[va] = to[va]
        lost += int((held - weight[own])[weight[own] > 0].max(initial=0))
        near = np.zeros(len(ids), bool)
        near[votes.beside(va)] = True
        near = np.flatnonzero(near)
        votes.count_again(near, comm)
        bound[near] = bound[va] = -1
        change[own], change[comm[va]] = -1, 1
        changed = change[comm]
        change[own] = change[comm[va]] = 0
        members = np.flatnonzero(changed < 0)
        if votes.degree(members).sum() < 2 * len(ids):
            sought = (changed > 0) | (gain > 0)
            sought[near] = sought[va] = sought[votes.beside(members)] = True
            nodes = np.flatnonzero(sought)
            nodes = nodes[weight[comm[nodes]] > bound[nodes] - lost]
        else:
            nodes = np.flatnonzero(weight[comm] > bound - lost)
        n += 1


def _merged(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple:
    """Edges between 0..n, parallel ones summed and those within a node left out."""
    apart = a != b
    if not apart.all():
        a, b, w = a[apart], b[apart], w[apart]
    key = a.astype(np.int64)
    key *= n
    key += b
    key, w = _summed(key, w)
    a, b = np.divmod(key, n)
    return a.astype(np.int32), b.astype(np.int32), w


def _placed(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each of `x` in `names`, which are in order; looked up in order, which is faster."""
    order = np.argsort(x)
    at = np.empty(len(x), np.int32)
    at[order] = np.searchsorted(names, x[order])
    return at


def _clustered(a: np.ndarray, b: np.ndarray, w: np.ndarray, names: np.ndarray, k: np.ndarray, comm: np.ndarray, total: int) -> np.ndarray:
    """The community of every node, of edges (a, b, w), both ways, between places in `names`, which are
    in order, and the nodes' weights `k` and communities so far: the levels that are left, in one task."""
    labels = np.union1d(names, comm)  # places keep the order of the names
    comm = _placed(labels, comm)
    e = _merged(a, b, w, len(names))
    del a, b, w
    ids, final = names, np.arange(len(names))  # `final`: the current node of each node of the start
    while True:
        comm = _settled(e, ids, k, comm, len(labels), total)
        within = comm[e[0]] == comm[e[1]]
        fine = _settled(tuple(x[within] for x in e), ids, k, np.searchsorted(labels, ids), len(labels), total)
        del within
        parts, part = np.unique(fine, return_inverse=True)
        if len(parts) == len(ids):
            return labels[comm[final]]
        final = part[final]
        first = np.full(len(parts), len(ids))
        np.minimum.at(first, part, np.arange(len(ids)))
        held = np.zeros(len(parts), np.int64)
        np.add.at(held, part, k)
        ids, comm, k = labels[parts], comm[first], held
        e = _merged(part[e[0]], part[e[1]], e[2], len(parts))


def _alone(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple:
    """Of edges that are there one way: both ways, by places in the nodes; the nodes, their weights, and
    themselves as communities."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, w = at.astype(np.int32), np.concatenate([w, w])
    k = np.zeros(len(names), np.int64)
    np.add.at(k, at, w)
    return at, np.concatenate([at[len(a) :], at[: len(a)]]), w, names, k, names


def leiden(edges: dict[int, dict[int, float]]) -> dict[int, int]:
    """Communities of an undirected graph with whole weights, given by neighbours, by the rule of
    `communities` in one task; a community is named after its least node."""
    rows = [(u, v, int(w)) for u, vs in sorted(edges.items()) for v, w in vs.items() if u < v]
    if not rows:
        return {u: u for u in edges}
    a, b, w = np.array(rows, np.int64).T
    both = _alone(a, b, w)
    comm = _clustered(*both, 2 * int(w.sum()))
    return _named({u: u for u in edges} | dict(zip(both[3].tolist(), comm.tolist(), strict=True)))


def _named(final: dict[int, int]) -> dict[int, int]:
    names: dict[int, int] = {}
    for u in sorted(final):
        names.setdefault(final[u], u)
    return {u: names[c] for u, c in final.items()}


def _settled_by_joins(edges: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """As `_settled`, one round after another as joins."""
    n, last = 0, None
    while True:
        w = nodes.groupBy("comm").agg(F.sum("k").alias("weight"))
        at = nodes.join(w, "comm").select(F.col("node").alias("a"), "k", "within", F.col("comm").alias("own"), F.col("weight").alias("held"))
        far = nodes.select(F.col("node").alias("b"), F.col("within").alias("wb"), F.col("comm").alias("c"))
        votes = edges.join(far, "b").join(at, "a").where("within = wb").groupBy("a", "c").agg(F.sum("w").alias("w"), F.first("k").alias("k"), F.first("own").alias("own"), F.first("held").alias("held"))
        stay = F.coalesce(F.sum(F.when(F.col("c") == F.col("own"), F.col("w"))).over(Window.partitionBy("a")), F.lit(0))
        v = votes.withColumn("stay", stay).where("c <> own").join(w.withColumnRenamed("comm", "c"), "c")
        v = v.withColumn("gain", (F.col("w") - F.col("stay")) * F.lit(total) - F.col("k") * (F.col("weight") - F.col("held") + F.col("k"))).where("gain > 0")
        factor, offset = _mix(n)
        h = F.pmod(F.pmod("a", F.lit(2147483647)) * F.lit(factor) + F.lit(offset), F.lit(2147483629))
        best = v.groupBy("a", "own", "k").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("m")).select("a", "own", "k", F.col("m.gain").alias("gain"), (-F.col("m.c")).alias("c")).withColumn("key", F.struct("gain", h.alias("h"), "a"))
        best = materialize(best, "moves")
        if best.isEmpty():
            return nodes
        release(last)
        n += 1
        ends = best.select(F.explode(F.array(F.struct(F.col("c").alias("x"), F.lit(True).alias("in")), F.struct(F.col("own").alias("x"), F.lit(False).alias("in")))).alias("p"), "key")
        ends = ends.groupBy(F.col("p.x").alias("x")).agg(F.max(F.when(F.col("p.in"), F.col("key"))).alias("i"), F.max(F.when(~F.col("p.in"), F.col("key"))).alias("o"))
        open_ = ends.where("i is not null and (o is null or i > o)").select("x")
        ok = best.join(open_.withColumnRenamed("x", "c"), "c", "left_semi").join(open_.withColumnRenamed("x", "own"), "own", "left_anti")
        before = lambda p: F.sum("k").over(Window.partitionBy(p).orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
        ok = ok.withColumn("i", before("c")).withColumn("o", before("own")).where("gain - k * (i + o) > 0")
        was, nodes = nodes, materialize(nodes.join(ok.select(F.col("a").alias("node"), F.col("c").alias("new")), "node", "left").select("node", "k", "within", F.coalesce("new", "comm").alias("comm")), "nodes")
        release(best)
        last = was if n > 1 else None  # the first state is the caller's


def communities(links: DataFrame) -> DataFrame:
    """(node, community) of `links(src, dst)`, direction and self-links aside, parallel links
    adding weight; a community is connected and named after its least node.

    Leiden by rounds, until nothing merges. In a round every node seeks the neighbouring community
    that adds most to the modularity of the whole graph. A community then either takes nodes or
    gives them, whichever has the better move, and of its moves those are made that gain even if
    all better ones are made too: so every round adds to the modularity. When no move gains, nodes
    start alone again and move within their communities; these parts are the next level's nodes,
    the communities its start. Rounds are joins while there are more than `SMALL` edges and one
    task's vectors then; the numbers are whole, so both make the same moves.
    """
    e = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    whole = materialize(e, "weighted")
    edges = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("comm", F.col("node"))
    n, half = whole.agg(F.count(F.lit(1)), F.sum("w")).first()
    total = 2 * (half or 0)
    if not n:
        return nodes.select("node", F.col("comm").alias("community"))
    if n <= SMALL:

        def all_of(t: pa.Table) -> pa.Table:
            a, b, w = (t[c].to_numpy() for c in "abw")
            (a, b, w, node, *alone), n = _alone(a, b, w), len(a)
            comm = _clustered(a, b, w, node, *alone, total)
            same = np.flatnonzero(comm[a[:n]] == comm[b[:n]])
            return pa.table({"node": node, "community": node[hooked(len(node), a[same], b[same])]})

        return whole.groupBy().applyInArrow(all_of, "node bigint, community bigint")
    nodes = materialize(nodes, "nodes")
    final = nodes.select("node", F.col("node").alias("part"))
    while edges.count() > 2 * SMALL:
        nodes = _settled_by_joins(edges, nodes.withColumn("within", F.lit(0).cast("bigint")), total)
        fine = _settled_by_joins(edges, nodes.select("node", "k", F.col("comm").alias("within"), F.col("node").alias("comm")), total)
        if fine.where("comm <> node").isEmpty():
            break
        part = fine.select(F.col("node").alias("part"), F.col("comm").alias("p"))
        final = materialize(final.join(part, "part").select("node", F.col("p").alias("part")), "parts")
        edges = edges.join(part.toDF("a", "pa"), "a").join(part.toDF("b", "pb"), "b").where("pa <> pb").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w"))
        edges = materialize(edges, "edges")
        nodes = materialize(fine.groupBy(F.col("comm").alias("node")).agg(F.sum("k").alias("k"), F.first("within").alias("comm")), "nodes")
    else:

        def run(t: pa.Table) -> pa.Table:
            edge = t["edge"].to_numpy()
            a, b, w = (t[c].to_numpy() for c in "abw")
            order = np.argsort(a[~edge])
            node, comm, k = (x[~edge][order] for x in (a, b, w))
            comm = _clustered(_placed(node, a[edge]), _placed(node, b[edge]), w[edge], node, k, comm, total)
            return pa.table({"part": node, "community": comm})

        left = edges.select("a", "b", "w", F.lit(True).alias("edge")).unionByName(nodes.select(F.col("node").alias("a"), F.col("comm").alias("b"), F.col("k").alias("w"), F.lit(False).alias("edge")))
        nodes = left.groupBy().applyInArrow(run, "part bigint, community bigint").withColumnsRenamed({"part": "node", "community": "comm"})
    final = materialize(final.join(nodes.select(F.col("node").alias("part"), F.col("comm").alias("community")), "part").select("node", "community"), "communities")
    of = lambda x: final.toDF(x, f"c{x}")
    inner = whole.join(of("a"), "a").join(of("b"), "b").where("ca = cb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return final.select("node").join(components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def cluster_report(members: DataFrame, links: DataFrame, names: DataFrame, top: int = 12, keep: int = 5) -> DataFrame:
    """The `top` largest communities of two nodes and more: size, cohesion (links within against
    all that touch it), the `keep` names of highest degree, its `keep` commonest packages, and the
    commonest as its label. `names(node, name, label, qualified_name)`."""
    m = materialize(members.select("node", "community"), "members")
    sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    few = F.broadcast(materialize(sizes.orderBy(F.desc("n"), "community").limit(top), "largest"))
    ends = links.where("src <> dst").select("src", "dst").join(m.toDF("src", "cs"), "src", "left").join(m.toDF("dst", "cd"), "dst", "left")
    ends = ends.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("cs").alias("community"), F.col("cd").alias("far")), F.struct(F.col("dst").alias("node"), F.col("cd").alias("community"), F.col("cs").alias("far")))).alias("x"))
    # by node and then by community, so that a link is counted at either end
    d = ends.select("x.*").join(few.select("community"), "community", "left_semi").groupBy("community", "node").agg(F.count(F.lit(1)).alias("degree"), F.expr("count_if(community = far)").alias("within"), F.expr("count_if(community <> far)").alias("across"))
    d = materialize(d, "degrees")
    told = d.groupBy("community").agg(F.expr("sum(within) div 2").alias("within"), F.sum("across").alias("across"))
    d = d.select("node", "degree")
    named = m.join(few.select("community"), "community", "left_semi").join(names, "node")
    ranked = named.join(d, "node", "left").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node")))
    best = ranked.where(F.col("r") <= keep).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("top_names"))
    package = F.coalesce(F.nullif(qn_package(F.col("qualified_name")), F.lit("")), F.substring_index(F.coalesce("qualified_name", F.lit("")), "/", 2))
    common = named.groupBy("community", package.alias("package")).agg(F.count(F.lit(1)).alias("c")).where("package <> ''")
    common = common.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("c"), "package"))).where(F.col("r") <= keep)
    packages = common.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "package"))), lambda x: x["package"]), ", ").alias("packages"), F.min_by("package", "r").alias("label"))
    out = few.join(told, "community", "left").join(best, "community", "left").join(packages, "community", "left")
    w, a = F.coalesce("within", F.lit(0)), F.coalesce("across", F.lit(0))
    return out.select("community", "n", w.alias("within"), a.alias("across"), F.round(w / F.nullif(w + a, F.lit(0)), 6).alias("cohesion"), "top_names", "packages", "label")


def modularity(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row: the modularity of a partition of an undirected graph."""
    e = links.where("src <> dst")
    ends = e.join(members.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(members.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    m = ends.agg(F.count(F.lit(1)).cast("double").alias("m"))
    inner = ends.where("a = b").agg(F.count(F.lit(1)).alias("inner"))
    deg = ends.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return m.join(F.broadcast(inner), F.lit(True)).join(F.broadcast(deg), F.lit(True)).select(F.round(F.col("inner") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


#: Which edges come first when not all may stay (fixed values).
PRIORITY = {"CONTAINS": 0, "CONTAINS_FILE": 0, "CONTAINS_FOLDER": 0, "DEFINES": 0, "INHERITS": 1, "IMPLEMENTS": 1, "IMPORTS": 1, "CALLS": 2}


def _chosen(rows: list[tuple], forest: bool) -> list[int]:
    """The ids that stay of `rows` (id, source, target, part of source, part of target, room of
    source, room of target), taken in turn: while both ends have room and, for a `forest`, the edge
    joins two parts that are not joined yet."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    outs: dict = {}
    ins: dict = {}
    kept = []
    for i, s, t, ca, cb, rs, rt in rows:
        if outs.setdefault(s, rs) <= 0 or ins.setdefault(t, rt) <= 0:
            continue
        a, b = find(ca), find(cb)
        if forest and a == b:
            continue
        parent[a] = b
        outs[s] -= 1
        ins[t] -= 1
        kept.append(i)
    return kept


_OPEN = ["project", "o", "id", "source_id", "target_id", "ca", "cb", "rs", "rt"]


def _rounds(pend: DataFrame, out_cap: int, in_cap: int, forest: bool, small: int) -> tuple[DataFrame, DataFrame]:
    """(kept, rest) of `pend` with the columns _OPEN: what `_chosen` keeps, and what it leaves for
    want of a second part, both with the rooms and parts before them.

    In a round those edges are kept that are sure of their place: of a forest the first edge of a
    part, since no earlier one leaves the part; and everywhere edges that have room even if all
    earlier ones at their ends are kept. The very first edge always is one, so rounds end. Hubs are
    ranked to their cap only. With `small` edges or fewer left, they are taken in turn in one task.
    """
    kept, rest = [], []
    key = F.struct("o", "id")
    while True:
        if forest:
            rest.append(pend.where("ca = cb"))
            pend = pend.where("ca <> cb")
        n = pend.count()
        if not n:
            break
        if n <= small:

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(["o", "id"])
                ends = [list(zip(pdf["project"], pdf[c], strict=True)) for c in ("source_id", "target_id")]
                return pd.DataFrame({"id": pd.Series(_chosen(list(zip(pdf["id"], *ends, pdf["ca"], pdf["cb"], pdf["rs"], pdf["rt"], strict=True)), forest), dtype="int64")})

            ids = materialize(pend.groupBy().applyInPandas(run, "id bigint"), "kept")
            kept.append(pend.join(ids, "id", "left_semi").select(*_OPEN))
            rest.append(pend.join(ids, "id", "left_anti").select(*_OPEN))
            break
        ranked = lambda end, cap, room: pend.withColumn("r", F.row_number().over(Window.partitionBy("project", end).orderBy("o", "id"))).where(F.col("r") <= cap).where(F.col("r") <= F.col(room))
        sure = ranked("source_id", out_cap, "rs").join(ranked("target_id", in_cap, "rt").select("id"), "id", "left_semi")
        if forest:
            first = pend.select(F.explode(F.array("ca", "cb")).alias("c"), key.alias("k")).groupBy("c").agg(F.min("k").alias("k"))
            sure = sure.join(first.toDF("ca", "ka"), "ca").join(first.toDF("cb", "kb"), "cb").where((key == F.col("ka")) | (key == F.col("kb")))
        sure = materialize(sure.select(*_OPEN), "kept")
        kept.append(sure)
        pend = materialize(_after_keeping(pend.join(sure.select("id"), "id", "left_anti"), sure, forest), "open")
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else pend
    return union(kept), union(rest)


def _after_keeping(pend: DataFrame, kept: DataFrame, forest: bool) -> DataFrame:
    """Open edges with the rooms that are left, without those that have none, and, for a forest,
    with the parts as the kept edges have joined them."""
    out, into = kept.groupBy("project", "source_id").agg(F.count(F.lit(1)).alias("us")), kept.groupBy("project", "target_id").agg(F.count(F.lit(1)).alias("ut"))
    left = _null_safe(_null_safe(pend, out, ["project", "source_id"]), into, ["project", "target_id"])
    left = left.withColumn("rs", F.col("rs") - F.coalesce("us", F.lit(0))).withColumn("rt", F.col("rt") - F.coalesce("ut", F.lit(0))).where("rs > 0 and rt > 0")
    if forest:
        to = materialize(components(kept.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))), "parts")
        left = left.join(to.toDF("ca", "na"), "ca", "left").join(to.toDF("cb", "nb"), "cb", "left").withColumn("ca", F.coalesce("na", "ca")).withColumn("cb", F.coalesce("nb", "cb"))
    return left.select(*_OPEN)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])


def dual_cap(edges: DataFrame, out_cap: int, in_cap: int, small: int = CAPPED) -> DataFrame:
    """Edges of `edges(project, id, source_id, target_id, type)` such that no node keeps more than
    `out_cap` out of it or `in_cap` into it, and nodes stay connected where the caps allow.

    By project, in the order of type and id: first the edges that join two parts not joined yet,
    then others, as long as both ends have room. Projects of up to `small` edges are a task each;
    larger ones go by rounds of joins (see `_rounds`), which keep the same edges.
    """
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("type")], F.lit(3))
    part = lambda end: F.concat_ws("\u0001", F.coalesce("project", F.lit("")), F.col(end).cast("string"))
    e = edges.groupBy("project", "source_id", "target_id", "type").agg(F.min("id").alias("id")).withColumn("o", order)
    e = materialize(e.select("project", "o", "id", "source_id", "target_id", part("source_id").alias("ca"), part("target_id").alias("cb"), F.lit(out_cap).alias("rs"), F.lit(in_cap).alias("rt")), "edges")
    large = materialize(e.groupBy("project").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("project", F.lit(True).alias("large")), "large")
    sized = materialize(_null_safe(e, large, ["project"]), "sized")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id"])
        rows = list(zip(pdf["id"], pdf["source_id"], pdf["target_id"], pdf["ca"], pdf["cb"], pdf["rs"], pdf["rt"], strict=True))
        kept = set(_chosen(rows, True))
        outs, ins = Counter(r[1] for r in rows if r[0] in kept), Counter(r[2] for r in rows if r[0] in kept)
        rest = [(i, s, t, ca, cb, rs - outs[s], rt - ins[t]) for i, s, t, ca, cb, rs, rt in rows if i not in kept]
        return pd.DataFrame({"id": sorted(kept | set(_chosen(rest, False)))}, dtype="int64")

    kept = sized.where("large is null").groupBy("project").applyInPandas(run, "id bigint")
    if not large.isEmpty():
        tree, rest = _rounds(sized.where("large").select(*_OPEN), out_cap, in_cap, True, small)
        tree = materialize(tree, "forest")
        # rooms as they were before the forest, less what the whole forest took
        whole = sized.where("large").select("id", F.col("rs").alias("rs0"), F.col("rt").alias("rt0"))
        rest = rest.join(whole, "id").withColumn("rs", F.col("rs0")).withColumn("rt", F.col("rt0")).select(*_OPEN)
        more, _ = _rounds(materialize(_after_keeping(rest, tree, False), "rest"), out_cap, in_cap, False, small)
        kept = kept.unionByName(tree.select("id")).unionByName(more.select("id"))
    return edges.join(kept, "id", "left_semi")
