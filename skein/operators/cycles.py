"""Cycles of a directed graph, and the longest ways through what is left without them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize, release

#: Up to so many edges, what is left of a graph is finished in one task, with the same result.
SMALL = 250_000


def _numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The nodes, and for each the places of those it leads to."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    out: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(at[: len(src)].tolist(), at[len(src) :].tolist(), strict=True):
        out[a].append(b)
    return nodes, out


def strong(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and component of every node of an edge list: depth-first search by low points, without
    recursion. A component is named after its greatest node."""
    nodes, out = _numbered(src, dst)
    n = len(nodes)
    number, low, comp, count = [0] * n, [0] * n, [-1] * n, 0
    held: list[int] = []
    for root in range(n):
        if number[root]:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if not i:
                count += 1
                number[v] = low[v] = count
                held.append(v)
            for j in range(i, len(out[v])):
                w = out[v][j]
                if not number[w]:
                    work += [(v, j + 1), (w, 0)]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], number[w])
            else:
                if low[v] == number[v]:
                    members = []
                    while True:
                        members.append(held.pop())
                        if members[-1] == v:
                            break
                    for m in members:
                        comp[m] = max(members)
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return nodes, nodes[np.array(comp, np.int64)]


def hooked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The component of each node 0..n of an undirected edge list, named after its least node.
    In a round every label is hooked to the least beside it and chains are shortened; edges within a
    label are left out of the next."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(low := label[label], label):
            label = low


def connected(src: np.ndarray, dst: np.ndarray) -> tuple[list, list]:
    """Node and component of every node of an undirected edge list; see `hooked`."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return nodes.tolist(), nodes[hooked(len(nodes), at[: len(src)], at[len(src) :])].tolist()


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): the greatest color among a node and all that lead to it."""
    color, last = start, None
    while True:
        near = edges.join(color.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("c"))
        new = color.join(near, "node", "left").select("node", F.greatest("color", F.coalesce("c", "color")).alias("color"), (F.col("c") > F.col("color")).alias("grew"))
        new = materialize(new, "colors")
        color = new.select("node", "color")
        release(last)
        last = new
        if new.where("grew").isEmpty():
            return color


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) of the nodes of `edges(src, dst)` that lie on a cycle of two nodes and
    more; a component is named after its greatest node. Self-loops are no cycles here.

    While more than `small` edges are left, nodes without a way in or out are taken away, and when
    few go that way, every node takes the greatest node that leads to it as its color; what leads
    back to that node within the color is its component. The rest is searched in one task.
    """
    edges = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    found: list[DataFrame] = []
    n = edges.count()
    while n > small:
        ends = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        kept = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
        kept = materialize(kept.select("src", "dst"), "edges")
        left = kept.count()
        if left > 0.99 * n:
            color = _spread(kept.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("color", F.col("node")), kept)
            a, b = color.toDF("src", "ca"), color.toDF("dst", "cb")
            inner = materialize(kept.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("color")), "edges")
            back = materialize(color.where("node = color"), "component")
            rounds = [back]
            while True:
                step = inner.join(rounds[-1].select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "color").distinct()
                new = materialize(step.join(back.select("node"), "node", "left_anti"), "component")
                if new.isEmpty():
                    break
                rounds.append(new)
                back = materialize(back.unionByName(new), "component")
            found.append(back.join(back.groupBy("color").count().where("count > 1").select("color"), "color", "left_semi").select("node", F.col("color").alias("component")))
            kept = materialize(inner.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
            left = kept.count()
        release(edges)
        edges, n = kept, left

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, comp = strong(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        size = pd.Series(comp).map(pd.Series(comp).value_counts()).to_numpy()
        return pd.DataFrame({"node": nodes[size > 1], "component": comp[size > 1]})

    out = edges.groupBy().applyInPandas(run, "node bigint, component bigint")
    for f in found:
        out = out.unionByName(f)
    return out


def longest(own: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, total): `own(id, depth)` plus the greatest total of what `edges(src, dst)`, a graph
    without cycles, lead to. While more than `small` edges are left, the nodes that wait for none
    are taken away, one join a round; the rest is walked in one task."""
    todo, edges = own.select("id", "depth", F.lit(0).cast("bigint").alias("below")), edges.select("src", "dst")
    done: list[DataFrame] = []
    while edges.count() > small:
        waiting = edges.select(F.col("src").alias("id")).distinct()
        ready = materialize(todo.join(waiting, "id", "left_anti").select("id", (F.col("depth") + F.col("below")).alias("total")), "ready")
        got = edges.join(ready.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("total").alias("t"))
        done.append(ready)
        if len(done) > 12:
            done = [materialize(_union(done), "ready")]
        todo = materialize(todo.join(waiting, "id", "left_semi").join(got, "id", "left").select("id", "depth", F.greatest("below", F.coalesce("t", F.lit(0))).alias("below")), "todo")
        edges = materialize(edges.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e, n = pdf[pdf["edge"]], pdf[~pdf["edge"]]
        depth, total = dict(zip(n["a"], n["c"], strict=True)), dict(zip(n["a"], n["b"], strict=True))
        nodes, out = _numbered(e["a"].to_numpy(), e["b"].to_numpy())
        into: list[list[int]] = [[] for _ in nodes]
        for v, ws in enumerate(out):
            for w in ws:
                into[w].append(v)
        open_ = [len(x) for x in out]
        names, ready = nodes.tolist(), [v for v in range(len(nodes)) if not open_[v]]
        for v in ready:  # grows while it is walked
            here = total[names[v]] + depth[names[v]]
            for u in into[v]:
                total[names[u]] = max(total[names[u]], here)
                open_[u] -= 1
                if not open_[u]:
                    ready.append(u)
        return pd.DataFrame({"id": list(total), "total": [depth[i] + b for i, b in total.items()]})

    # nodes without an edge need no task of their own
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    free = todo.join(touched, "id", "left_anti").select("id", (F.col("depth") + F.col("below")).alias("total"))
    rows = edges.select(F.lit(True).alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("bigint").alias("c"))
    rows = rows.unionByName(todo.join(touched, "id", "left_semi").select(F.lit(False).alias("edge"), F.col("id").alias("a"), F.col("below").alias("b"), F.col("depth").cast("bigint").alias("c")))
    return _union([rows.groupBy().applyInPandas(run, "id bigint, total bigint"), free, *done])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
