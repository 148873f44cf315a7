"""Reachability, shortest paths, impact, call chains and nesting depth over a property graph.

Frontiers grow level by level; each level is one join of the last frontier with the edges and one
anti-join with what is known. Walks of a few hops are one plan, whose levels share their exchanges;
longer ones cut each level by a written table. A level's rows are distinct nodes, so work follows
the part of the graph that is reached, and cycles end by themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import hop_risk, is_test_path
from skein.operators.cycles import SMALL, connected, longest, strong_components
from skein.plans.graph import PropertyGraph, prop
from skein.session import materialize, release


def links(g: PropertyGraph, *types: str, direction: str = "out") -> DataFrame:
    """(src, dst): distinct edges of `types`, turned as asked; 'both' has either turn."""
    e = g.edges.where(F.col("type").isin(*types)) if types else g.edges
    out = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()


#: Walks of at most so many hops are one plan.
_FEW_HOPS = 3


def _levels(first: DataFrame, steps: DataFrame, key: list[str], max_hops: int | None) -> DataFrame:
    """(*key, node, hop) of all that is reached from `first(*key, at)`, at its least hop."""
    frontier, found = first, []
    if max_hops is not None and max_hops <= _FEW_HOPS:
        for hop in range(1, max_hops + 1):
            new = frontier.join(steps, frontier["at"] == steps["src"]).select(*key, F.col("dst").alias("node")).distinct()
            found.append(new.withColumn("hop", F.lit(hop)))
            frontier = new.withColumnRenamed("node", "at")
        if found:
            return reduce(DataFrame.unionByName, found).groupBy(*key, "node").agg(F.min("hop").alias("hop"))
    steps = materialize(steps, "steps")
    hop, known = 0, None
    while max_hops is None or hop < max_hops:
        hop += 1
        new = frontier.join(steps, frontier["at"] == steps["src"]).select(*key, F.col("dst").alias("node")).distinct()
        if known is not None:
            new = new.join(known.select(*key, "node"), [*key, "node"], "left_anti")
        new = materialize(new, "frontier")
        if new.isEmpty():
            break
        found.append(new.withColumn("hop", F.lit(hop)))
        if len(found) > 16:  # keeps the union of levels short, however long the walk
            found = [materialize(reduce(DataFrame.unionByName, found), "reached")]
        known = reduce(DataFrame.unionByName, found)
        frontier = new.withColumnRenamed("node", "at")
    return known if known is not None else first.select(*key, F.col("at").alias("node"), F.lit(0).alias("hop")).where(F.lit(False))


def min_hops(starts: DataFrame, steps: DataFrame, max_hops: int | None) -> DataFrame:
    """(start, node, hop): the fewest hops, 1 to `max_hops`, from each of `starts(node)` to every
    node it reaches by `steps(src, dst)`; a start reaches itself only over a cycle. Without
    `max_hops` the walk ends when nothing is new."""
    first = starts.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct()
    return _levels(first, steps, ["start"], max_hops)


def least_hops(starts: DataFrame, steps: DataFrame, max_hops: int | None) -> DataFrame:
    """(node, hop): as `min_hops`, from the nearest of all starts: one frontier for all of them, so
    the work follows what is reached, not the number of starts."""
    return _levels(starts.select(F.col("node").alias("at")).distinct(), steps, [], max_hops)


def bfs(g: PropertyGraph, starts: DataFrame, types: tuple[str, ...] = ("CALLS",), max_hops: int = 3, direction: str = "out") -> DataFrame:
    """`min_hops` with the nodes' names and labels; ids without a node are passed through, not
    reported."""
    hops = min_hops(starts, links(g, *types, direction=direction), max_hops)
    return hops.join(g.nodes.select(F.col("id").alias("node"), "name", "label", "file_path"), "node")


def bfs_edges(g: PropertyGraph, starts: DataFrame, types: tuple[str, ...] = ("CALLS",), max_hops: int = 3, direction: str = "out") -> DataFrame:
    """The edges of `types` among the starts and all that they reach: id, ends, type, and the
    confidence in the edge's properties."""
    near = least_hops(starts, links(g, *types, direction=direction), max_hops).select("node").union(starts.select("node")).distinct()
    e = g.edges.where(F.col("type").isin(*types))
    inner = e.join(near.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("node", "target_id"), "target_id", "left_semi")
    return inner.select("id", "source_id", "target_id", "type", prop("confidence").try_cast("double").alias("confidence"))


#: The edge types that the modes of a trace follow (fixed values).
TRACE_MODES = {
    "calls": ("CALLS",),
    "data_flow": ("CALLS", "DATA_FLOWS", "READS", "WRITES"),
    "cross_service": ("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "EMITS", "LISTENS_ON", "HANDLES"),
}


def trace(g: PropertyGraph, name: str, mode: str = "calls", direction: str = "both", max_hops: int = 3, tests: bool = False) -> DataFrame:
    """What a symbol reaches and what reaches it, with a risk by distance. The symbol is found by
    name, or by qualified name if no name fits; of several the smallest id is traced, and
    `n_candidates` tells how many there are."""
    named = g.nodes.where(F.col("name") == name)
    if named.isEmpty():
        named = g.nodes.where(F.col("qualified_name") == name)
    pick = named.agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n_candidates"))
    parts = []
    for d in ("out", "in") if direction == "both" else (direction,):
        hit = bfs(g, pick.where("node is not null").select("node"), TRACE_MODES[mode], max_hops, d)
        parts.append(hit.withColumn("direction", F.lit(d)))
    out = reduce(DataFrame.unionByName, parts)
    if not tests:
        out = out.where(~is_test_path(F.col("file_path")))
    return out.join(F.broadcast(pick.select("n_candidates")), F.lit(True)).select("direction", "node", "name", "label", "hop", hop_risk(F.col("hop")).alias("risk"), "n_candidates")


def trace_suggestions(g: PropertyGraph, name: str, top: int = 10) -> DataFrame:
    """What a trace might have meant by a name: the symbols that bear it, or, if none does, those
    whose names hold its first half in any letter case; by id."""
    exact = g.nodes.where((F.col("name") == name) | (F.col("qualified_name") == name))
    found = exact if not exact.isEmpty() else g.nodes.where(F.lower("name").contains(name[: max(3, len(name) // 2)].lower()))
    return found.select("id", "name", "qualified_name", "label", "file_path").orderBy("id").limit(top)


def trace_calls(g: PropertyGraph, name: str, direction: str = "out", max_hops: int = 3) -> DataFrame:
    """(hop, source_id, target_id, line, args) of the calls a trace goes over: for each, the hop of
    its far end, its line and how many arguments it passes, as its properties tell."""
    named = g.nodes.where((F.col("name") == name) | (F.col("qualified_name") == name)).agg(F.min("id").alias("node")).where("node is not null")
    near = materialize(least_hops(named, links(g, "CALLS", direction=direction), max_hops).unionByName(named.withColumn("hop", F.lit(0))).groupBy("node").agg(F.min("hop").alias("hop")), "hops")
    a, b = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    e = g.calls.join(near.toDF(a, "from_hop"), a).join(near.toDF(b, "hop"), b).where("hop = from_hop + 1")
    return e.select("hop", "source_id", "target_id", prop("line").try_cast("int").alias("line"), prop("arg_count").try_cast("int").alias("args"))


def impact(g: PropertyGraph, changed: DataFrame, max_hops: int = 4) -> DataFrame:
    """Of changed files (`project`, `file_path`): the callers of their symbols, by fewest hops, in
    risk groups."""
    symbols = g.nodes.where(~F.col("label").isin("File", "Folder")).join(changed.distinct(), ["project", "file_path"], "left_semi").select(F.col("id").alias("node"))
    symbols = materialize(symbols, "changed")
    hops = least_hops(symbols, links(g, "CALLS", direction="in"), max_hops)
    least = hops.join(symbols, "node", "left_anti").join(g.nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return least.groupBy(hop_risk(F.col("hop")).alias("risk")).agg(F.count(F.lit(1)).alias("n_symbols"), F.min("hop").alias("nearest"))


def shortest_path(g: PropertyGraph, source: int, target: int, max_hops: int = 6) -> tuple[DataFrame, DataFrame]:
    """One shortest path, edges taken in either direction, and how the search went.

    The path: `position`, `node`, `edge_id`. Of all edges that lead to a node from the level before
    it the one with the smallest id is taken, seen from the target, so the path is the same on
    every run; from a node to itself it is one row. The second table is one row: `status` ('found',
    'not_found' if everything that can be reached was seen, 'max_hops' if not), `hops` and
    `visited_nodes`. An end that is no node gives a path without rows and the status 'no_node'.

    The search grows from both ends, the smaller frontier first, so it sees two small balls rather
    than one large one.
    """
    spark = g.nodes.sparkSession
    told = lambda status, hops, n: spark.createDataFrame([(status, hops, n)], "status string, hops int, visited_nodes bigint")
    none = spark.createDataFrame([], "position int, node bigint, edge_id bigint")
    one = lambda n: spark.createDataFrame([(n,)], "node bigint")
    if g.nodes.where(F.col("id").isin(source, target)).count() < len({source, target}):
        return none, told("no_node", None, 0)
    if source == target:
        return one(source).select(F.lit(0).alias("position"), "node", F.lit(None).cast("bigint").alias("edge_id")), told("found", 0, 1)
    ends = F.array(F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst")))
    both = g.edges.where("source_id <> target_id").select(F.col("id").alias("edge_id"), F.explode(ends).alias("x")).select("edge_id", "x.src", "x.dst")
    sides = {"s": [one(source)], "t": [one(target)]}
    known = {k: v[0] for k, v in sides.items()}
    size, seen, met = {"s": 1, "t": 1}, 2, False
    while not met and sum(map(len, sides.values())) - 2 < max_hops:
        k, o = ("s", "t") if size["s"] <= size["t"] else ("t", "s")
        few = F.broadcast if size[k] < 100_000 else (lambda df: df)
        step = both.join(few(sides[k][-1].select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        far = sides[o][-1].select("node", F.lit(True).alias("met"))
        level = materialize(step.join(known[k], "node", "left_anti").join(far, "node", "left").select("node", F.coalesce("met", F.lit(False)).alias("met")), "level")
        told_ = level.agg(F.count(F.lit(1)).alias("n"), F.max("met").alias("met")).first()
        size[k], met = told_["n"], bool(told_["met"])
        seen += size[k]
        if not size[k]:
            return none, told("not_found", None, seen)
        known[k] = known[k].unionByName(level.select("node"))
        sides[k].append(level)
    if not met:
        return none, told("max_hops", None, seen)
    meeting = sides[k][-1].where("met").select("node")
    hops = sum(map(len, sides.values())) - 2
    # the nodes of each level from the source; on the target's side those that lead to the meeting
    at = [level.select("node") for level in sides["s"][:-1]] + [meeting]
    for level in reversed(sides["t"][:-1]):
        at.append(level.select("node").join(both.join(at[-1].select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")), "node", "left_semi"))
    depths = reduce(DataFrame.unionByName, [df.select("node", F.lit(i).alias("depth")) for i, df in enumerate(at)])
    a, b = depths.toDF("src", "da"), depths.toDF("dst", "db")
    parent = materialize(both.join(a, "src").join(b, "dst").where("da = db - 1").groupBy("dst").agg(F.min(F.struct("edge_id", "src")).alias("m")).select(F.col("dst").alias("node"), "m.edge_id", "m.src"), "parents")
    here, rows = one(target), []
    for i in range(hops, 0, -1):  # as many steps as the path has, in one plan
        hit = parent.join(F.broadcast(here), "node")
        rows.append(hit.select(F.lit(i).alias("position"), "node", "edge_id"))
        here = hit.select(F.col("src").alias("node"))
    rows.append(one(source).select(F.lit(0).alias("position"), "node", F.lit(None).cast("bigint").alias("edge_id")))
    return reduce(DataFrame.unionByName, rows), told("found", hops, seen)


def callers_multi(g: PropertyGraph, targets: DataFrame, max_hops: int = 8) -> tuple[DataFrame, DataFrame]:
    """Every caller of `targets(node)` over up to `max_hops` calls with its least depth; and one
    row that tells whether these are all: `complete`, `n_callers`, `n_open` (callers of the last
    level that are called by others not seen) and `reason` ('max_hops', else null)."""
    back = materialize(links(g, "CALLS", direction="in"), "calls")
    least = materialize(least_hops(targets, back, max_hops), "callers")
    last = least.where(F.col("hop") == max_hops).select(F.col("node").alias("src"))
    known = least.select("node").union(targets.select("node")).distinct()
    further = back.join(last, "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").agg(F.count_distinct("src").alias("n_open"))
    done = least.agg(F.count(F.lit(1)).alias("n_callers")).join(F.broadcast(further), F.lit(True))
    state = done.select((F.col("n_open") == 0).alias("complete"), "n_callers", "n_open", F.when(F.col("n_open") > 0, "max_hops").alias("reason"))
    named = least.withColumnRenamed("hop", "depth").join(g.nodes.select(F.col("id").alias("node"), "name", "file_path", "start_line"), "node")
    return named, state


def type_dependents(g: PropertyGraph, types: DataFrame) -> DataFrame:
    """Files that refer, directly or over other types, to one of `types(node)`; the walk ends when
    nothing is new."""
    refs = materialize(links(g, "USAGE", "INHERITS", "IMPLEMENTS", direction="in"), "refs")
    users = least_hops(types, refs, None).select(F.col("node").alias("id"))
    return g.nodes.join(users, "id", "left_semi").groupBy("project", "file_path").agg(F.count(F.lit(1)).alias("n_symbols"))


def call_chains(g: PropertyGraph, starts: DataFrame, targets: DataFrame, max_hops: int = 8, keep: int = 5, width: int = 500) -> DataFrame:
    """The `keep` shortest call chains from `starts(node)` to the first of `targets(node)` they
    meet, without repeated nodes, by length and nodes.

    For each length the nodes are known from which a target is that many calls away, so only open
    paths that can end in time are followed. The `width` first of them, by their nodes, are enough
    if they lead to as many chains as are wanted, since all that comes from others is later; else
    the level is searched again with eight times as many, until there are enough or none is left out.
    """
    steps = materialize(links(g, "CALLS").where("src <> dst"), "steps")
    ends = targets.select("node").distinct()
    away = [materialize(ends, "away")]
    found: list[DataFrame] = []
    need = keep
    for hops in range(max_hops + 1):
        if hops:
            back = steps.join(away[-1].select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            away.append(materialize(back.join(away[0], "node", "left_anti"), "away"))
        begin = starts.select("node").distinct().join(away[hops], "node", "left_semi").select(F.array("node").alias("path"), F.col("node").alias("end"))
        most = max(width, need)
        while True:
            at, cut = materialize(begin.orderBy("path").limit(need), "paths") if hops == 0 else begin, False
            for left in range(hops - 1, -1, -1):
                more = at.join(steps, at["end"] == steps["src"]).where(~F.expr("array_contains(path, dst)")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
                more = more.join(away[left].select(F.col("node").alias("end")), "end", "left_semi").select("path", "end")
                at = materialize(more.orderBy("path").limit(most + 1), "paths")
                if at.count() > most:
                    at, cut = at.orderBy("path").limit(most), True
            n = at.count()
            if not cut or n >= need:
                break
            most *= 8
        found.append(at.select("path", F.lit(hops).alias("hops")))
        need -= n
        if need <= 0 or away[hops].isEmpty():
            break
    return reduce(DataFrame.unionByName, found).orderBy("hops", "path").limit(keep)


def components(steps: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component): connected components of `steps(src, dst)`, by hooking every node to the
    least label around it and halving label chains each round, until nothing changes; the
    component is its least node. Up to `small` steps are one task, with the same result."""
    steps = materialize(steps.select("src", "dst").distinct(), "steps")
    kind = dict(steps.dtypes)["src"]
    if steps.count() <= small:

        def run(pdf):
            nodes, part = connected(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
            return pdf.iloc[:0].reindex(range(len(nodes))).assign(node=nodes, component=part)[["node", "component"]]

        return steps.groupBy().applyInPandas(run, f"node {kind}, component {kind}")
    both = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both, "both")
    lab = materialize(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    last = None
    while True:
        near = both.join(lab.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        hooked = lab.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("c", "component")).alias("to"))
        jump = lab.select(F.col("node").alias("to"), F.col("component").alias("root"))
        new = materialize(hooked.join(jump, "to", "left").select("node", F.least("to", F.coalesce("root", "to")).alias("component"), F.col("component").alias("was")), "labels")
        lab = new.select("node", "component")
        release(last)
        last = new
        if new.where("component <> was").isEmpty():
            return lab


def loop_depth(g: PropertyGraph, own: DataFrame, small: int = SMALL) -> DataFrame:
    """Transitive loop depth: a function's own depth (`own(id, depth)`) plus the largest of what
    it calls. Calls inside a cycle add nothing, and functions on a cycle, of one call or more, are
    `recursive`; functions that only lead to a cycle are not."""
    calls = links(g, "CALLS")
    selfs = calls.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loops"))
    ids = own.select("id")
    calls = calls.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    calls = materialize(calls.select("src", "dst"), "calls")
    rings = materialize(strong_components(calls, small), "rings")
    ring = lambda x: rings.toDF(x, f"r_{x}")
    across = calls.join(ring("src"), "src", "left").join(ring("dst"), "dst", "left").where("not coalesce(r_src = r_dst, false)").select("src", "dst")
    total = longest(own, materialize(across, "across"), small)
    out = total.join(selfs, "id", "left").join(rings.select(F.col("node").alias("id"), F.lit(True).alias("ring")), "id", "left")
    return out.select("id", "total", F.coalesce("loops", "ring", F.lit(False)).alias("recursive"))
