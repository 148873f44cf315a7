"""Neighbourhoods, induced and boundary edges, degrees and summaries of a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import community_key, domain_key, graph_path, in_scope, is_test_path, language, qn_package, truthy
from skein.plans.graph import PropertyGraph, prop
from skein.session import materialize


def sides(g: PropertyGraph, *types: str) -> DataFrame:
    """Each edge from both of its ends: `anchor`, `other`, `side`, `edge_id`, `type`."""
    e = g.edges.where(F.col("type").isin(*types)) if types else g.edges
    end = lambda a, b, s: F.struct(F.col(a).alias("anchor"), F.col(b).alias("other"), F.lit(s).alias("side"))
    return e.select(F.col("id").alias("edge_id"), "type", F.explode(F.array(end("source_id", "target_id", "out"), end("target_id", "source_id", "in"))).alias("x")).select("x.*", "edge_id", "type")


def bulk_neighbors(g: PropertyGraph, anchors: DataFrame, keep: int, *types: str) -> DataFrame:
    """Up to `keep` neighbours per anchor of `anchors(anchor)` and direction, by edge id."""
    by = Window.partitionBy("anchor", "side").orderBy("edge_id")
    near = sides(g, *types).join(anchors.select("anchor").distinct(), "anchor", "left_semi").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)
    return near.join(g.nodes.select(F.col("id").alias("other"), "name", "label"), "other").select("anchor", "side", "rank", "edge_id", "type", "other", "name", "label")


def neighbor_names(g: PropertyGraph, keep: int = 10, types: tuple[str, ...] = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS")) -> DataFrame:
    """Per node and side the first `keep` distinct neighbour names, in order."""
    names = sides(g, *types).select("anchor", "side", "other").distinct().join(g.nodes.select(F.col("id").alias("other"), "name"), "other").select("anchor", "side", "name").distinct()
    by = Window.partitionBy("anchor", "side").orderBy("name")
    return names.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)


def neighborhood_page(g: PropertyGraph, node: int, cursor: int, size: int) -> DataFrame:
    """The edges at a node behind an edge id, a self-loop once."""
    at = g.edges.where((F.col("source_id") == node) | (F.col("target_id") == node))
    return at.where(F.col("id") > cursor).orderBy("id").limit(size)


def induced(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Edges with both ends in `members(id)`, one per (source, target, type): the smallest id."""
    m = members.select("id").distinct()
    e = g.edges.join(m.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(m.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.groupBy("source_id", "target_id", "type").agg(F.min("id").alias("id"))


def with_scopes(g: PropertyGraph) -> DataFrame:
    """(id, domain, community) of every node."""
    return g.nodes.select("id", domain_key(F.col("file_path"), F.col("label")).alias("domain"), community_key(F.col("file_path"), F.col("label")).alias("community"))


def boundary(g: PropertyGraph, scopes: DataFrame, scope: Column) -> DataFrame:
    """Edges with one end inside `scope`, counted by direction, type and the outer end's domain."""
    s = scopes.select("id", "domain", scope.alias("inside"))
    ends = g.edges.select("type", "source_id", "target_id")
    both = ends.join(s.withColumnsRenamed({"id": "source_id", "domain": "sd", "inside": "si"}), "source_id").join(s.withColumnsRenamed({"id": "target_id", "domain": "td", "inside": "ti"}), "target_id")
    return both.where(F.col("si") != F.col("ti")).groupBy(F.when(F.col("si"), "out").otherwise("in").alias("direction"), "type", F.when(F.col("si"), F.col("td")).otherwise(F.col("sd")).alias("external_domain")).agg(F.count(F.lit(1)).alias("n_edges"))


def domain_dependencies(g: PropertyGraph, selected: list[str] | None = None) -> DataFrame:
    """Edges by the domains of their ends; domains that are not selected fold to null."""
    s = with_scopes(g).select("id", (F.when(F.col("domain").isin(*selected), F.col("domain")) if selected else F.col("domain")).alias("d"))
    both = g.edges.join(s.select(F.col("id").alias("source_id"), F.col("d").alias("source_domain")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("d").alias("target_domain")), "target_id")
    return both.groupBy("source_domain", "target_domain").agg(F.count(F.lit(1)).alias("n_edges"))


def dependency_atlas(g: PropertyGraph, top: int = 12) -> DataFrame:
    """The `top` domains by nodes with their edge totals in, out and within."""
    s = with_scopes(g)
    size = s.groupBy("domain").agg(F.count(F.lit(1)).alias("n_nodes"))
    dep = domain_dependencies(g)
    inner = dep.where("source_domain = target_domain").select(F.col("source_domain").alias("domain"), F.col("n_edges").alias("within"))
    out = dep.where("source_domain <> target_domain").groupBy(F.col("source_domain").alias("domain")).agg(F.sum("n_edges").alias("going_out"))
    into = dep.where("source_domain <> target_domain").groupBy(F.col("target_domain").alias("domain")).agg(F.sum("n_edges").alias("coming_in"))
    joined = reduce(lambda a, b: a.join(b, "domain", "left"), [size, inner, out, into])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("within", "going_out", "coming_in")]
    return joined.select("domain", "n_nodes", *zero).orderBy(F.desc("n_nodes"), "domain").limit(top)


def counts_scoped(g: PropertyGraph, scope: str) -> DataFrame:
    """Nodes below a path and edges with both ends below it, in one row."""
    m = g.nodes.where(in_scope(graph_path(F.col("file_path")), scope)).select("id")
    e = g.edges.join(m.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(m.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return m.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("n_edges"))), F.lit(True))


def schema_keys(df: DataFrame, kind: str, keep: int = 50) -> DataFrame:
    """Per label or type the first `keep` JSON keys, with how many rows hold them."""
    keys = df.select(F.col(kind).alias("kind"), F.explode(F.array_distinct(F.json_object_keys("properties_json"))).alias("key")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("kind").orderBy("key")
    return keys.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep).select("kind", "key", "n")


def schema_samples(g: PropertyGraph, keep: int = 3) -> DataFrame:
    """(label, rank, id, name): the first nodes of each label, by id, as examples."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return g.nodes.select("label", "id", "name").withColumn("rank", rank).where(F.col("rank") <= keep)


def patterns(g: PropertyGraph) -> DataFrame:
    """How often each (label)-[type]->(label) occurs."""
    lab = g.nodes.select("id", "label")
    both = g.edges.join(lab.select(F.col("id").alias("source_id"), F.col("label").alias("a")), "source_id").join(lab.select(F.col("id").alias("target_id"), F.col("label").alias("b")), "target_id")
    counts = both.groupBy("a", "type", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.format_string("(%s)-[%s]->(%s)", "a", F.coalesce("type", F.lit("")), "b").alias("pattern"), "n")


def domains(g: PropertyGraph) -> DataFrame:
    """Per domain its nodes, files and a node that stands for it: the first file, else the first."""
    d = g.nodes.select("id", "label", domain_key(F.col("file_path"), F.col("label")).alias("domain"))
    file_id = F.when(F.col("label") == "File", F.col("id"))
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("node_count"), F.count(file_id).alias("file_count"), F.coalesce(F.min(file_id), F.min("id")).alias("representative_id"))


def languages(g: PropertyGraph, top: int = 10) -> DataFrame:
    files = g.nodes.where("label = 'File'").select(language(F.col("file_path")).alias("language")).where("language is not null")
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "language").limit(top)


def packages(g: PropertyGraph, top: int = 15) -> DataFrame:
    """Packages by their definitions: by Package nodes, whose folders hold the definitions, if the
    graph has any; else by the definitions' own qualified names."""
    nodes = g.nodes.where("label = 'Package' and name <> ''")
    if nodes.isEmpty():
        p = g.nodes.where(~F.col("label").isin("File", "Folder", "Package")).select(qn_package(F.col("qualified_name")).alias("package")).where("package <> ''")
        return p.groupBy("package").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "package").limit(top)
    held = g.edges.where(F.col("type").isin("CONTAINS", "DEFINES", "CONTAINS_PACKAGE")).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    one = nodes.join(held, "id", "left").groupBy(F.col("name").alias("package")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return one.orderBy(F.desc("n"), "package").limit(top)


def hotspots_calls(g: PropertyGraph, top: int = 10) -> DataFrame:
    """The functions and methods outside tests that are called most."""
    fan = g.calls.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    f = g.nodes.where(F.col("label").isin("Function", "Method") & ~is_test_path(F.col("file_path")))
    return fan.join(f.select("id", "name", "qualified_name"), "id").orderBy(F.desc("fan_in"), "id").limit(top)


def boundaries(g: PropertyGraph, top: int = 10) -> DataFrame:
    """The pairs of communities with most calls across."""
    s = with_scopes(g)
    both = g.calls.join(s.select(F.col("id").alias("source_id"), F.col("community").alias("source")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("community").alias("target")), "target_id")
    return both.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_calls")).orderBy(F.desc("n_calls"), "source", "target").limit(top)


def layers(g: PropertyGraph, top: int = 10) -> DataFrame:
    """A layer per community that takes part in the `top` boundaries, from its calls in and out;
    communities that hold routes are the api, and those of flagged entry points the entry, whatever
    their calls."""
    b = boundaries(g, top)
    io = b.select(F.explode(F.array(F.struct(F.col("source").alias("c"), F.lit(0).cast("bigint").alias("i"), F.col("n_calls").alias("o")), F.struct(F.col("target").alias("c"), F.col("n_calls").alias("i"), F.lit(0).cast("bigint").alias("o")))).alias("x")).select("x.*")
    t = io.groupBy(F.col("c").alias("community")).agg(F.sum("i").alias("calls_in"), F.sum("o").alias("calls_out"))
    flagged = g.nodes.where((F.col("label") == "Route") | truthy(prop("is_entry_point")) | truthy(prop("is_entry"))).select(community_key(F.col("file_path"), F.col("label")).alias("community"), (F.col("label") == "Route").alias("route"))
    marks = flagged.groupBy("community").agg(F.max("route").alias("route"), F.max(~F.col("route")).alias("start"))
    i, o = F.col("calls_in"), F.col("calls_out")
    layer = F.when(F.col("route"), "api").when(F.col("start"), "entry").when((i > o) & (i > 3), "core").when((o == 0) & (i > 0), "leaf").when((i == 0) & (o > 0), "entry").otherwise("internal")
    return t.join(marks, "community", "left").select("community", "calls_in", "calls_out", layer.alias("layer"))


def file_tree(g: PropertyGraph) -> DataFrame:
    """Every folder above a file, with its direct children and all files below."""
    p = g.nodes.where("label = 'File'").select(graph_path(F.col("file_path")).alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    up = p.select(parts.alias("a"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("n")).select(F.array_join(F.slice("a", 1, F.col("n")), "/").alias("folder"), F.col("a")[F.col("n")].alias("child"))
    one = up.groupBy("folder", "child").agg(F.count(F.lit(1)).alias("n"))  # a child before its files: a large folder is spread over its children
    return one.groupBy("folder").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n").alias("n_files"))


def entry_points(g: PropertyGraph, top: int = 20) -> DataFrame:
    """Where a program begins: callables outside tests that are flagged as entry points, first; then
    those that nothing calls and that call something, by how many calls they make."""
    d = g.degrees("CALLS")
    f = g.nodes.where(F.col("label").isin("Function", "Method") & ~is_test_path(F.col("file_path"))).join(d, "id", "left")
    f = f.withColumn("flagged", truthy(prop("is_entry_point")) | truthy(prop("is_entry"))).where("flagged or (in_degree = 0 and out_degree > 0)")
    return f.select("id", "name", "flagged", F.coalesce("out_degree", F.lit(0)).alias("out_degree")).orderBy(F.desc("flagged"), F.desc("out_degree"), "id").limit(top)


def routes(g: PropertyGraph, top: int = 20) -> DataFrame:
    """Routes outside tests with method and path, and how many handle or call them."""
    r = g.nodes.where((F.col("label") == "Route") & ~is_test_path(F.col("file_path")))
    n = g.edges.where(F.col("type").isin("HANDLES", "HTTP_CALLS", "ASYNC_CALLS")).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_uses"))
    return r.join(n, "id", "left").select("id", F.upper(prop("method")).alias("method"), F.coalesce(prop("path"), F.col("name")).alias("path"), F.coalesce("n_uses", F.lit(0)).alias("n_uses")).orderBy("path", "method", "id").limit(top)


def direct_callers(sites: DataFrame) -> DataFrame:
    """Call sites by callee, owner and file: how many, and the first line."""
    return sites.groupBy("target_id", "owner_qn", "file_path").agg(F.count(F.lit(1)).alias("n_calls"), F.min("line").alias("first_line"))


def callers_by_name(g: PropertyGraph, sites: DataFrame) -> DataFrame:
    """Per project and name of a callee: how many definitions bear it, how many owners and sites
    call any of them, and why a count by name is not certain: 'several_definitions', 'anonymous'
    (a site without an owner), else null."""
    named = g.nodes.where(F.col("label").isin("Function", "Method")).select(F.col("id").alias("target_id"), "project", "name")
    n = named.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n_definitions"))
    called = direct_callers(sites).join(named, "target_id").groupBy("project", "name").agg(F.sum("n_calls").alias("n_sites"), F.count_distinct("owner_qn", "file_path").alias("n_callers"), F.max(F.col("owner_qn").isNull()).alias("open"))
    reason = F.when(F.col("n_definitions") > 1, "several_definitions").when(F.col("open"), "anonymous")
    return called.join(n, ["project", "name"]).select("project", "name", "n_definitions", "n_callers", "n_sites", reason.alias("reason"))


def dead_code(g: PropertyGraph, top: int = 50) -> DataFrame:
    """Callables without a caller: tests last, exported ones last, then by id."""
    called = g.calls.select(F.col("target_id").alias("id")).distinct()
    f = g.nodes.where(F.col("label").isin("Function", "Method")).join(called, "id", "left_anti")
    return f.select("id", "name", is_test_path(F.col("file_path")).alias("is_test"), (truthy(prop("is_exported")) | truthy(prop("exported"))).alias("is_exported")).orderBy("is_test", "is_exported", "id").limit(top)


def top_ranked(g: PropertyGraph, label: str, top: int = 50) -> DataFrame:
    d = g.degrees().select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    f = g.nodes.where(F.col("label") == label).join(d, "id", "left")
    return f.select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def label_quota(g: PropertyGraph, size: int) -> DataFrame:
    """(place, label, id, degree, why): `size` nodes that stand for the graph, of all labels.

    Labels share `size` by water-filling: each gets an equal share, what small labels leave goes to
    the larger ones, an odd rest to the largest; within a label by degree. The labels are then put
    in turn, larger ones first. A twentieth of the places, 1 to 50, goes to callables that are
    dead, each in the place of the last of its label; and the first file of each domain that has
    nobody yet takes the place of the last node of a domain that has several. `why` is 'degree',
    'dead' or 'domain'. What is chosen is `size` rows, a setting; only they are looked at together.
    """
    counts = g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    by = Window.orderBy("n", "label")  # over label counts only
    c = counts.withColumn("pos", F.row_number().over(by)).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("below", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left, many = F.lit(size) - F.col("below"), F.col("k") - F.col("pos") + 1
    level = c.where(F.col("below") + F.col("n") * many >= size).orderBy("pos").limit(1).select(F.floor(left / many).cast("int").alias("level"), F.pmod(left, many).cast("int").alias("odd"), F.col("pos").alias("from"))
    largest = F.row_number().over(Window.orderBy(F.desc("n"), "label"))
    q = c.withColumn("large", largest).join(F.broadcast(level), F.lit(True), "left")
    quota = q.select("label", "large", F.when(F.col("level").isNull() | (F.col("pos") < F.col("from")), F.col("n")).otherwise(F.col("level") + (F.col("large") <= F.col("odd")).cast("int")).alias("quota"))
    d = g.degrees().select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"), "in_degree")
    calls = g.degrees("CALLS").select("id", F.col("in_degree").alias("calls_in"))
    n = g.nodes.select("id", "label", "file_path", domain_key(F.col("file_path"), F.col("label")).alias("domain"), (truthy(prop("is_exported")) | truthy(prop("exported")) | truthy(prop("is_entry_point"))).alias("open")).join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("degree"), "id"))
    picked = n.withColumn("rank", rank).where(F.col("rank") <= size).join(F.broadcast(quota), "label").where("rank <= quota")
    chosen = materialize(picked.withColumn("place", F.row_number().over(Window.orderBy("rank", "large"))).select("place", "label", "domain", "id", "degree", F.lit("degree").alias("why")), "chosen")
    reserve = min(50, max(1, size // 20))
    dead = n.where(F.col("label").isin("Function", "Method") & ~F.col("open") & ~is_test_path(F.col("file_path"))).join(calls.where("calls_in > 0"), "id", "left_anti")
    dead = dead.join(chosen.select("id"), "id", "left_anti").orderBy("id").limit(reserve).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id")))
    last = chosen.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("place"))))
    swap = last.select("label", "r", "place").join(dead.select("label", "r", "domain", "id", "degree"), ["label", "r"]).select("place", "label", "domain", "id", "degree", F.lit("dead").alias("why"))
    chosen = materialize(chosen.join(swap.select("place"), "place", "left_anti").unionByName(swap), "chosen")
    first = n.where("label = 'File'").groupBy("domain").agg(F.min_by(F.struct("label", "domain", "id", "degree"), "id").alias("f")).select("f.*")
    missing = first.join(chosen.select("domain").distinct(), "domain", "left_anti").withColumn("r", F.row_number().over(Window.orderBy("domain")))
    spare = chosen.where("why = 'degree'").withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("place"))).where("k > 1").withColumn("r", F.row_number().over(Window.orderBy(F.desc("place"))))
    swap = spare.select("r", "place").join(missing, "r").select("place", "label", "domain", "id", "degree", F.lit("domain").alias("why"))
    return chosen.join(swap.select("place"), "place", "left_anti").unionByName(swap).select("place", "label", "id", "degree", "why")


def edge_pages(g: PropertyGraph, size: int) -> DataFrame:
    """Nodes in pages of `size` by id, per project, and every edge on the page of its later end, so
    that pages put together hold each edge once."""
    # numbered within ranges of 100,000 ids, behind the counts of the ranges before: no task sorts
    # all nodes of a project
    n = g.nodes.where("project is not null").select("id", F.col("project").alias("scope"), F.floor(F.col("id") / 100_000).alias("range"))
    ranges = n.groupBy("scope", "range").agg(F.count(F.lit(1)).alias("c"))
    ranges = ranges.withColumn("before", F.sum("c").over(Window.partitionBy("scope").orderBy("range")) - F.col("c")).drop("c")
    at = n.join(ranges, ["scope", "range"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("scope", "range").orderBy("id")) - 1)
    pages = at.select("id", "scope", F.floor(F.col("place") / size).alias("page"))
    e = g.edges.join(pages.select(F.col("id").alias("source_id"), "scope", F.col("page").alias("ps")), "source_id").join(pages.select(F.col("id").alias("target_id"), F.col("scope").alias("scope_t"), F.col("page").alias("pt")), "target_id")
    n = pages.groupBy("scope", "page").agg(F.count(F.lit(1)).alias("n_nodes"))
    m = e.where("scope = scope_t").groupBy("scope", F.greatest("ps", "pt").alias("page")).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(m, ["scope", "page"], "left").select("scope", "page", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
