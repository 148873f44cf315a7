"""Edges and facts derived from definitions, imports, calls, histories and configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import graph_path, is_test_file, is_test_name, route_path, sounds_like_test
from skein.plans.graph import PropertyGraph, prop
from skein.session import materialize

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Source endings behind the emitted ones that an import may name (fixed values).
EMITTED = {".js": (".ts", ".tsx", ".d.ts", ".jsx"), ".jsx": (".tsx", ".d.ts"), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}


def normal_path(folder: Column, relative: Column) -> Column:
    """A relative path put behind a folder, with `.` and `..` resolved; null if it leaves the top."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok")),
        lambda acc, p: F.when(p == "..", F.struct(F.slice(acc["a"], 1, F.greatest(F.size(acc["a"]) - 1, F.lit(0))).alias("a"), (acc["ok"] & (F.size(acc["a"]) > 0)).alias("ok"))).otherwise(
            F.struct(F.concat(acc["a"], F.array(p)).alias("a"), acc["ok"].alias("ok"))
        ),
    )
    return F.when(walked["ok"], F.array_join(walked["a"], "/"))


def module_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`imports(project, file_path, source_module)` with `resolved`, the file of `files(project,
    file_path)` that a relative specifier names: the path itself, then the sources of an emitted
    ending, then known endings, then an index file. Others have null. The candidates are listed in
    order and joined at once; the first that exists wins."""
    folder = F.regexp_replace(graph_path(F.col("file_path")), r"(^|/)[^/]*$", "")
    base = F.when(F.col("source_module").startswith("."), normal_path(folder, F.regexp_replace("source_module", r"\\", "/")))
    ext = F.regexp_extract("base", r"(\.[^./]+)$", 1)
    stem = F.regexp_replace("base", r"\.[^./]+$", "")
    tables = [F.when(ext == e, F.array(*[F.concat(stem, F.lit(x)) for x in subs])) for e, subs in EMITTED.items()]
    none = F.array().cast("array<string>")
    wanted = F.concat(F.array("base"), F.coalesce(*tables, none), F.array(*[F.concat("base", F.lit(x)) for x in EXTENSIONS]), F.array(*[F.concat("base", F.lit("/index" + x)) for x in EXTENSIONS]))
    every = imports.select("project", "file_path", "source_module").distinct().withColumn("base", base)
    asked = every.where("base is not null").select("project", "file_path", "source_module", F.posexplode(wanted).alias("rank", "candidate"))
    known = files.select("project", graph_path(F.col("file_path")).alias("candidate"), F.col("file_path").alias("found")).groupBy("project", "candidate").agg(F.min("found").alias("found"))
    best = asked.join(known, ["project", "candidate"]).groupBy("project", "file_path", "source_module").agg(F.min_by("found", "rank").alias("resolved"))
    return every.drop("base").join(best, ["project", "file_path", "source_module"], "left")


def resolve_exports(exports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the names of `wanted(file_path, name)` are defined: `status` resolved, ambiguous,
    missing or unknown, and `target_file`, `target_name` if resolved.

    `exports(file_path, exported_name, local_name, imported_name, source_file, export_kind)` lists
    local exports (no source), renamed re-exports, and `export *` (kind star_re_export, null name);
    `source_file` is the resolved module, null where a re-export's module isn't known. A module
    with two local exports of one name is invalid: its names are ambiguous. `default` never passes
    a star; an explicit export hides what stars would bring. Rounds follow re-exports until nothing
    is new, however long the way; a cycle adds nothing.
    """
    local = exports.where(F.col("export_kind").isin("local_named", "local_alias", "type_only_default", "local_default"))
    twice = local.groupBy("file_path", "exported_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file_path").distinct()
    open_ = wanted.select(F.col("file_path").alias("want_file"), F.col("name").alias("want_name"), F.col("file_path").alias("at_file"), F.col("name").alias("at_name")).distinct()
    ends: list[DataFrame] = []
    seen = open_
    ask = ["want_file", "want_name"]
    while True:
        bad = open_.join(twice.select(F.col("file_path").alias("at_file")), "at_file", "left_semi")
        ends.append(bad.select(*ask, F.lit("ambiguous").alias("s"), F.lit(None).cast("string").alias("tf"), F.lit(None).cast("string").alias("tn")))
        good = open_.join(twice.select(F.col("file_path").alias("at_file")), "at_file", "left_anti")
        hit = good.join(exports.where("export_kind <> 'star_re_export'").select(F.col("file_path").alias("at_file"), F.col("exported_name").alias("at_name"), "local_name", "imported_name", "source_file", "export_kind"), ["at_file", "at_name"])
        here = hit.where(~F.col("export_kind").startswith("re_export"))
        ends.append(here.select(*ask, F.lit("resolved").alias("s"), F.col("at_file").alias("tf"), F.coalesce("local_name", "at_name").alias("tn")))
        ends.append(hit.where(F.col("export_kind").startswith("re_export") & F.col("source_file").isNull()).select(*ask, F.lit("unknown").alias("s"), F.lit(None).cast("string").alias("tf"), F.lit(None).cast("string").alias("tn")))
        on = hit.where(F.col("export_kind").startswith("re_export") & F.col("source_file").isNotNull()).select(*ask, F.col("source_file").alias("at_file"), F.coalesce("imported_name", "at_name").alias("at_name"))
        rest = good.join(hit.select("at_file", "at_name").distinct(), ["at_file", "at_name"], "left_anti").where("at_name <> 'default'")
        stars = rest.join(exports.where("export_kind = 'star_re_export'").select(F.col("file_path").alias("at_file"), "source_file"), "at_file")
        ends.append(stars.where("source_file is null").select(*ask, F.lit("unknown").alias("s"), F.lit(None).cast("string").alias("tf"), F.lit(None).cast("string").alias("tn")))
        on = on.unionByName(stars.where("source_file is not null").select(*ask, F.col("source_file").alias("at_file"), "at_name")).distinct()
        open_ = materialize(on.join(seen, [*ask, "at_file", "at_name"], "left_anti"), "exports")
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_)
    every = reduce(DataFrame.unionByName, ends)
    got = every.groupBy(*ask).agg(
        F.max((F.col("s") == "ambiguous").cast("int")).alias("amb"), F.max((F.col("s") == "unknown").cast("int")).alias("unk"),
        F.collect_set(F.when(F.col("s") == "resolved", F.struct("tf", "tn"))).alias("t"),
    )
    n = F.size(F.coalesce("t", F.array()))
    status = F.when((F.col("amb") == 1) | (n > 1), "ambiguous").when(F.col("unk") == 1, "unknown").when(n == 1, "resolved").otherwise("missing")
    out = wanted.select(F.col("file_path").alias("want_file"), F.col("name").alias("want_name")).distinct().join(got, ask, "left")
    one = F.when(status == "resolved", F.col("t")[0])
    return out.select(F.col("want_file").alias("file_path"), F.col("want_name").alias("name"), status.alias("status"), one["tf"].alias("target_file"), one["tn"].alias("target_name"))


#: How much each way of resolving a call is trusted (fixed values).
CONFIDENCE = {"import_map": 0.95, "import_map_suffix": 0.85, "same_module": 0.90, "unique_name": 0.75, "qualified_tail": 0.90, "suffix_match": 0.55, "fuzzy": 0.40, "fuzzy_many": 0.30}
_WAYS = tuple(CONFIDENCE)


def resolve_calls(sites: DataFrame, defs: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """The definition each call site means: `sites(site_id, project, file_path, callee)`, `defs(id,
    project, file_path, name, qualified_name)`, `imports(project, file_path, local_name,
    target_id)`; a callee is a name or names joined by dots.

    The first way that finds one decides: the file's imports by the whole callee; what an import
    of its first name's file defines under its last; the same file; a name that is unique in the
    project; the only definition whose qualified name ends with the whole callee; of several, the
    one with the longest common folders, tests behind all others; and the same without letter
    case, one or several. Confidence shrinks with the number of candidates beyond three. Candidates
    of a name are counted before they are joined; a name with very many definitions is resolved
    from one row per (project, folder, name). Sites of unknown names get no row.
    """
    last = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    sites = sites.select("site_id", "project", "file_path", "callee", last(F.col("callee")).alias("last"))
    d = defs.select("id", "project", "file_path", F.col("name").alias("last"), "qualified_name")
    one = F.lit(1).cast("bigint")
    found = []
    told = lambda df, way, n=one: found.append(df.select("site_id", "id", F.lit(way).alias("strategy"), F.lit(_WAYS.index(way)).alias("o"), n.alias("n")))
    if imports is not None:
        i = imports.groupBy("project", "file_path", "local_name").agg(F.min("target_id").alias("id"))
        told(sites.join(i.withColumnRenamed("local_name", "callee"), ["project", "file_path", "callee"]), "import_map")
        at = i.join(d.select("id", F.col("file_path").alias("module")), "id").select("project", "file_path", F.col("local_name").alias("head"), "module")
        inside = d.groupBy("project", F.col("file_path").alias("module"), "last").agg(F.min("id").alias("id"))
        far = sites.where("contains(callee, '.')").withColumn("head", F.substring_index("callee", ".", 1)).join(at, ["project", "file_path", "head"])
        told(far.join(inside, ["project", "module", "last"]).groupBy("site_id").agg(F.min("id").alias("id")), "import_map_suffix")
    same = d.groupBy("project", "file_path", "last").agg(F.min("id").alias("id"))
    told(sites.join(same, ["project", "file_path", "last"]), "same_module")
    names = d.groupBy("project", "last").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    by_name = sites.join(names, ["project", "last"])
    told(by_name.where("n = 1"), "unique_name")
    tails = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.size("parts") - k + 1, k), "."))
    ends = d.withColumn("parts", F.split(F.regexp_replace("qualified_name", "::", "."), r"\.")).where(F.size("parts") > 1)
    ends = ends.select("id", "project", F.explode(tails).alias("callee")).groupBy("project", "callee").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    told(sites.where("contains(callee, '.')").join(ends, ["project", "callee"]), "qualified_tail")
    folder = F.regexp_replace(graph_path(F.col("file_path")), r"(^|/)[^/]*$", "")
    up = lambda df: df.withColumn("parts", F.split(folder, "/")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts")))).withColumn("above", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    heads = up(d.withColumn("test", sounds_like_test(F.col("qualified_name")).cast("int"))).groupBy("project", "last", "depth", "above").agg(F.min(F.struct("test", "id")).alias("h"))
    many = by_name.where("n > 1").select("site_id", "project", "file_path", "last", "n")
    deep = up(many).join(heads, ["project", "last", "depth", "above"]).groupBy("site_id", "n").agg(F.max(F.struct((1 - F.col("h.test")).alias("plain"), "depth", (-F.col("h.id")).alias("i"))).alias("b"))
    told(deep.select("site_id", (-F.col("b.i")).alias("id"), "n"), "suffix_match", F.col("n"))
    loose = d.groupBy("project", F.lower("last").alias("last")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    by_loose = sites.withColumn("last", F.lower("last")).join(loose, ["project", "last"])
    told(by_loose.where("n = 1"), "fuzzy")
    told(by_loose.where("n > 1"), "fuzzy_many", F.col("n"))
    best = reduce(DataFrame.unionByName, found).groupBy("site_id").agg(F.min(F.struct("o", "strategy", "id", "n")).alias("b")).select("site_id", "b.id", "b.strategy", "b.n")
    base = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("strategy")]
    return best.select("site_id", "id", "strategy", F.round(base * F.least(F.lit(1.0), 3.0 / F.col("n")), 6).alias("confidence"))


def tests_edges(g: PropertyGraph) -> DataFrame:
    """(source_id, target_id): a call from a test, by its path or name, to what is no test."""
    n = g.nodes.select("id", "name", "file_path")
    t = is_test_file(F.col("file_path"))
    callers = n.where(t | is_test_name(F.col("name"))).select(F.col("id").alias("source_id"))
    callees = n.where(~t & ~is_test_name(F.col("name"))).select(F.col("id").alias("target_id"))
    return g.calls.select("source_id", "target_id").distinct().join(callers, "source_id", "left_semi").join(callees, "target_id", "left_semi")


def tests_files(files: DataFrame) -> DataFrame:
    """(test_path, tested_path): a test file and the file of the same folder and stem without the
    test mark."""
    p = files.select("project", graph_path(F.col("file_path")).alias("path")).distinct()
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.(test|spec)(\.\w+)$", "$2"), r"_test(\.\w+)$", "$1"), r"(^|/)test_([^/]+)$", "$1$2")
    t = p.where(is_test_file(F.col("path"))).select("project", F.col("path").alias("test_path"), plain.alias("path")).where("test_path <> path")
    return t.join(p, ["project", "path"]).select("project", "test_path", F.col("path").alias("tested_path"))


def structure(files: DataFrame) -> DataFrame:
    """(project, parent, child, kind) of the folder tree above the files; the top is ''."""
    p = files.select("project", graph_path(F.col("file_path")).alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    rows = p.select("project", parts.alias("a"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    kind = F.when(F.col("n") == F.size("a"), "CONTAINS_FILE").otherwise("CONTAINS_FOLDER")
    return rows.select("project", F.array_join(F.slice("a", 1, F.col("n") - 1), "/").alias("parent"), F.array_join(F.slice("a", 1, F.col("n")), "/").alias("child"), kind.alias("kind")).distinct()


def shared_tags(items: DataFrame, least: int = 2) -> DataFrame:
    """(id, tags): of `items(id, words)` the words that at least `least` items have, sorted."""
    w = items.select("id", F.explode(F.array_distinct("words")).alias("word"))
    common = w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return w.join(common, "word", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("tags"))


def coupling(commits: DataFrame, most_files: int = 20, least: int = 3, score: float = 0.3) -> DataFrame:
    """Files that change together: `commits(commit, file, at)`. Commits of more than `most_files`
    files say nothing and are skipped, so a commit gives a bounded number of pairs. A pair needs
    `least` common commits and `score`, their share of the rarer file's commits."""
    one = commits.groupBy("commit", "file").agg(F.max("at").alias("at"))
    small = one.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files).select("commit")
    kept = one.join(small, "commit", "left_semi")
    files = kept.groupBy("commit").agg(F.sort_array(F.collect_set("file")).alias("fs"), F.max("at").alias("at"))
    pairs = files.select("at", F.explode(F.flatten(F.transform("fs", lambda a: F.transform(F.filter("fs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    both = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at")).where(F.col("n") >= least)
    counts = kept.groupBy("file").agg(F.count(F.lit(1)).alias("c"))
    full = both.join(counts.withColumnsRenamed({"file": "a", "c": "ca"}), "a").join(counts.withColumnsRenamed({"file": "b", "c": "cb"}), "b")
    return full.withColumn("score", F.col("n") / F.least("ca", "cb")).where(F.col("score") >= score).select("a", "b", "n", F.round("score", 6).alias("score"), "last_at")


def plain_name(name: Column) -> Column:
    """A name without case and separators."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def contained(keys: DataFrame, symbols: DataFrame, same: float, part: float, least: int = 4) -> DataFrame:
    """(key_id, symbol_id, confidence) within a project: symbols named like a key (`same`), or with
    the key's name inside theirs (`part`, keys of `least` characters and more), names without case
    and separators.

    Exact, and no key is held against every symbol: of a symbol only the parts that are as long as
    some key of its project are listed, and these meet the keys in an equi-join.
    """
    k = keys.select(F.col("id").alias("key_id"), "project", plain_name(F.col("name")).alias("text")).where("text <> ''")
    s = symbols.select(F.col("id").alias("symbol_id"), "project", plain_name(F.col("name")).alias("whole")).where("whole <> ''")
    lengths = k.where(F.length("text") >= least).select("project", F.length("text").alias("n")).distinct().groupBy("project").agg(F.collect_list("n").alias("lengths"))
    parts = F.flatten(F.transform("lengths", lambda n: F.when(n < F.length("whole"), F.transform(F.sequence(F.lit(1), F.length("whole") - n + 1), lambda i: F.substring("whole", i, n))).otherwise(F.array().cast("array<string>"))))
    inside = s.join(lengths, "project").select("symbol_id", "project", F.explode(F.array_distinct(parts)).alias("text"), F.lit(part).alias("confidence"))
    every = s.select("symbol_id", "project", F.col("whole").alias("text"), F.lit(same).alias("confidence")).unionByName(inside)
    return k.join(every, ["project", "text"]).select("key_id", "symbol_id", "confidence")


def config_links(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """Settings and the symbols named after them: `keys(id, project, name)`."""
    return contained(keys, symbols, 0.85, 0.75)


def dependency_links(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """Declared dependencies and the imports that use them: `dependencies(id, project, name)`,
    `imports(id, project, name)`."""
    return contained(dependencies, imports, 0.95, 0.80)


def file_links(values: DataFrame, files: DataFrame) -> DataFrame:
    """(value_id, file_id, confidence): values of settings, `values(id, project, value)`, that name
    a file of the project, by its whole path or else by its last part."""
    v = values.select(F.col("id").alias("value_id"), "project", graph_path(F.col("value")).alias("path")).where("path <> ''")
    f = files.select(F.col("id").alias("file_id"), "project", graph_path(F.col("file_path")).alias("path")).where("path <> ''")
    last = F.substring_index("path", "/", -1)
    whole = v.join(f, ["project", "path"]).select("value_id", "file_id", F.lit(0.90).alias("confidence"))
    base = v.select("value_id", "project", last.alias("base")).join(f.select("file_id", "project", last.alias("base")), ["project", "base"]).select("value_id", "file_id", F.lit(0.70).alias("confidence"))
    return whole.unionByName(base).groupBy("value_id", "file_id").agg(F.max("confidence").alias("confidence"))


def cross_project(g: PropertyGraph, sends: str = "EMITS", receives: str = "LISTENS_ON") -> DataFrame:
    """Projects linked by channels of one name, the sending to the receiving: how many names."""
    name = g.nodes.select(F.col("id").alias("target_id"), "name")
    owner = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("owner"))
    side = lambda t, p: g.edges.where(F.col("type") == t).join(name, "target_id").join(owner, "source_id").select("name", F.col("owner").alias(p)).distinct()
    return side(sends, "from_project").join(side(receives, "to_project"), "name").where("from_project <> to_project").groupBy("from_project", "to_project").agg(F.count_distinct("name").alias("n_channels"))


def both_ways(links: DataFrame, a: str, b: str) -> DataFrame:
    """(source, target, direction) of links between projects, once each way."""
    out = links.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit("forward").alias("direction"))
    return out.unionByName(links.select(F.col(b).alias("source"), F.col(a).alias("target"), F.lit("backward").alias("direction")))


def route_matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id): `calls(call_id, project, method, path)` to `routes(route_id, project,
    method, path)` of other projects by canonical path and method; a route for ANY method serves
    what no exact one does."""
    c = calls.select("call_id", F.col("project").alias("cp"), F.upper("method").alias("m"), route_path(F.col("path")).alias("path"))
    r = routes.select("route_id", F.col("project").alias("rp"), F.upper("method").alias("rm"), route_path(F.col("path")).alias("path"))
    hit = c.join(r, "path").where((F.col("cp") != F.col("rp")) & ((F.col("m") == F.col("rm")) | (F.col("rm") == "ANY")))
    best = hit.groupBy("call_id").agg(F.min(F.struct((F.col("m") != F.col("rm")).alias("any"), F.col("route_id"))).alias("b"))
    return best.select("call_id", "b.route_id")


def implements(methods: DataFrame) -> DataFrame:
    """(class_id, interface_id): classes whose methods include all those of an interface:
    `methods(owner_id, kind, project, name)`, kind 'Class' or 'Interface'. Relational division: an
    interface meets only the classes that have its rarest method, so a method that all have brings
    nobody together; their common names are then held against the interface's own number."""
    m = materialize(methods.select("owner_id", "kind", "project", "name").distinct(), "methods")
    c = m.where("kind = 'Class'").select(F.col("owner_id").alias("class_id"), "project", "name")
    i = m.where("kind = 'Interface'").select(F.col("owner_id").alias("interface_id"), "project", "name")
    held = c.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"))
    rare = i.join(held, ["project", "name"], "left").groupBy("interface_id", "project").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "name")).alias("r"), F.count(F.lit(1)).alias("need"))
    met = rare.where("r.n > 0").select("interface_id", "project", F.col("r.name").alias("name"), "need").join(c, ["project", "name"]).select("interface_id", "class_id", "need")
    have = met.join(i.select("interface_id", "name"), "interface_id").join(c.select("class_id", "name"), ["class_id", "name"])
    return have.groupBy("class_id", "interface_id", "need").agg(F.count(F.lit(1)).alias("have")).where("have = need").select("class_id", "interface_id")


def relations(g: PropertyGraph, wanted: DataFrame, kind: str) -> DataFrame:
    """(source_id, target_id, type) of relations told by name: `wanted(source_id, project, name)`
    to the definition of that name, of several the one with the least id: INHERITS to classes and
    interfaces, DECORATES to callables."""
    labels = {"INHERITS": ("Class", "Interface"), "DECORATES": ("Function", "Method", "Class")}[kind]
    one = g.nodes.where(F.col("label").isin(*labels)).groupBy("project", "name").agg(F.min("id").alias("target_id"))
    return wanted.join(one, ["project", "name"]).where("source_id <> target_id").select("source_id", "target_id", F.lit(kind).alias("type")).distinct()


def stale_derived(g: PropertyGraph, marker: str = "cross_file") -> DataFrame:
    """Edges that a resolver derived, by the mark in their properties."""
    return g.edges.where(prop("resolution").startswith(marker))
