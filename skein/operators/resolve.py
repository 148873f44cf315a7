"""Resolving call sites through imports and exports, and what follows from calls and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.norm import route_path
from skein.operators.derive import module_paths, resolve_exports

#: Methods of the language's own objects, which are no definitions of a project (fixed values).
BUILTINS = (
    "map", "filter", "foreach", "reduce", "reduceRight", "find", "findIndex", "some", "every", "includes", "indexOf", "lastIndexOf", "flat", "flatMap", "sort",
    "reverse", "join", "slice", "splice", "concat", "fill", "keys", "values", "entries", "from", "isArray", "of", "then", "catch", "finally", "resolve", "reject",
    "all", "race", "allSettled", "push", "pop", "shift", "unshift", "get", "set", "has", "delete", "clear", "add", "forEach", "log", "warn", "error", "info",
    "debug", "trace", "dir", "table", "prepare", "run", "exec", "transaction", "toString", "valueOf", "toJSON", "toFixed", "toPrecision", "call", "apply", "bind",
    "startsWith", "endsWith", "replace", "replaceAll", "split", "match", "matchAll", "trim", "trimStart", "trimEnd", "padStart", "padEnd", "repeat", "substring",
    "substr", "toLowerCase", "toUpperCase", "parse", "stringify",
)


def resolve_sites(sites: DataFrame, imports: DataFrame, exports: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """(site_id, target_id, kind, confidence) of the calls in `sites(site_id, project, file_path,
    callee, call_kind)`; `callee` is `name` or `object.member`.

    A call is taken through its file's imports first: the local name, or the object for a member
    of a namespace, leads to a module (`imports(project, file_path, local_name, source_module,
    imported_name, import_kind)`), and the module's exports (`exports(project, file_path,
    exported_name, local_name, source_module, imported_name, export_kind)`) to a definition
    (`defs(id, project, file_path, name)`). What exports leave missing, ambiguous or unknown stays
    unresolved: a name that was imported is not guessed. Other names resolve within the file, then,
    unless they are built-in methods, to all of the project's definitions of the name, each with an
    equal share of confidence, at most 0.3 for members.
    """
    member = F.col("call_kind") == "member_call"
    head, tail = F.substring_index("callee", ".", 1), F.substring_index("callee", ".", -1)
    s = sites.select("site_id", "project", "file_path", member.alias("member"), head.alias("head"), tail.alias("tail"))
    paths = module_paths(imports.select("project", "file_path", "source_module").unionByName(exports.where("source_module is not null").select("project", "file_path", "source_module")), files)
    i = imports.join(paths, ["project", "file_path", "source_module"], "left").select("project", "file_path", F.col("local_name").alias("head"), "imported_name", "import_kind", "resolved")
    asked = s.join(i, ["project", "file_path", "head"])
    name = F.when(F.col("import_kind") == "namespace", F.col("tail")).when(F.col("import_kind").isin("default", "default_export"), "default").otherwise(F.coalesce("imported_name", "head"))
    usable = ~F.col("member") | (F.col("import_kind") == "namespace")
    asked = asked.withColumn("want", F.when(usable, name))
    key = lambda p, f: F.concat_ws("\u0001", p, f)
    ex = exports.join(paths, ["project", "file_path", "source_module"], "left").select(
        key("project", "file_path").alias("file_path"), "exported_name", "local_name", "imported_name", F.when(F.col("resolved").isNotNull(), key("project", "resolved")).alias("source_file"), "export_kind"
    )
    wanted = asked.where("resolved is not null and want is not null").select(key("project", "resolved").alias("file_path"), F.col("want").alias("name")).distinct()
    ends = resolve_exports(ex, wanted).where("status = 'resolved'").select(F.col("file_path").alias("mk"), F.col("name").alias("want"), "target_file", "target_name")
    d = defs.groupBy(key("project", "file_path").alias("target_file"), F.col("name").alias("target_name")).agg(F.min("id").alias("target_id"))
    by_import = asked.withColumn("mk", key("project", "resolved")).join(ends, ["mk", "want"]).join(d, ["target_file", "target_name"]).select("site_id", "target_id", F.concat(F.lit("import_"), "import_kind").alias("kind"), F.lit(0.95).alias("confidence"))
    rest = s.join(asked.select("site_id").distinct(), "site_id", "left_anti")
    here = defs.groupBy("project", "file_path", F.col("name").alias("tail")).agg(F.min("id").alias("target_id"))
    local = rest.where(~F.col("member")).join(here, ["project", "file_path", "tail"]).select("site_id", "target_id", F.lit("same_file").alias("kind"), F.lit(0.9).alias("confidence"))
    open_ = rest.join(local.select("site_id"), "site_id", "left_anti").where(~(F.col("member") & F.col("tail").isin(*BUILTINS)))
    all_ = defs.select("id", "project", F.col("name").alias("tail"))
    every = all_.join(all_.groupBy("project", "tail").agg(F.count(F.lit(1)).alias("n")), ["project", "tail"])
    share = F.when(F.col("member"), F.least(F.lit(0.3), 1.0 / F.col("n"))).otherwise(1.0 / F.col("n"))
    named = open_.join(every, ["project", "tail"]).select("site_id", F.col("id").alias("target_id"), F.lit("name").alias("kind"), F.round(share, 6).alias("confidence"))
    return reduce(DataFrame.unionByName, [by_import, local, named])


def route_nodes(calls: DataFrame) -> DataFrame:
    """(project, method, path, n_calls): one route per canonical path and method of
    `calls(project, method, path)`; a call without a method asks for ANY."""
    path = route_path(F.col("path"))
    return calls.where("path is not null").groupBy("project", F.upper(F.coalesce("method", F.lit("ANY"))).alias("method"), path.alias("path")).agg(F.count(F.lit(1)).alias("n_calls"))


def route_flows(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """(caller_id, handler_id) of data flows through a route: `calls(caller_id, method, path)` and
    `handlers(handler_id, method, path)`, methods equal or ANY on the handler's side."""
    c = calls.select("caller_id", F.upper(F.coalesce("method", F.lit("ANY"))).alias("m"), route_path(F.col("path")).alias("path"))
    h = handlers.select("handler_id", F.upper(F.coalesce("method", F.lit("ANY"))).alias("hm"), route_path(F.col("path")).alias("path"))
    return c.join(h, "path").where((F.col("m") == F.col("hm")) | (F.col("hm") == "ANY")).select("caller_id", "handler_id").distinct()


def usages(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """(site_id, type, target_id): what code uses, throws, reads or writes, by name within its file
    or unique in its project: `sites(site_id, project, file_path, name, type)`."""
    here = defs.groupBy("project", "file_path", "name").agg(F.min("id").alias("a"))
    one = defs.groupBy("project", "name").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    hit = sites.join(here, ["project", "file_path", "name"], "left").join(one, ["project", "name"], "left")
    return hit.select("site_id", "type", F.coalesce("a", "b").alias("target_id")).where("target_id is not null")
