"""Queries on changes, notices, writes and reports about tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import norm
from skein.operators import community as C
from skein.operators import memory as M
from skein.operators import neighbors as N
from skein.operators import reach as R
from skein.operators import reports as P
from skein.plans.cypher import query
from skein.plans.graph import PropertyGraph
from skein.plans.syntax import QueryError
from skein.queries.cypher import GRAPH
from skein.queries.graph import _COMM, _P, _TEST
from skein.queries.reach import NOTES
from skein.session import shared_path, table
from skein.sources import readers as D
from skein.sources import sinks as K
from skein.streaming import changes as X

_TABLE: dict = {}


def _t(sql: str | None = None):
    def add(f):
        _TABLE[f.__name__] = (f, sql)
        return f

    return add


def _g(sql: str | None = None):
    def add(f):
        _TABLE[f.__name__] = (lambda spark, sf_dir: f(PropertyGraph.from_tables(spark, sf_dir)), sql and GRAPH + sql)
        return f

    return add




@_t(
    "with f as (select project, file_path, max({'i': id, 'm': mtime_ns, 's': size, 'h': lower(trim(content_hash))}) v from file_hashes group by 1, 2), o as (select * from f where v.i % 10 <> 0), n as (select project, file_path, {'i': v.i, 'm': v.m, 's': case when v.i % 7 = 0 then v.s + 1 else v.s end, 'h': case when v.i % 14 = 0 then v.h || 'x' else v.h end} v from f where v.i % 9 <> 0)"
    " select coalesce(o.project, n.project) project, coalesce(o.file_path, n.file_path) file_path, case when o.v is null then 'new' when n.v is null then 'deleted' when (o.v.m is not distinct from n.v.m and o.v.s is not distinct from n.v.s) or coalesce(o.v.h = n.v.h, false) then 'unchanged' else 'changed' end change from o full join n on o.project = n.project and o.file_path = n.file_path"
)
def str_incremental(spark, sf_dir):
    """File states against the same states with some files gone, some new and some altered."""
    rows = table(spark, sf_dir, "file_hashes")
    f = rows.groupBy("project", "file_path").agg(F.max(F.struct("id", "mtime_ns", "size", F.lower(F.trim("content_hash")).alias("content_hash"))).alias("v")).select("project", "file_path", "v.*")
    new = f.where("id % 9 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("content_hash", F.when(F.col("id") % 14 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return X.incremental(f.where("id % 10 <> 0"), new)


@_t(
    "with e as (select user_id::varchar project, event_type as \"type\", ts \"at\", props payload from events), g as (select *, case when \"at\" >= lag(\"at\") over w + interval 30 minutes or lag(\"at\") over w is null then 1 else 0 end b from e window w as (partition by project, \"type\" order by \"at\")),"
    " s as (select *, sum(b) over (partition by project, \"type\" order by \"at\" rows unbounded preceding) burst from g) select project, \"type\", min(\"at\") began, max(\"at\") \"at\", max({'a': \"at\", 'p': payload}).p payload, count(*) n from s group by project, \"type\", burst"
)
def str_debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("type"), F.col("ts").alias("at"), F.col("props").alias("payload"))
    return X.debounce(e, "30 minutes")


@_t("select event_type as \"type\", max(value) filter (r = 1 + floor(0.99 * n)) p99 from (select event_type, value, row_number() over (partition by event_type order by value) r, count(*) over (partition by event_type) n from events where value is not null) group by 1")
def agg_p99(spark, sf_dir):
    return X.p99(table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), "value"), ["type"], "value")


@_t("select time_bucket(interval 1 hour, ts) began, event_type as \"method\", user_id::varchar path, count(*) n, max(value) slowest_ns from events group by 1, 2, 3")
def str_traces(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("path"), F.col("value").alias("duration_ns"))
    return X.traffic(s, "1 hour")


def _revision_sql(cols: list[str], rows: str) -> str:
    text = " || chr(31) || ".join(f"coalesce({c}::varchar, chr(0))" for c in cols)
    return f"select project, md5(n || ':' || x || ':' || s) revision from (select project, count(*) n, bit_xor(m) x, sum(m % 2147483648)::bigint s from (select project, ('0x' || substr(md5({text}), 1, 15))::bigint m from {rows}) group by 1)"


@_g(_revision_sql(["id", "project", "source_id", "target_id", "type", "properties_json"], "e"))
def str_revision(g):
    return X.revision(g.edges)


@_g(f", ch as (select distinct project, file_path, case id % 3 when 0 then 'unchanged' when 1 then 'changed' else 'deleted' end c from (select project, file_path, min(id) id from n where file_path is not null and project is not null group by 1, 2)) select n.project, n.file_path, id, case c when 'unchanged' then 'old' else 'new' end as \"how\" from n join ch on ch.project = n.project and ch.file_path = n.file_path where c <> 'deleted'")
def str_rederived(g):
    """Rows by file after some files changed and others went: the old ones kept, the changed ones
    derived again."""
    key = ["project", "file_path"]
    files = g.nodes.where("file_path is not null and project is not null").groupBy(*key).agg(F.min("id").alias("id"))
    change = files.select(*key, F.element_at(F.array(F.lit("unchanged"), F.lit("changed"), F.lit("deleted")), (F.col("id") % 3 + 1).cast("int")).alias("change"))
    old = g.nodes.select(*key, "id", F.lit("old").alias("how"))
    return X.rederived(change, old, lambda todo: g.nodes.join(todo, key, "left_semi").select(*key, "id", F.lit("new").alias("how")))


@_g("select project, least(60, 5 + floor(count(*) / 500))::int \"seconds\" from n where label = 'File' group by 1")
def str_watch_git(g):
    return g.nodes.where("label = 'File'").groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", X.poll_seconds(F.col("n")).alias("seconds"))


# --- writes, as tables before they are written


@_t("select * from (select *, row_number() over (partition by id order by indexed_at desc nulls last, deleted_at desc nulls last, project desc) rn from nodes where id is not null) where rn = 1".replace("select * from", "select id, project, qualified_name, indexed_at from", 1))
def sink_upsert_node(spark, sf_dir):
    """Deliveries applied one half after the other."""
    n = table(spark, sf_dir, "nodes").where("id is not null")
    half = n.where("id % 2 = 0"), n
    first, both = (K.latest(h, ["id"], "indexed_at") for h in half)
    return K.upsert(first, both, ["id"]).select("id", "project", "qualified_name", "indexed_at")


@_g("select id from e where source_id not in (select id from n where label = 'Variable') and target_id not in (select id from n where label = 'Variable')")
def sink_delete_label(g):
    return K.delete_nodes(g, F.col("label") == "Variable").edges.select("id")


@_t(
    GRAPH
    + """, w as (select e.* from e join n a on a.id = source_id join n b on b.id = target_id), side as (select id, project, source_id, target_id, type, properties_json, (id % 2)::int side from w),
 p as (select source_id, target_id, type, side, id, unnest(json_keys(case when json_valid(properties_json) and json_type(properties_json) = 'OBJECT' then properties_json end)) k, properties_json from side),
 v as (select source_id, target_id, type, k, arg_max(json_extract_string(properties_json, '/' || replace(replace(k, '~', '~0'), '/', '~1')), side * 1000000000000 + id) v from p where side is not null group by 1, 2, 3, 4)
 select h.source_id, h.target_id, h.type, h.id, coalesce(m, 0) n_properties from (select source_id, target_id, type, arg_min(id, side * 1000000000000 + id) id from side group by 1, 2, 3) h left join (select source_id, target_id, type, count(*) m from v group by 1, 2, 3) x on x.source_id = h.source_id and x.target_id = h.target_id and x.type is not distinct from h.type"""
)
def sink_graph_merge(spark, sf_dir):
    """A graph merged from its two halves by node id, whose ids differ, is the graph; parallel
    edges become one with the properties of all."""
    g = PropertyGraph.from_tables(spark, sf_dir)
    ids = g.nodes.select("id")
    whole = PropertyGraph(g.nodes, g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*g.edges.columns))
    shifted = PropertyGraph(whole.nodes.withColumn("id", F.col("id") + 10**9), whole.edges.where("id % 2 = 1").withColumn("source_id", F.col("source_id") + 10**9).withColumn("target_id", F.col("target_id") + 10**9))
    merged = K.merge_graphs(PropertyGraph(whole.nodes, whole.edges.where("id % 2 = 0")), shifted)
    return merged.edges.select("source_id", "target_id", "type", "id", F.coalesce(F.array_size(F.json_object_keys("properties_json")), F.lit(0)).cast("bigint").alias("n_properties"))


@_g("select id from n where label <> 'Variable' and coalesce(file_path, '') <> 'src/shared/logging.ts' and coalesce(project, '') <> 'atlas-core'")
def sink_delete_scopes(g):
    """Nodes left when a label, a file and a project are deleted, one after the other."""
    for gone in (F.col("label") == "Variable", F.coalesce(F.col("file_path") == "src/shared/logging.ts", F.lit(False)), F.coalesce(F.col("project") == "atlas-core", F.lit(False))):
        g = K.delete_nodes(g, gone)
    return g.nodes.select("id")


@_g("select id, type from e where type is distinct from 'CALLS'")
def sink_delete_type(g):
    return K.delete_edges(g, F.coalesce(F.col("type") == "CALLS", F.lit(False))).edges.select("id", "type")


@_g("select n.id, n.project, n.file_path, 'old' \"how\" from n where id % 2 = 0 and (project, file_path) not in (select project, file_path from n where id % 5 = 0 and project is not null and file_path is not null) and project is not null and file_path is not null union all select id, project, file_path, 'new' from n where id % 5 = 0 and id % 3 = 0 and project is not null and file_path is not null")
def sink_replace_files(g):
    """Rows by file after every file of some nodes was read again; some now have none."""
    n = g.nodes.where("project is not null and file_path is not null").select("id", "project", "file_path")
    return K.replace_files(n.where("id % 2 = 0").withColumn("how", F.lit("old")), n.where("id % 5 = 0 and id % 3 = 0").withColumn("how", F.lit("new")), n.where("id % 5 = 0"))


@_t("select 'nodes' \"table\", count(*) n from nodes where project is distinct from 'atlas-core' union all select 'edges', count(*) from edges where project is distinct from 'atlas-core' union all select 'file_hashes', count(*) from file_hashes where project is distinct from 'atlas-core' union all select 'alias_history', count(*) from file_hashes")
def sink_clear_project(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in ("nodes", "edges", "file_hashes")} | {"alias_history": table(spark, sf_dir, "file_hashes")}
    left = K.clear_project(tables, "atlas-core")
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, df in left.items()])


@_g("select 'nodes' \"table\", id from n union all select 'edges', id from e")
def sink_artifact(g):
    """The graph, written out, checked and read back."""
    spark = g.nodes.sparkSession
    at = shared_path(spark, "artifact")
    K.export_graph(g, at)
    back = K.import_graph(spark, at)
    return back.nodes.select(F.lit("nodes").alias("table"), "id").unionByName(back.edges.select(F.lit("edges").alias("table"), "id"))


def sink_integrity(spark, sf_dir):
    return K.integrity(PropertyGraph.from_tables(spark, sf_dir), table(spark, sf_dir, "projects"))


_TABLE["sink_integrity"] = (
    sink_integrity,
    GRAPH
    + """select 'repeated_node_id' as "check", (select count(*) from (select id from n group by 1 having count(*) > 1)) n union all select 'repeated_qualified_name', (select count(*) from (select 1 from n group by project, qualified_name having count(*) > 1))
    union all select 'edge_without_source', (select count(*) from e where source_id not in (select id from n)) union all select 'edge_without_target', (select count(*) from e where target_id not in (select id from n))
    union all select 'project_without_name', (select count(*) from projects where name is null or name = '') union all select 'node_of_no_project', (select count(*) from n where project is not null and project not in (select name from projects))""",
)


def _notes(spark, sf_dir):
    return P.note_states(table(spark, sf_dir, "human_nodes"))


@_t(GRAPH + NOTES + "select coalesce(obsidian_path, 'Notes/' || slug || '.md') path, '---\n' || concat_ws('\n', 'type: ' || label, 'status: ' || status, 'tags: [' || array_to_string(coalesce(tags, []), ', ') || ']', '---', '') || coalesce(body_markdown, '') \"text\" from notes")
def sink_vault(spark, sf_dir):
    return K.render_notes(_notes(spark, sf_dir))


@_t(GRAPH + NOTES + "select id, case when r > 1 then slug || '-' || r else slug end slug from (select *, row_number() over (partition by project, slug order by id) r from notes)")
def w_notes(spark, sf_dir):
    return K.unique_slugs(_notes(spark, sf_dir)).select("id", "slug")


@_t(
    GRAPH
    + NOTES
    + """, nw as (select project, 'fresh ' || (id % 40) title from notes where id % 4 = 0 and project is not null), sl as (select project, title, replace(title, ' ', '-') slug from nw), us as (select project, s, count(*) used from (select distinct id, project, s from (select id, project, slug s from notes union all select id, project, regexp_replace(slug, '-[0-9]+$', '') from notes)) group by 1, 2),
 nu as (select sl.*, row_number() over (partition by sl.project, sl.slug order by title) + coalesce(used, 0) k from sl left join us on us.project = sl.project and us.s = sl.slug), fi as (select project, title, case when k > 1 then slug || '-' || k else slug end slug from nu)
 select project, slug, (select max(id) from notes) + row_number() over (order by project, slug, title) id from fi"""
)
def w_create(spark, sf_dir):
    """Notes made anew, many of one title: their slugs and ids."""
    notes = _notes(spark, sf_dir)
    new = notes.where("id % 4 = 0 and project is not null").select("project", F.concat(F.lit("fresh "), (F.col("id") % 40).cast("string")).alias("title"))
    top = notes.agg(F.max("id").alias("top"))
    return M.create(notes, new).join(F.broadcast(top), F.lit(True)).where("id > top").select("project", "slug", "id")


@_t(GRAPH + NOTES + "select id, case when id % 3 = 0 then 'changed' else title end title, case when id % 3 = 0 and id % 2 = 0 then 'archived' else status end status from notes where id % 5 <> 0")
def w_update_delete(spark, sf_dir):
    """Notes after some were changed and others deleted."""
    notes = _notes(spark, sf_dir)
    changes = notes.where("id % 3 = 0").select("id", F.lit("changed").alias("title"), F.when(F.col("id") % 2 == 0, "archived").alias("status"))
    return M.delete(M.update(notes, changes), notes.where("id % 5 = 0")).select("id", "title", "status")


@_t(GRAPH + NOTES + "select note_id, node_id from links where node_id not in (select id from n)")
def w_stale_links(spark, sf_dir):
    return M.sync_stale(_notes(spark, sf_dir), PropertyGraph.from_tables(spark, sf_dir).nodes)


@_t(GRAPH + NOTES + ", st as (select min(obsidian_path) p, slug from notes where obsidian_path is not null and slug is not null group by slug), fi as (select case when right(md5(slug), 1) < '4' then 'moved/' || p else p end p, slug from st) select st.slug, st.p old_path, fi.p new_path from st join fi on fi.slug = st.slug where st.p <> fi.p and st.p not in (select p from fi) and fi.p not in (select p from st)")
def w_renames(spark, sf_dir):
    """Notes whose file was moved to another folder."""
    st = _notes(spark, sf_dir).where("obsidian_path is not null and slug is not null").groupBy("slug").agg(F.min("obsidian_path").alias("path"))
    moved = st.withColumn("path", F.when(F.substring(F.md5("slug"), -1, 1) < "4", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return M.sync_renames(st, moved)


@_t(GRAPH + NOTES + "select id, title, status from notes")
def sink_backup(spark, sf_dir):
    """Notes written out as JSON lines and put back into a table that has lost a part of them."""
    notes = _notes(spark, sf_dir)
    at = shared_path(spark, "backup")
    K.backup(notes, at)
    return K.restore(spark, at, notes.where("id % 3 <> 0"))[0].select("id", "title", "status")


@_t(GRAPH + NOTES + "select id, case when id % 2 = 0 then 'new of ' || id || chr(10) || '<!-- HUMAN NOTES -->' || chr(10) || 'by hand ' || id || chr(10) || '<!-- /HUMAN NOTES -->' || chr(10) else 'new of ' || id end \"text\" from notes")
def sink_keep_human(spark, sf_dir):
    """Notes rendered anew over files in which people wrote, every second one."""
    n = _notes(spark, sf_dir).select("id", F.concat(F.lit("new of "), F.col("id").cast("string")).alias("new"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("old\n<!-- HUMAN NOTES -->\nby hand "), F.col("id").cast("string"), F.lit("\n<!-- /HUMAN NOTES -->\n"))).otherwise("old").alias("old"))
    return n.select("id", K.keep_human(F.col("new"), F.col("old")).alias("text"))


@_t(GRAPH + NOTES + "select id, case when exists (select 1 from (select id nid, id % 50 + 1 x from notes) q where nid = notes.id and id % 3 = 0) then list_sort(list_distinct(coalesce(cbm_node_ids, []) || [id % 50 + 1])) else cbm_node_ids end cbm_node_ids from notes")
def w_link(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return M.link(notes, notes.where("id % 3 = 0").select(F.col("id").alias("note_id"), (F.col("id") % 50 + 1).alias("node_id"))).select("id", "cbm_node_ids")


@_t(GRAPH + NOTES + ", s as (select obsidian_path path, md5(string_agg(body_markdown, '' order by id)) h from notes where id % 5 <> 0 and obsidian_path is not null group by 1), f as (select obsidian_path path, md5(string_agg(case when id % 4 = 0 then body_markdown || '.' else body_markdown end, '' order by id)) h from notes where id % 7 <> 0 and obsidian_path is not null group by 1) select coalesce(s.path, f.path) path, case when s.path is null then 'import' when f.path is null then 'export' when s.h <> f.h then 'import' else 'keep' end as \"action\" from s full join f on s.path = f.path")
def w_sync(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    one = lambda df, body: df.groupBy(F.col("obsidian_path").alias("path")).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", body.alias("b")))), lambda x: x["b"]), "")).alias("hash"))
    stored = one(notes.where("id % 5 <> 0"), F.col("body_markdown"))
    files = one(notes.where("id % 7 <> 0"), F.when(F.col("id") % 4 == 0, F.concat("body_markdown", F.lit("."))).otherwise(F.col("body_markdown")))
    return M.sync_plan(stored, files)


# --- composed reports


def clusters(g: PropertyGraph) -> DataFrame:
    links = R.links(g, "CALLS")
    return C.cluster_report(C.communities(links), links, g.nodes.select(F.col("id").alias("node"), "name", "label", "qualified_name"))


def architecture(g: PropertyGraph, aspects: list[str], without: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The aspects of an architecture asked for; an unknown one is an error. 'overview' is all but
    the file tree."""
    known = {
        "languages": N.languages, "packages": N.packages, "entry_points": N.entry_points, "routes": N.routes, "hotspots": N.hotspots_calls, "boundaries": N.boundaries,
        "layers": N.layers, "file_tree": N.file_tree, "domains": N.domains, "patterns": N.patterns, "clusters": clusters,
    }
    wanted = [a for x in aspects for a in ([k for k in known if k != "file_tree"] if x == "overview" else list(known) if x == "all" else [x])]
    if unknown := [a for a in wanted if a not in known]:
        raise ValueError(f"unknown aspects: {unknown}")
    return {a: known[a](g) for a in dict.fromkeys(wanted) if a not in without}


_ASPECTS = f"""
, f as (select id, project, label, name, qualified_name, file_path, {_P} p, {_COMM} community from n), sc as (select id, community, split_part(community, '/', 1) dom from f),
 bo as (select s.community a, t.community b, count(*) k from calls join sc s on s.id = source_id join sc t on t.id = target_id where s.community <> t.community group by 1, 2),
 dg as (select id, sum(i) i, sum(o) o from (select source_id id, 0 i, 1 o from calls union all select target_id, 1, 0 from calls) group by 1)
"""


@_g(
    _ASPECTS
    + f"""select 'domains' aspect, (select count(distinct dom) from sc) n union all select 'patterns', (select count(*) from (select distinct a.label, coalesce(type, ''), b.label from e join n a on a.id = source_id join n b on b.id = target_id))
 union all select 'boundaries', (select least(10, count(*)) from bo) union all select 'layers', (select count(distinct c) from (select unnest([a, b]) c from (select * from bo order by k desc, a, b limit 10)))
 union all select 'hotspots', (select least(10, count(*)) from dg join n on n.id = dg.id where i > 0 and label in ('Function', 'Method') and not {_TEST})
 union all select 'entry_points', (select least(20, count(*)) from dg join n on n.id = dg.id where i = 0 and o > 0 and label in ('Function', 'Method') and not {_TEST})
 union all select 'packages', (select least(15, count(distinct q)) from (select case when len(x) > 3 then x[3] when len(x) > 1 then x[2] else '' end q from (select string_split(qualified_name, '.') x from n where label not in ('File', 'Folder', 'Package'))) where q <> '')
 union all select 'languages', (select least(10, count(distinct lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)))) from n where label = 'File' and lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) in ('py', 'js', 'ts', 'go', 'java', 'c', 'css'))
 union all select 'file_tree', (select count(*) from (select distinct array_to_string(a[1:i], '/') from (select a, unnest(range(0, len(a))) i from (select string_split(p, '/') a from f where label = 'File' and p <> ''))))
 union all select 'routes', 0"""
)
def r_architecture(g):
    """How many rows each aspect has; clusters have a query of their own."""
    parts = architecture(g, ["all"], without=("clusters",))
    return reduce(DataFrame.unionByName, [df.agg(F.lit(a).alias("aspect"), F.count(F.lit(1)).alias("n")) for a, df in parts.items()])


_SNIP = "select '{how}' \"how\", id, qualified_name, label, file_path, start_line, end_line, null::varchar[] callers, null::varchar[] callees from n where "


@_g(
    "select 'exact' \"how\", id, qualified_name, label, file_path, start_line, end_line, (select list(x order by x)[:5] from (select distinct s.name x from calls join n s on s.id = source_id where target_id = n.id)) callers, (select list(x order by x)[:5] from (select distinct t.name x from calls join n t on t.id = target_id where source_id = n.id)) callees from n where project = 'atlas-core' and qualified_name = 'src/shared/logging.ts::logEvent'"
)
def r_snippet(g):
    """A symbol by its qualified name, with callers and callees."""
    return P.snippet(g, "src/shared/logging.ts::logEvent", "atlas-core", neighbors=5)


@_g(_SNIP.format(how="suffix") + "project = 'atlas-core' and ends_with(qualified_name, '.ts::readSetting')")
def r_snippet_suffix(g):
    return P.snippet(g, "ts::readSetting", "atlas-core")


@_g(
    ", c as (select *, case when label in ('Function', 'Method') then 0 when label in ('File', 'Module', 'Folder', 'Package') then 2 else 1 end k, coalesce(end_line - start_line, -1) sp from n where ends_with(qualified_name, '::loadReader') or ends_with(qualified_name, '.loadReader')),"
    " b as (select min(k) k, max(sp) filter (where k = (select min(k) from c)) sp from c), t as (select count(*) m from c, b where c.k = b.k and c.sp = b.sp) select case when m = 1 then 'suffix' else 'suggestion' end \"how\", id, qualified_name, label, file_path, start_line, end_line, null::varchar[] callers, null::varchar[] callees from c, b, t where m > 1 or (c.k = b.k and c.sp = b.sp)"
)
def r_snippet_suggestions(g):
    """A name that several symbols end with: the longest callable, or all if they tie."""
    return P.snippet(g, "loadReader")


_FORMS = "[lower(replace(coalesce(name, ''), '\\', '/')), lower(replace(coalesce(qualified_name, ''), '\\', '/')), regexp_replace(lower(replace(coalesce(file_path, ''), '\\', '/')), '^\\./', '')]"


@_g(f", h as (select *, {_FORMS} f from n where project = 'atlas-core' and label = 'File') select 'found' \"how\", 1 stage, id, name, label, file_path from h where list_contains(f, 'src/shared/logging.ts') union all select 'found', 1, id, name, label, file_path from h where false")
def r_module(g):
    return P.find_module(g, "atlas-core", "src\\shared/logging.ts")


@_g(f", h as (select *, {_FORMS} f, case when label = 'File' then 1 else 2 end stage from n where project = 'atlas-core' and label in ('Module', 'File', 'Class', 'Interface')), m as (select * from h where len(list_filter(f, lambda x: contains(x, 'er'))) > 0), s as (select min(stage) st from m) select 'ambiguous' \"how\", stage, id, name, label, file_path from m, s where stage = st")
def r_module_ambiguous(g):
    return P.find_module(g, "atlas-core", "Er")


@_g(f", h as (select *, {_FORMS} f, case when label = 'File' then 1 else 2 end stage from n where project = 'atlas-core' and label in ('Module', 'File', 'Class', 'Interface')) select 'suggestion' \"how\", stage, id, name, label, file_path from h where len(list_filter(f, lambda x: contains(x, 'guar'))) > 0 order by id limit 10")
def r_module_suggestions(g):
    return P.find_module(g, "atlas-core", "guarxxxx")


@_t(
    GRAPH
    + NOTES
    + """select project, 'document' advice, count(*) n from facts where degree >= 20 and n_notes = 0 group by 1 union all select project, 'fix', count(*) from notes where status = 'active' and label = 'BugNote' group by 1 union all select project, 'plan', count(*) from notes where status = 'active' and label = 'RefactorPlan' group by 1
 union all select distinct project, 'start_notes', 1 from facts where project not in (select project from notes where project is not null) and project is not null union all select name, 'reindex', 1 from projects where root_path is null"""
)
def r_recommendations(spark, sf_dir):
    g, notes = PropertyGraph.from_tables(spark, sf_dir), _notes(spark, sf_dir)
    fresh = table(spark, sf_dir, "projects").select(F.col("name").alias("project"), F.when(F.col("root_path").isNull(), "OLD").otherwise("FRESH").alias("label"))
    out = P.recommendations(P.facts(g, notes), notes, fresh)
    return out.where("not (advice = 'start_notes' and project is null)")


# --- sources, over lines made from the tables


@_t("select 'r' || (l_orderkey % 3) repo, 'c' || md5(l_orderkey::varchar) \"commit\", to_timestamp(1700000000 + l_orderkey)::timestamp \"at\", 'src/f' || l_partkey || '.py' file from lineitem where l_partkey % 7 <> 0".replace("'c' || md5", "md5"))
def src_git_log(spark, sf_dir):
    """Histories of three repositories as `git log` prints them, an order being a commit and its
    parts the files; every seventh part is a vendored file."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    repo, base = F.concat(F.lit("r"), (F.col("l_orderkey") % 3).cast("string")).alias("repo"), F.col("l_orderkey") * 100
    head = li.select("l_orderkey").distinct().select(repo, base.alias("n"), F.concat(F.lit("COMMIT:"), F.md5(F.col("l_orderkey").cast("string")), F.lit(":"), (F.col("l_orderkey") + 1700000000).cast("string")).alias("value"))
    name = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("vendor/f"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".py")))
    return D.git_log(head.unionByName(li.select(repo, (base + 1 + F.col("l_linenumber")).alias("n"), name.alias("value"))))


@_t("select case o_orderkey % 4 when 2 then 'new' || o_orderkey else 'f' || o_orderkey end file, case o_orderkey % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'renamed' else 'deleted' end status, case o_orderkey % 4 when 2 then 'f' || o_orderkey end old_file from orders")
def src_git_status(spark, sf_dir):
    """What `git diff --name-status` prints, a line per order."""
    k, name = F.col("o_orderkey") % 4, F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    line = F.when(k == 0, F.concat(F.lit("A\t"), name)).when(k == 1, F.concat(F.lit("M\t"), name)).when(k == 2, F.concat(F.lit("R087\t"), name, F.lit("\tnew"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("D\t"), name))
    return D.git_status(table(spark, sf_dir, "orders").select(line.alias("value")))


@_t("select 'd' || (l_orderkey % 5) diff, 'f' || l_orderkey file, l_partkey::int \"start\", case when l_linenumber = 1 then 1 else l_linenumber end \"count\" from lineitem")
def src_git_hunks(spark, sf_dir):
    """What `git diff --unified=0` prints of five diffs, an order being a file and its parts the
    changed ranges."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    diff, base = F.concat(F.lit("d"), (F.col("l_orderkey") % 5).cast("string")).alias("diff"), F.col("l_orderkey") * 100
    head = li.select("l_orderkey").distinct().select(diff, base.alias("n"), F.concat(F.lit("+++ b/f"), F.col("l_orderkey").cast("string")).alias("value"))
    count = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit(","), F.col("l_linenumber").cast("string")))
    hunk = F.concat(F.lit("@@ -1 +"), F.col("l_partkey").cast("string"), count, F.lit(" @@ def f():"))
    return D.git_hunks(head.unionByName(li.select(diff, (base + 1 + F.col("l_linenumber")).alias("n"), hunk.alias("value"))))


@_t("select 't' || (event_id % 10) trace_id, event_id::varchar span_id, upper(event_type) \"method\", '/u/' || user_id path, 1000::bigint duration_ns from events where event_id % 3 <> 0 union all select 't' || (event_id % 10), event_id::varchar, upper(event_type), '/', 1000 from events where event_id % 3 = 0 and event_id % 2 = 0")
def src_otlp(spark, sf_dir):
    """Spans of trace documents, an event being a span; odd thirds are no HTTP spans."""
    e = table(spark, sf_dir, "events")
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    url = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("http://host/u/"), F.col("user_id").cast("string"))).otherwise(F.lit("http://host"))
    kind = F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 2 == 1), "db.system").otherwise("http.method")
    span = F.struct(
        F.concat(F.lit("t"), (F.col("event_id") % 10).cast("string")).alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("5000").alias("startTimeUnixNano"), F.lit("6000").alias("endTimeUnixNano"),
        F.array(F.struct(kind.alias("key"), F.struct(F.upper("event_type").alias("stringValue")).alias("value")), attribute("http.url", url)).alias("attributes"),
    )
    scopes = F.array(F.struct(F.array(span).alias("spans")))
    return D.spans(e.select(F.to_json(F.struct(F.array(F.struct(scopes.alias("scopeSpans"))).alias("resourceSpans"))).alias("value")))


@_t("select event_type as \"method\", count(*) n, sum(nullif(least(1, event_id % 2), 2))::bigint duration_ns from events group by 1")
def fn_duration(spark, sf_dir):
    """Durations of spans, by kind of event: their end less their start."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.lit(10**15).alias("start"), (F.lit(10**15) + F.col("event_id") % 2).alias("end"))
    return e.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum(norm.duration_ns(F.col("start").cast("string"), F.col("end").cast("string"))).alias("duration_ns"))


@_t("select user_id, case when user_id % 3 = 0 then '/' when user_id % 3 = 1 then '/a/' || user_id || '?q=1' else '/plain' end path from (select distinct user_id from events)")
def fn_url_path(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    url = F.when(F.col("user_id") % 3 == 0, "https://host:80").when(F.col("user_id") % 3 == 1, F.concat(F.lit("http://host/a/"), F.col("user_id").cast("string"), F.lit("?q=1"))).otherwise("/plain")
    return u.select("user_id", norm.url_path(url).alias("path"))


@_t(GRAPH + NOTES + "select id, label \"type\", status, case when len(coalesce(tags, [])) > 0 then array_to_string(tags, ',') else '' end tags, title \"owner\", coalesce(body_markdown, '') body from notes where title is not null and status is not null and label is not null")
def src_vault(spark, sf_dir):
    """Notes read back from Markdown with frontmatter, half of the tags as a list below their key."""
    n = _notes(spark, sf_dir).where("title is not null and status is not null and label is not null")
    tags = F.coalesce("tags", F.array())
    told = F.when(F.col("id") % 2 == 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]\n"))).otherwise(F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), "")))
    text = F.concat(F.lit("---\ntype: "), "label", F.lit("\nstatus: '"), "status", F.lit("'\n"), told, F.lit('owner: "'), "title", F.lit('"\n---\n'), F.coalesce("body_markdown", F.lit("")))
    notes = D.split_note(n.select(F.col("id").cast("string").alias("file"), text.alias("value")))
    f = F.col("frontmatter")
    return notes.select(F.col("file").cast("bigint").alias("id"), f["type"].alias("type"), f["status"].alias("status"), f["tags"].alias("tags"), f["owner"].alias("owner"), "body")


@_t(
    "with f as (select distinct project || '/' || replace(file_path, '\\', '/') path from file_hashes where project is not null and file_path is not null), k as (select path from f where regexp_matches(path, '\\.(py|js|ts|go|java|c|css|tsx|jsx)$') and not regexp_matches(path, '(^|/)(vendor|vendored|node_modules|site-packages|bower_components|dist|target|tmp|temp|env|venv|coverage|obj|deploy)/') and not regexp_matches(path, '(^|/)\\.'))"
    " select path, lower(regexp_extract(path, '\\.([a-z]+)$', 1)) ext from k where not (regexp_matches(path, '\\.py$') and not regexp_matches(path, '(^|/)tests/')) and not regexp_matches(path, '^atlas-core/src/ledger(/|$)')"
)
def src_discover(spark, sf_dir):
    """The files of all projects that ignore rules leave: no Python but for tests, and not one
    folder of one project."""
    p = F.concat_ws("/", "project", F.regexp_replace("file_path", r"\\", "/"))
    files = table(spark, sf_dir, "file_hashes").where("project is not null and file_path is not null").select(p.alias("path")).distinct()
    rules = spark.createDataFrame([("", 0, "# python"), ("", 1, "*.py"), ("", 2, "!tests/"), ("atlas-core", 0, "/src/ledger")], "folder string, n int, pattern string")
    kept = D.kept_paths(files, rules).where(~F.col("path").rlike(r"(^|/)\."))
    return kept.where(F.col("path").rlike(r"\.(py|js|ts|go|java|c|css|tsx|jsx)$")).select("path", F.lower(F.regexp_extract("path", r"\.([a-z]+)$", 1)).alias("ext"))


def lim_ceiling(spark, sf_dir):
    """Whether a graph query with a ceiling of 50 rows is let through, for a small and a large one."""
    g = PropertyGraph.from_tables(spark, sf_dir)
    rows = []
    for name, text in (("few", "MATCH (f:Function) RETURN f.id AS id LIMIT 49"), ("many", "MATCH (f) RETURN f.id AS id")):
        try:
            rows.append((name, query(g, text, ceiling=50).count()))
        except QueryError:
            rows.append((name, None))
    return spark.createDataFrame(rows, "query string, n bigint")


_TABLE["lim_ceiling"] = (lim_ceiling, GRAPH + "select 'few' \"query\", (select count(*) from (select 1 from n where label = 'Function' limit 49)) n union all select 'many', case when count(*) < 50 then count(*) end from n")


def queries() -> dict:
    return {k: f for k, (f, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _TABLE.items() if s}
