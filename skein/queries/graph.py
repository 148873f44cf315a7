"""Look-ups, search, neighbourhoods and summaries of the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import norm
from skein.operators import lookup as L
from skein.operators import neighbors as N
from skein.plans.graph import PropertyGraph, prop
from skein.queries.cypher import GRAPH, j
from skein.session import table

HUB = 1  # the node with most edges in every test set
QNS = ["src/shared/logging.ts::logEvent", "src/shared/config.ts::readSetting", "nowhere::nothing"]
_P = "trim(regexp_replace(replace(coalesce(file_path, ''), '\\', '/'), '^[A-Za-z]:/', '/'), '/')"
_TEST = f"regexp_matches(lower({_P}), '(^|/)(test|tests|__tests__)/|\\.(test|spec)\\.')"
_FOLDERS = f"case when label in ('Directory', 'Folder') then string_split({_P}, '/') else string_split({_P}, '/')[:-2] end"
_COMM = f"case when {_P} = '' then '(virtual)/' || label when len({_FOLDERS}) = 0 then '(root)' else array_to_string(({_FOLDERS})[1:3], '/') end"
SCOPES = f", sc as (select id, {_COMM} community, split_part({_COMM}, '/', 1) \"domain\" from n)\n"
DEG = ", ends as (select source_id id, 0 i, 1 o, type from e union all select target_id, 1, 0, type from e)\n"
_TABLE: dict = {}


def _q(sql: str | None = None, *, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _TABLE[key] = (lambda spark, sf_dir, f=f: f(PropertyGraph.from_tables(spark, sf_dir)), sql and GRAPH + sql)
        return f

    return add


def _t(sql: str | None = None):
    """A query on tables rather than on the graph."""

    def add(f):
        _TABLE[f.__name__] = (f, sql)
        return f

    return add


# --- scans


@_q("select id, name, qualified_name from n where id = 1")
def src_by_id(g):
    return g.nodes.where(F.col("id") == HUB).select("id", "name", "qualified_name")


@_q("select id, project from n where qualified_name = 'src/shared/logging.ts::logEvent'")
def src_by_qn(g):
    return g.nodes.where(F.col("qualified_name") == QNS[0]).select("id", "project")


@_q("select id, project, file_path from n where name = 'logEvent'")
def src_by_name(g):
    return g.nodes.where("name = 'logEvent'").select("id", "project", "file_path")


@_q("select id, label, name from n where file_path = 'src/shared/logging.ts'")
def src_by_file(g):
    return g.nodes.where("file_path = 'src/shared/logging.ts'").select("id", "label", "name")


@_q("select q qualified_name, coalesce(min(n.id), 0) id from (select unnest(['src/shared/logging.ts::logEvent', 'src/shared/config.ts::readSetting', 'nowhere::nothing']) q) left join n on n.qualified_name = q and n.project = 'atlas-core' group by 1")
def src_ids_by_qns(g):
    return L.ids_by_qns(g, "atlas-core", QNS)


@_q("select id, name from n where name in ('logEvent', 'readSetting', 'wrapFailure')")
def src_by_names(g):
    return L.listed(g.nodes.select("id", "name"), "name", ["logEvent", "readSetting", "wrapFailure", "logEvent"]).select("id", "name")


@_q("select id, name from n where id in (1, 2, 3, 999999999)")
def src_by_ids(g):
    return L.listed(g.nodes.select("id", "name"), "id", [1, 2, 3, 999999999]).select("id", "name")


@_q("select id, qualified_name from n where ends_with(qualified_name, '.ts::logEvent') or qualified_name = 'ts::logEvent'")
def src_qn_suffix(g):
    return L.qn_suffix(g, "ts::logEvent").select("id", "qualified_name")


@_q("select id, start_line from n where file_path = 'src/shared/config.ts' and start_line <= 40 and end_line >= 10 and label not in ('Module', 'Package', 'File', 'Folder')")
def src_line_overlap(g):
    return L.line_overlap(g, "src/shared/config.ts", 10, 40).select("id", "start_line")


@_q(f"""select p.point_id, d.id, d.start_line, d.end_line, row_number() over (partition by point_id order by d.end_line - d.start_line, d.start_line desc, d.id) rank
 from (select e.id point_id, s.project, s.file_path, try_cast({j('e', 'line')} as int) line from e join n s on s.id = e.source_id where type = 'CALLS') p
 join n d on d.project = p.project and d.file_path = p.file_path and p.line between d.start_line and d.end_line and d.label not in ('Module', 'Package', 'File', 'Folder')
 qualify rank <= 2""")
def src_containing_line(g):
    src = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"), "file_path")
    points = g.calls.join(src, "source_id").select(F.col("id").alias("point_id"), F.col("p").alias("project"), "file_path", prop("line").try_cast("int").alias("line"))
    return L.innermost(g, points, 2)


@_q(f"select id from n where contains({_P}, 'billing/core')")
def src_by_path(g):
    return L.by_path(g, "billing/core").select("id")


@_q("select id from n where label in ('Class', 'File') and (name ilike '%guard%' or qualified_name ilike '%guard%' or file_path ilike '%guard%')")
def src_by_name_or_path(g):
    return L.by_name_or_path(g, "Guard", ["Class", "File"]).select("id")


def _with_routes(g):
    """The graph with routes in place of interfaces: odd ids GET, even ones POST, half of them of
    one path, and some whose properties are no JSON."""
    told = F.to_json(F.struct(F.when(F.col("id") % 2 == 1, "get").otherwise("POST").alias("method"), F.when(F.col("id") % 4 < 2, "/health").otherwise(F.concat(F.lit("/"), "name")).alias("path")))
    route = F.col("label") == "Interface"
    nodes = g.nodes.withColumn("properties_json", F.when(route & (F.col("id") % 5 == 0), "broken{").when(route, told).otherwise(F.col("properties_json"))).withColumn("label", F.when(route, "Route").otherwise(F.col("label")))
    return PropertyGraph(nodes, g.edges)


@_q("select id from n where label = 'Interface' and id % 2 = 1 and id % 4 < 2 and id % 5 <> 0")
def src_route(g):
    return L.routes(_with_routes(g), "get", "/health").select("id")


@_q(
    f"""select n.id id, case when id % 5 <> 0 then case when id % 2 = 1 then 'GET' else 'POST' end end as \"method\", case when id % 5 = 0 then name when id % 4 < 2 then '/health' else '/' || name end path, coalesce(u, 0) n_uses
 from n left join (select target_id t, count(*) u from e where type in ('HANDLES', 'HTTP_CALLS', 'ASYNC_CALLS') group by 1) x on t = n.id where label = 'Interface' and not {_TEST} order by path, 2 nulls first, id limit 20"""
)
def agg_routes(g):
    return N.routes(_with_routes(g))


SITES = f", src as (select id sid, project sp, regexp_replace(qualified_name, '(::(anonymous#[0-9]+|<anonymous>))+$', '') owner_qn, file_path from n where not {_TEST}), sites as (select e.id site_id, sp project, owner_qn, file_path, source_id, target_id, try_cast({j('e', 'line')} as int) line from e join src on sid = source_id where type = 'CALLS')\n"


@_q(SITES + "select * from sites")
def src_call_sites(g):
    return L.call_sites(g)


@_q(SITES + "select true available, (select count(*) from sites) > 100 truncated, 100::bigint n_shown, (select count(*) from sites) n_sites")
def src_call_sites_state(g):
    return L.call_sites_state(L.call_sites(g), 100)


@_q(
    SITES
    + """, f as (select id, project, name from n where label in ('Function', 'Method')), k as (select project, name, count(*) n_definitions from f group by 1, 2),
 dc as (select target_id, owner_qn, file_path, count(*) c from sites group by 1, 2, 3), x as (select f.project, f.name, sum(c)::bigint n_sites, count(distinct case when owner_qn is not null and dc.file_path is not null then (owner_qn, dc.file_path) end) n_callers, bool_or(owner_qn is null) op from dc join f on f.id = dc.target_id group by 1, 2)
 select x.project, x.name, n_definitions, n_callers, n_sites, case when n_definitions > 1 then 'several_definitions' when op then 'anonymous' end reason from x join k on k.project = x.project and k.name = x.name"""
)
def agg_callers_by_name(g):
    return N.callers_by_name(g, L.call_sites(g))


@_q("select distinct file_path from n where file_path <> ''")
def src_list_files(g):
    return g.nodes.select("file_path").where("file_path <> ''").distinct()


@_q("select id, name from n where label = 'Class' order by id limit 200 offset 20")
def src_list_nodes(g):
    return g.nodes.where("label = 'Class'").select("id", "name").orderBy("id").offset(20).limit(200)


@_q("select id, file_path from n where label = 'File' order by id limit 200")
def src_list_modules(g):
    return g.nodes.where("label = 'File'").select("id", "file_path").orderBy("id").limit(200)


@_q("select id, 'docs/' || file_path file_path from n where label = 'File' and id % 3 = 0 order by 2, id limit 20")
def src_arch_docs(g):
    """The first documents on architecture, every third file being put below docs."""
    nodes = g.nodes.withColumn("file_path", F.when(F.col("id") % 3 == 0, F.concat(F.lit("docs/"), "file_path")).otherwise(F.col("file_path")))
    return L.architecture_documents(PropertyGraph(nodes, g.edges))


@_t("select distinct name from projects where name is not null union select distinct project from nodes where project is not null")
def src_projects(spark, sf_dir):
    return table(spark, sf_dir, "projects").select("name").union(table(spark, sf_dir, "nodes").select("project")).where("name is not null").distinct()


@_q("select id, target_id from e where source_id = (select min(source_id) from calls)")
def src_edges_source(g):
    one = g.calls.agg(F.min("source_id")).first()[0]
    return g.edges.where(F.col("source_id") == one).select("id", "target_id")


@_q("select id, target_id from calls where source_id = (select min(source_id) from calls)")
def src_edges_source_type(g):
    one = g.calls.agg(F.min("source_id")).first()[0]
    return g.calls.where(F.col("source_id") == one).select("id", "target_id")


@_q("select id, source_id, target_id from e where type = 'IMPLEMENTS'")
def src_edges_type(g):
    return g.edges.where("type = 'IMPLEMENTS'").select("id", "source_id", "target_id")


@_q("select id, source_id from e where target_id = 1 and type = 'CALLS'")
def src_edges_target(g):
    return g.edges.where((F.col("target_id") == HUB) & (F.col("type") == "CALLS")).select("id", "source_id")


@_q("select id from e where type = 'HTTP_CALLS' and id % 2 = 0")
def src_edges_url(g):
    """Edges by a part of their URL, HTTP calls being given one."""
    told = F.to_json(F.struct(F.concat(F.when(F.col("id") % 2 == 0, "/api/").otherwise("/web/"), "target_id").alias("url_path")))
    e = g.edges.withColumn("properties_json", F.when(F.col("type") == "HTTP_CALLS", told).otherwise(F.col("properties_json")))
    return e.where(prop("url_path").contains("/api/")).select("id")


@_q("select id, case lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) when 'py' then 'Python' when 'js' then 'JavaScript' when 'jsx' then 'JavaScript' when 'mjs' then 'JavaScript' when 'cjs' then 'JavaScript' when 'ts' then 'TypeScript' when 'tsx' then 'TypeScript' when 'go' then 'Go' when 'java' then 'Java' when 'c' then 'C' when 'css' then 'CSS' end as \"language\" from n where label = 'File'")
def src_language(g):
    return g.nodes.where("label = 'File'").select("id", norm.language(F.col("file_path")).alias("language"))


# --- structured search


@_q("select id from n where project = 'atlas-core' and label = 'Class'")
def sf_project_label(g):
    return L.search(g, project="atlas-core", label="Class").select("id")


@_q("select id from n where regexp_matches(name, '(?i)GUARD$')")
def sf_name(g):
    return L.search(g, name="GUARD$").select("id")


@_q("select id from n where regexp_matches(qualified_name, 'billing/.*::load')")
def sf_qn(g):
    return L.search(g, qn="billing/.*::load", case_sensitive=True).select("id")


@_q("select id from n where file_path ilike 'src%\\_guard%.ts' escape '\\'")
def sf_file(g):
    return L.search(g, file="src/**/*_guard*.ts").select("id")


@_q("select id from n where exists (select 1 from e where type = 'INHERITS' and (source_id = n.id or target_id = n.id))")
def sf_relationship(g):
    return L.search(g, relationship="INHERITS").select("id")


@_q(DEG + "select id from n where label = 'Function' and id not in (select id from ends where type = 'CALLS' group by id having sum(i) = 0 and sum(o) > 0)")
def sf_not_entry(g):
    return L.search(g, label="Function", not_entry=True).select("id")


@_q("select id from n where project = 'atlas-core' and label not in ('File', 'Variable')")
def sf_exclude_labels(g):
    return L.search(g, project="atlas-core", exclude_labels=["File", "Variable"]).select("id")


@_q(DEG + "select n.id id, coalesce(d, 0) degree from n left join (select id, count(*) d from ends where type in ('CALLS', 'USAGE', 'INHERITS', 'IMPLEMENTS') group by 1) x on x.id = n.id where coalesce(d, 0) between 0 and 2 and label = 'Method'")
def sf_degree(g):
    return L.search(g, label="Method", min_degree=0, max_degree=2).select("id", "degree")


@_q("select id, name, count(*) over () total, count(*) over () > 60 has_more from n where label = 'Function' order by name, id limit 50 offset 10")
def sf_page(g):
    return L.page(L.search(g, label="Function").select("id", "name"), 50, 10, "name", "id")


@_q(", x as (select source_id id, target_id o from e union select target_id, source_id from e), y as (select distinct x.id, b.name from x join n a on a.id = x.id and a.label = 'Interface' join n b on b.id = o) select id, list(name order by name)[:10] neighbors from y group by 1")
def sf_connected(g):
    return L.connected(g, L.search(g, label="Interface"))


# --- neighbours


SIDES = ", sides as (select id edge_id, type, source_id anchor, target_id other, 'out' side from e union all select id, type, target_id, source_id, 'in' from e)\n"


_NEAR = SIDES + "select anchor, side, rank, edge_id, type, other, name, label from (select *, row_number() over (partition by anchor, side order by edge_id) rank from sides where {where}) s join n on n.id = other where rank <= {k}"


@_q(_NEAR.format(where="anchor = 1", k=10))
def join_neighbors(g):
    return N.bulk_neighbors(g, g.nodes.where(F.col("id") == HUB).select(F.col("id").alias("anchor")), 10)


@_q(_NEAR.format(where="anchor in (select id from n where label = 'Class') and type = 'CALLS'", k=3))
def join_bulk_neighbors(g):
    return N.bulk_neighbors(g, g.nodes.where("label = 'Class'").select(F.col("id").alias("anchor")), 3, "CALLS")


@_q(SIDES + "select anchor, side, name, row_number() over (partition by anchor, side order by name) rank from (select distinct anchor, side, name from sides join n on n.id = other where type in ('CALLS', 'HTTP_CALLS', 'ASYNC_CALLS')) qualify rank <= 10")
def join_neighbor_names(g):
    return N.neighbor_names(g)


@_q("select distinct n.id id, n.label from e join n on n.id = source_id where type = 'CALLS' and target_id in (1, 2, 3)")
def join_incoming_labels(g):
    s = g.calls.where("target_id in (1, 2, 3)").select(F.col("source_id").alias("id")).distinct()
    return g.nodes.select("id", "label").join(s, "id", "left_semi")


@_q("select id, source_id, target_id, type from e where (source_id = 1 or target_id = 1) and id > 500 order by id limit 40")
def join_neighborhood_page(g):
    return N.neighborhood_page(g, HUB, 500, 40).select("id", "source_id", "target_id", "type")


@_q("select source_id, target_id, type, min(e.id) id from e join n a on a.id = source_id and a.project = 'atlas-core' join n b on b.id = target_id and b.project = 'atlas-core' group by 1, 2, 3")
def join_induced(g):
    return N.induced(g, g.nodes.where("project = 'atlas-core'"))


@_q(SCOPES + "select case when s.domain = 'src' then 'out' else 'in' end direction, type, case when s.domain = 'src' then t.domain else s.domain end external_domain, count(*) n_edges from e join sc s on s.id = source_id join sc t on t.id = target_id where (s.domain = 'src') <> (t.domain = 'src') group by all")
def join_boundary(g):
    return N.boundary(g, N.with_scopes(g), F.col("domain") == "src")


@_q(SCOPES + "select case when s.domain in ('src', 'lib') then s.domain end source_domain, case when t.domain in ('src', 'lib') then t.domain end target_domain, count(*) n_edges from e join sc s on s.id = source_id join sc t on t.id = target_id group by all")
def join_domain_dep(g):
    return N.domain_dependencies(g, ["src", "lib"])


@_q("select id from n where not exists (select 1 from calls where target_id = n.id) and label = 'Method'")
def join_anti(g):
    return g.nodes.where("label = 'Method'").join(g.calls.select(F.col("target_id").alias("id")), "id", "left_anti").select("id")


# --- counts and summaries


@_q("select 'nodes' kind, label as \"key\", count(*) n from n group by all union all select 'edges', type, count(*) from e group by all")
def agg_counts(g):
    a = g.nodes.groupBy(F.lit("nodes").alias("kind"), F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return a.union(g.edges.groupBy(F.lit("edges").alias("kind"), F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")))


@_q(f", m as (select id from n where {_P} = 'src/billing' or starts_with({_P}, 'src/billing/')) select (select count(*) from m) n_nodes, (select count(*) from e where source_id in (select id from m) and target_id in (select id from m)) n_edges")
def agg_counts_scoped(g):
    return N.counts_scoped(g, "./src//billing/ ")


@_q(DEG + "select id, sum(i)::bigint in_degree, sum(o)::bigint out_degree from ends group by 1")
def agg_degree(g):
    return g.degrees()


@_q("select target_id, count(*) n from e where type = 'IMPORTS' group by 1")
def agg_in_counts(g):
    return g.edges.where("type = 'IMPORTS'").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@_q("select label kind, key, count(*) n from (select distinct id, label, unnest(json_keys(properties_json)) as key from n where json_valid(properties_json) and json_type(properties_json) = 'OBJECT') group by label, key qualify row_number() over (partition by label order by key) <= 50")
def agg_schema_keys(g):
    return N.schema_keys(g.nodes, "label")


@_q("select '(' || a.label || ')-[' || coalesce(type, '') || ']->(' || b.label || ')' pattern, count(*) n from e join n a on a.id = source_id join n b on b.id = target_id group by 1")
def agg_schema_patterns(g):
    return N.patterns(g)


@_q("select label, row_number() over (partition by label order by id) rank, id, name from n qualify rank <= 3")
def agg_schema_samples(g):
    return N.schema_samples(g)


@_q(SCOPES + "select \"domain\", count(*) node_count, count(*) filter (label = 'File') file_count, coalesce(min(id) filter (label = 'File'), min(id)) representative_id from sc join n using (id) group by 1")
def agg_domains(g):
    return N.domains(g)


@_q("select lang as \"language\", count(*) n_files from (select case lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) when 'py' then 'Python' when 'js' then 'JavaScript' when 'jsx' then 'JavaScript' when 'mjs' then 'JavaScript' when 'cjs' then 'JavaScript' when 'ts' then 'TypeScript' when 'tsx' then 'TypeScript' when 'go' then 'Go' when 'java' then 'Java' when 'c' then 'C' when 'css' then 'CSS' end lang from n where label = 'File') where lang is not null group by 1 order by 2 desc, 1 limit 10")
def agg_languages(g):
    return N.languages(g)


@_q("select package, count(*) n from (select case when len(p) > 3 then p[3] when len(p) > 1 then p[2] else '' end package from (select string_split(qualified_name, '.') p from n where label not in ('File', 'Folder', 'Package'))) where package <> '' group by 1 order by 2 desc, 1 limit 15")
def agg_packages(g):
    return N.packages(g)


@_q(f"select n.id id, name, qualified_name, fan_in from (select target_id t, count(*) fan_in from calls group by 1) join n on n.id = t where label in ('Function', 'Method') and not {_TEST} order by fan_in desc, n.id limit 10")
def agg_hotspots_calls(g):
    return N.hotspots_calls(g)


_BOUND = SCOPES + ", b as (select s.community \"source\", t.community target, count(*) n_calls from calls join sc s on s.id = source_id join sc t on t.id = target_id where s.community <> t.community group by all order by 3 desc, 1, 2 limit 10) "


@_q(_BOUND + "select * from b")
def agg_boundaries(g):
    return N.boundaries(g)


@_q(_BOUND + "select community, i::bigint calls_in, o::bigint calls_out, case when i > o and i > 3 then 'core' when o = 0 and i > 0 then 'leaf' when i = 0 and o > 0 then 'entry' else 'internal' end as layer from (select c community, sum(i) i, sum(o) o from (select \"source\" c, 0 i, n_calls o from b union all select target, n_calls, 0 from b) group by 1)")
def agg_layers(g):
    return N.layers(g)


@_q(f", f as (select distinct string_split({_P}, '/') a from n where label = 'File' and {_P} <> ''), u as (select array_to_string(a[1:i], '/') folder, a[i + 1] child from (select a, unnest(range(0, len(a))) i from f)) select folder, count(distinct child) n_children, count(*) n_files from u group by 1")
def agg_file_tree(g):
    return N.file_tree(g)


@_q(DEG + f"select n.id id, name, false flagged, o out_degree from n join (select id, sum(i) i, sum(o)::bigint o from ends where type = 'CALLS' group by 1) d on d.id = n.id where i = 0 and o > 0 and label in ('Function', 'Method') and not {_TEST} order by o desc, n.id limit 20")
def agg_entry_points(g):
    return N.entry_points(g)


@_q(DEG + f"select n.id id, name, n.id % 40 = 0 flagged, coalesce(o, 0) out_degree from n left join (select id, sum(i) i, sum(o)::bigint o from ends where type = 'CALLS' group by 1) d on d.id = n.id where (n.id % 40 = 0 or (i = 0 and o > 0)) and label in ('Function', 'Method') and not {_TEST} order by 3 desc, 4 desc, n.id limit 20")
def agg_entry_points_flagged(g):
    """Entry points where some nodes carry the flag."""
    nodes = g.nodes.withColumn("properties_json", F.when(F.col("id") % 40 == 0, '{"is_entry_point":true}').otherwise(F.col("properties_json")))
    return N.entry_points(PropertyGraph(nodes, g.edges))


@_q("select name package, coalesce(sum(k), 0)::bigint n from n left join (select source_id, count(*) k from e where type in ('CONTAINS', 'DEFINES', 'CONTAINS_PACKAGE') group by 1) x on source_id = id where label = 'Class' and name <> '' group by 1 order by 2 desc, 1 limit 15")
def agg_packages_nodes(g):
    """Packages by their nodes, classes standing for them."""
    return N.packages(PropertyGraph(g.nodes.withColumn("label", F.when(F.col("label") == "Class", "Package").otherwise(F.col("label"))), g.edges))


@_q(SITES + "select target_id, owner_qn, file_path, count(*) n_calls, min(line) first_line from sites group by 1, 2, 3")
def agg_direct_callers(g):
    return N.direct_callers(L.call_sites(g))


@_q("select f.file_path src_file, t.file_path dst_file, count(*) binding_count, list_sort(list(distinct coalesce(" + j("e", "resolution") + ", ''))) kinds from e join n f on f.id = source_id join n t on t.id = target_id where type = 'IMPORTS' group by 1, 2")
def agg_import_deps(g):
    p = g.nodes.select("id", "file_path")
    both = g.edges.where("type = 'IMPORTS'").join(p.select(F.col("id").alias("source_id"), F.col("file_path").alias("src_file")), "source_id").join(p.select(F.col("id").alias("target_id"), F.col("file_path").alias("dst_file")), "target_id")
    return both.groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("binding_count"), F.sort_array(F.collect_set(F.coalesce(prop("resolution"), F.lit("")))).alias("kinds"))


# --- top lists and pages


@_q(DEG + "select n.id id, name, coalesce(d, 0) degree from n left join (select id, count(*) d from ends group by 1) x on x.id = n.id where label = 'Function' order by 3 desc, 1 limit 50")
def top_ranked(g):
    return N.top_ranked(g, "Function")


@_q(f"select id, name, {_TEST} is_test, coalesce({j('n', 'is_exported')} in ('true', '1'), false) or coalesce({j('n', 'exported')} in ('true', '1'), false) is_exported from n where label in ('Function', 'Method') and id not in (select target_id from calls) order by 3, 4, 1 limit 50")
def top_dead(g):
    return N.dead_code(g)


@_q(", r as (select id, name, case when lower(name) = 'guard' then 0 when lower(qualified_name) = 'guard' or lower(file_path) = 'guard' then 1 when starts_with(lower(name), 'guard') then 2 when contains(lower(name), 'guard') then 3 when contains(lower(qualified_name), 'guard') then 4 when contains(lower(file_path), 'guard') then 5 end rank from n) select id, name, rank from r where rank is not null and (rank, id) > (3, 1500) order by rank, id limit 60")
def page_search(g):
    return L.after(L.ranked_search(g, "Guard").select("id", "name", "rank"), 60, rank=3, id=1500)


@_q(", p as (select id, project, floor((row_number() over (partition by project order by id) - 1) / 100)::bigint page from n), ne as (select a.project, greatest(a.page, b.page) page, count(*) n_edges from e join p a on a.id = source_id join p b on b.id = target_id where a.project = b.project group by 1, 2) select c.project as \"scope\", c.page page, n_nodes, coalesce(n_edges, 0) n_edges from (select project, page, count(*) n_nodes from p group by 1, 2) c left join ne on ne.project = c.project and ne.page = c.page")
def page_scope(g):
    return N.edge_pages(g, 100)


_QUOTA = DEG + f""", deg as (select n.id, label, coalesce(d, 0) degree, {_COMM} comm, split_part({_COMM}, '/', 1) dom, coalesce(ci, 0) ci, coalesce({j('n', 'is_exported')} in ('true', '1'), false) or coalesce({j('n', 'exported')} in ('true', '1'), false) or coalesce({j('n', 'is_entry_point')} in ('true', '1'), false) op, {_TEST} te
  from n left join (select id, count(*) d from ends group by 1) x on x.id = n.id left join (select target_id t, count(*) ci from calls group by 1) y on y.t = n.id),
 lc as (select label, count(*) c from n group by 1), lp as (select *, row_number() over (order by c, label) pos, row_number() over (order by c desc, label) large, count(*) over () k, coalesce(sum(c) over (order by c, label rows between unbounded preceding and 1 preceding), 0) below from lc),
 lv as (select floor((200 - below) / (k - pos + 1))::bigint lvl, (200 - below) % (k - pos + 1) odd, pos fr from lp where below + c * (k - pos + 1) >= 200 order by pos limit 1),
 qt as (select label, large, case when lvl is null or pos < fr then c else lvl + (large <= odd)::int end quota from lp left join lv on true),
 rk as (select deg.*, row_number() over (partition by label order by degree desc, id) rank from deg),
 c1 as (select row_number() over (order by rank, large) place, rk.label, dom, id, degree, 'degree' why from rk join qt on qt.label = rk.label where rank <= quota),
 dd as (select *, row_number() over (partition by label order by id) r from (select * from deg where label in ('Function', 'Method') and not op and not te and ci = 0 and id not in (select id from c1) order by id limit 10)),
 la as (select *, row_number() over (partition by label order by place desc) r from c1),
 s1 as (select la.place, dd.label, dd.dom, dd.id, dd.degree, 'dead' why from la join dd on dd.label = la.label and dd.r = la.r),
 c2 as (select * from c1 where place not in (select place from s1) union all select * from s1),
 ms as (select *, row_number() over (order by dom) r from (select dom, min(id) id, arg_min(label, id) label, arg_min(degree, id) degree from deg where label = 'File' group by 1) where dom not in (select dom from c2)),
 sp as (select *, row_number() over (order by place desc) r from (select *, row_number() over (partition by dom order by place) kk from c2 where why = 'degree') where kk > 1),
 s2 as (select sp.place, ms.label, ms.dom, ms.id, ms.degree, 'domain' why from sp join ms on ms.r = sp.r)
 select place, label, id, degree, why from (select * from c2 where place not in (select place from s2) union all select * from s2)"""


@_q(_QUOTA)
def quota_labels(g):
    return N.label_quota(g, 200)


@_q(SCOPES + ", d as (select s.domain sd, t.domain td, count(*) c from e join sc s on s.id = source_id join sc t on t.id = target_id group by 1, 2) select \"domain\", count(*) n_nodes, coalesce((select sum(c) from d where sd = domain and td = domain), 0)::bigint as \"within\", coalesce((select sum(c) from d where sd = domain and td <> domain), 0)::bigint going_out, coalesce((select sum(c) from d where td = domain and sd <> domain), 0)::bigint coming_in from sc group by 1 order by 2 desc, 1 limit 12")
def g_dep_atlas(g):
    return N.dependency_atlas(g)


@_q(SCOPES + "select id, \"domain\", community from sc")
def g_scopes(g):
    return N.with_scopes(g)


def queries() -> dict:
    return {k: f for k, (f, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _TABLE.items() if s}
