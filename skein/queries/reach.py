"""Reachability and report queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.norm import hop_risk, in_scope, graph_path
from skein.operators import reach as R
from skein.operators import reports as P
from skein.plans.graph import PropertyGraph, prop
from skein.queries.cypher import GRAPH, j
from skein.queries.graph import _P, _TEST
from skein.session import table

_TABLE: dict = {}


def _q(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            return f(PropertyGraph.from_tables(spark, sf_dir), P.note_states(table(spark, sf_dir, "human_nodes")))

        _TABLE[f.__name__] = (run, sql and GRAPH + sql)
        return f

    return add


def _ids(g, *ids):
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "node bigint")



def _walk(starts: str, hops: int, back: bool = False, e: str = "calls") -> str:
    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
    return f", w as (select {a} start, {b} node, 1 hop from {e} where {a} in ({starts}) union select w.start, {b}, hop + 1 from w join {e} on {a} = w.node where hop < {hops}), least as (select start, node, min(hop) hop from w group by 1, 2)\n"




@_q(_walk("select id from n where id % 100 = 0", 3) + "select node, start, hop, name, label, file_path from least join n on n.id = node")
def g_bfs(g, notes):
    return R.bfs(g, g.nodes.where("id % 100 = 0").select(F.col("id").alias("node")), max_hops=3)


@_q(
    _walk("select id from n where id % 100 = 0", 3)
    + f", near as (select node from least union select id from n where id % 100 = 0) select id, source_id, target_id, type, try_cast({j('calls', 'confidence')} as double) confidence from calls where source_id in (select node from near) and target_id in (select node from near)"
)
def g_bfs_edges(g, notes):
    return R.bfs_edges(g, g.nodes.where("id % 100 = 0").select(F.col("id").alias("node")), max_hops=3)


@_q(
    _walk("select min(id) from n where name = 'logEvent'", 2).replace(", w as", ", w0 as").replace("from w join", "from w0 join").replace("w.start", "w0.start").replace("= w.node", "= w0.node").replace("least as", "l0 as").replace("from w group", "from w0 group")
    + _walk("select min(id) from n where name = 'logEvent'", 2, True)
    + f"select direction, node, name, label, hop, case hop when 1 then 'CRITICAL' when 2 then 'HIGH' when 3 then 'MEDIUM' else 'LOW' end risk, (select count(*) from n where name = 'logEvent') n_candidates from (select 'out' direction, * from l0 union all select 'in', * from least) join n on n.id = node where not {_TEST}"
)
def g_trace(g, notes):
    return R.trace(g, "logEvent", max_hops=2)


@_q("select id, name, qualified_name, label, file_path from n where contains(lower(name), 'loge') order by id limit 10")
def g_trace_suggestions(g, notes):
    return R.trace_suggestions(g, "logExxxx")


@_q(
    _walk("select min(id) from n where name = 'logEvent'", 2, True)
    + f", near as (select node, min(hop) hop from (select node, hop from least union all select min(id), 0 from n where name = 'logEvent') group by 1) select b.hop, source_id, target_id, try_cast({j('calls', 'line')} as int) line, try_cast({j('calls', 'arg_count')} as int) args from calls join near a on a.node = target_id join near b on b.node = source_id where b.hop = a.hop + 1"
)
def g_trace_calls(g, notes):
    return R.trace_calls(g, "logEvent", "in", 2)


_SHARED = "project = 'atlas-core' and (%s = 'src/shared' or starts_with(%s, 'src/shared/'))" % ((_P,) * 2)
_CHANGED = f"select id from n where {_SHARED} and label not in ('File', 'Folder')"


@_q(_walk(_CHANGED, 4, True) + f"select case hop when 1 then 'CRITICAL' when 2 then 'HIGH' when 3 then 'MEDIUM' else 'LOW' end risk, count(*) n_symbols, min(hop) nearest from (select node, min(hop) hop from least where node not in ({_CHANGED}) and node in (select id from n) group by 1) group by 1")
def g_impact(g, notes):
    changed = g.nodes.where((F.col("project") == "atlas-core") & in_scope(graph_path(F.col("file_path")), "src/shared")).select("project", "file_path")
    return R.impact(g, changed)


@_q(_walk("1", 3, True) + "select case hop when 1 then 'CRITICAL' when 2 then 'HIGH' when 3 then 'MEDIUM' else 'LOW' end risk, count(*) n from (select node, min(hop) hop from least group by 1) group by 1")
def agg_impact(g, notes):
    return P.impact_summary(R.least_hops(_ids(g, 1), R.links(g, "CALLS", direction="in"), 3))


@_q(_walk("1, 2, 3", 3, True) + "select node, min(hop) hop from least group by 1")
def set_dedupe_hops(g, notes):
    return R.least_hops(_ids(g, 1, 2, 3), R.links(g, "CALLS", direction="in"), 3)


_PATH = """, b as (select x src, y dst, min(id) edge_id from (select source_id x, target_id y, id from e union all select target_id, source_id, id from e) where x <> y group by 1, 2),
 s as (select min(id) a, max(id) z from n where label = 'Method'), w as (select a node, 0 hop from s union select dst, hop + 1 from w join b on src = node where hop < 6), least as (select node, min(hop) hop from w group by 1)
"""


def _far_ends(g):
    return g.nodes.where("label = 'Method'").agg(F.min("id"), F.max("id")).first()


@_q(
    _PATH
    + """, p as (select node, hop as "position", (select arg_min(b.edge_id, b.edge_id) from b join least l on l.node = b.src and l.hop = least.hop - 1 where b.dst = least.node) edge_id from least where node = (select z from s)
  union all select q.src, p."position" - 1, (select min(b2.edge_id) from b b2 join least l2 on l2.node = b2.src and l2.hop = p."position" - 2 where b2.dst = q.src) from p join (select b.dst, b.edge_id, b.src from b) q on q.dst = p.node and q.edge_id = p.edge_id)
 select "position", node, edge_id from p"""
)
def g_shortest_path(g, notes):
    return R.shortest_path(g, *_far_ends(g))[0]


@_q(_PATH + "select case when h is null then 'max_hops' else 'found' end status, h hops from (select (select hop from least where node = (select z from s)) h)")
def g_path_status(g, notes):
    return R.shortest_path(g, *_far_ends(g))[1].select("status", "hops")


@_q(_walk("1, 2", 8, True) + "select node, min(hop) depth, any_value(name) name, any_value(file_path) file_path, any_value(start_line) start_line from least join n on n.id = node group by 1")
def g_callers_multi(g, notes):
    return R.callers_multi(g, _ids(g, 1, 2))[0]


@_q(
    _walk("1, 2", 2, True)
    + ", l2 as (select node, min(hop) hop from least group by 1), far as (select count(distinct target_id) k from calls where target_id in (select node from l2 where hop = 2) and source_id not in (select node from l2) and source_id not in (1, 2))"
    " select k = 0 complete, (select count(*) from l2) n_callers, k n_open, case when k > 0 then 'max_hops' end reason from far"
)
def g_callers_state(g, notes):
    return R.callers_multi(g, _ids(g, 1, 2), 2)[1]


@_q(
    ", refs as (select target_id s, source_id t from e where type in ('USAGE', 'INHERITS', 'IMPLEMENTS')), near as (select id node from n where label = 'Interface' and project = 'atlas-core' union select refs.t from near join refs on refs.s = near.node)"
    " select project, file_path, count(*) n_symbols from n where id in (select t from refs where s in (select node from near)) group by 1, 2"
)
def g_type_dependents(g, notes):
    return R.type_dependents(g, g.nodes.where("label = 'Interface' and project = 'atlas-core'").select(F.col("id").alias("node")))


@_q(
    ", ch(path, node) as (select [id], id from n where starts_with(name, 'load') union select list_append(ch.path, c.target_id), c.target_id from ch join (select distinct source_id, target_id from calls) c on c.source_id = ch.node where ch.node <> 1 and len(ch.path) <= 4 and not list_contains(ch.path, c.target_id))"
    " select len(path) - 1 hops, array_to_string(path, '>') path from ch where node = 1 order by len(path), ch.path limit 5"
)
def g_call_chain(g, notes):
    starts = g.nodes.where(F.col("name").startswith("load")).select(F.col("id").alias("node"))
    return R.call_chains(g, starts, _ids(g, 1), max_hops=4).select("hops", F.array_join("path", ">").alias("path"))


@_q(
    f""", o as (select id, coalesce(try_cast({j('n', 'metrics.branches.loop')} as int), 0) depth from n where label in ('Function', 'Method')), c as (select distinct source_id s, target_id t from calls where source_id in (select id from o) and target_id in (select id from o)),
 r as (select s, t from c union select r.s, c.t from r join c on c.s = r.t), ring as (select s id from r where s = t), x as (select s, t from c where not exists (select 1 from r where r.s = c.t and r.t = c.s)),
 tot as (select id, depth total from o union select x.s, o.depth + tot.total from tot join x on x.t = tot.id join o on o.id = x.s)
 select id, max(total) total, id in (select id from ring) recursive from tot group by 1"""
)
def g_complexity(g, notes):
    own = g.nodes.where(F.col("label").isin("Function", "Method")).select("id", F.coalesce(prop("metrics.branches.loop").try_cast("int"), F.lit(0)).alias("depth"))
    return R.loop_depth(g, own)


@_q(", b as (select source_id s, target_id t from calls union select target_id, source_id from calls), cc(node, component) using key (node) as (select s, s from b group by 1 union select b.s, min(cc.component) from b join cc on cc.node = b.t join recurring.cc as r on r.node = b.s where cc.component < r.component group by 1) select node, component from cc")
def g_components(g, notes):
    return R.components(R.links(g, "CALLS"))


# --- reports

NOTES = """, notes as (select * exclude (rn) from (select *, row_number() over (partition by id order by updated_at desc nulls last, project desc) rn from human_nodes where id is not null) where rn = 1),
links as (select distinct id note_id, x node_id from (select id, unnest(cbm_node_ids) x from notes) where x > 0),
deg as (select id, count(*) d from (select source_id id from e union all select target_id from e) group by 1),
facts as (select n.id id, n.project project, n.label, n.name, n.file_path, coalesce(try_cast(""" + j("n", "complexity") + f""" as double), 0) complexity, {_TEST} is_test, coalesce({j('n', 'is_exported')} in ('true', '1'), false) or coalesce({j('n', 'exported')} in ('true', '1'), false) is_exported,
 coalesce(d, 0) degree, coalesce(c, 0) n_notes from n left join deg on deg.id = n.id left join (select node_id, count(*) c from links l group by 1) k on k.node_id = n.id),
scored as (select *, least(least(degree / 100.0, 1.0) * 0.5 + least(complexity / 20.0, 1.0) * 0.3 + case when degree > 0 and n_notes = 0 then 0.2 else 0 end, 1.0) risk from facts)
"""
_RULES = """, broken as (select id, name, label, degree, 'high_coupling' rule, case when label in ('Module', 'File') then case when degree >= 80 then 'critical' when degree >= 60 then 'high' when degree >= 40 then 'medium' end end severity from facts
 union all select id, name, label, degree, 'dead_code_candidate', case when label = 'Function' and degree = 0 and not is_exported and not is_test then 'low' end from facts
 union all select id, name, label, degree, 'fragile_interface', case when label = 'Interface' then case when degree >= 30 then 'high' when degree >= 10 then 'medium' end end from facts
 union all select id, name, label, degree, 'central_function', case when label = 'Function' then case when degree >= 50 then 'critical' when degree >= 30 then 'high' when degree >= 20 then 'medium' end end from facts
 union all select id, name, label, degree, 'no_documentation', case when label in ('Module', 'File') and n_notes = 0 and degree >= 30 then 'high' end from facts)
"""


@_q(NOTES + _RULES + "select * from broken where severity is not null order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, degree desc, id, rule limit 200")
def r_risk(g, notes):
    return P.top_risks(P.facts(g, notes))


@_q(NOTES + _RULES + "select rule, severity, count(*) n from broken where severity is not null group by 1, 2")
def r_risk_counts(g, notes):
    return P.risks(P.facts(g, notes)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@_q(NOTES + "select id, name, degree, round(risk, 6) risk from scored where label in ('Module', 'File') and degree >= 20 order by round(risk, 6) desc, id limit 100")
def r_hotspots(g, notes):
    return P.hotspots(P.facts(g, notes))


@_q(NOTES + "select id, round(risk, 6) risk from scored")
def fn_risk(g, notes):
    f = P.facts(g, notes)
    return f.select("id", F.round(P.risk_score(F.col("degree"), F.col("complexity"), F.col("n_notes")), 6).alias("risk"))


@_q(NOTES + "select label, count(*) n_undocumented, sum((degree >= 30 or complexity >= 10)::bigint)::bigint n_critical from facts where n_notes = 0 and label in ('Function', 'Method', 'Class', 'Interface', 'File') group by 1")
def r_undocumented(g, notes):
    return P.undocumented(P.facts(g, notes))


@_q(NOTES + "select id, name, label, degree, complexity, degree + complexity weight from facts where n_notes = 0 and label in ('Function', 'Method', 'Class', 'Interface', 'File') order by 6 desc, id limit 50")
def r_undoc_hotspots(g, notes):
    return P.undocumented_hotspots(P.facts(g, notes))


@_q(NOTES + "select f.project, count(*) n_nodes, any_value(coalesce(m, 0)) n_edges, sum((degree >= 20)::bigint)::bigint n_central, round(sum((degree >= 20 and n_notes > 0)::bigint) / nullif(sum((degree >= 20)::bigint), 0), 6) coverage from facts f left join (select project, count(*) m from e group by 1) x on x.project = f.project group by 1")
def r_overview(g, notes):
    return P.overview(g, P.facts(g, notes))


@_q(NOTES + "select s.project, s.file_path, sum((label <> 'File')::bigint)::bigint n_definitions, sum(degree)::bigint degree, round(max(risk), 6) max_risk, coalesce(any_value(k), 0) n_notes from scored s left join (select n.project, n.file_path, count(distinct note_id) k from links join n on n.id = node_id join notes on notes.id = note_id where notes.status <> 'deprecated' group by 1, 2) x on x.project = s.project and x.file_path = s.file_path group by 1, 2")
def r_module_context(g, notes):
    return P.module_context(g, notes, P.facts(g, notes))


@_q(
    NOTES
    + """, pick as (select id, case when label in ('File', 'Module') then 'IMPORTS' else 'CALLS' end type from n where id % 50 = 0),
 k as (select node_id, sum((label = 'BugNote')::bigint)::bigint b, sum((label = 'RefactorPlan')::bigint)::bigint r, sum((label = 'ADR')::bigint)::bigint a, sum((label = 'Convention')::bigint)::bigint c from links join notes on id = note_id where status = 'active' group by 1),
 v as (select s.id, s.name, coalesce((select count(*) from e where e.target_id = s.id and e.type = p.type), 0) n_in, coalesce((select count(*) from e where e.source_id = s.id and e.type = p.type), 0) n_out,
  coalesce((select count(distinct source_id) from e where e.target_id = s.id and e.type = p.type), 0) n_dependents, coalesce(b, 0) n_bugs, coalesce(r, 0) n_refactors, coalesce(a, 0) n_adrs, coalesce(c, 0) n_conventions,
  round(least(least(degree / 100.0, 1.0) * 0.5 + least(complexity / 20.0, 1.0) * 0.3 + case when degree > 0 and coalesce(b, 0) + coalesce(r, 0) = 0 then 0.2 else 0 end, 1.0), 6) risk
  from scored s join pick p on p.id = s.id left join k on k.node_id = s.id)
 select *, case when risk >= 0.7 then 'HIGH' when risk >= 0.4 then 'MEDIUM' else 'LOW' end as level, risk < 0.7 and n_bugs + n_refactors + n_conventions = 0 safe from v"""
)
def r_edit_context(g, notes):
    return P.edit_context(g, notes, P.facts(g, notes), g.nodes.where("id % 50 = 0").select("id"))


@_q(NOTES + "select label, count(*) n, sum((status = 'active')::bigint)::bigint n_active from notes group by 1 union all select '_total', count(*), sum((status = 'active')::bigint)::bigint from notes")
def agg_notes(g, notes):
    return P.note_counts(notes)


@_q(NOTES + "select node_id, row_number() over (partition by node_id order by updated_at desc nulls last, note_id) rank, note_id, label from links join notes on id = note_id qualify rank <= 3")
def join_human_code(g, notes):
    return P.notes_of_nodes(notes)


@_q(NOTES + "select node_id, label, count(*) n from links join notes on id = note_id group by 1, 2")
def agg_notes_by_node(g, notes):
    return P.note_links(notes).join(notes.select(F.col("id").alias("note_id"), "label"), "note_id").groupBy("node_id", "label").agg(F.count(F.lit(1)).alias("n"))


@_q(
    """, d as (select target_id id, count(*) i from calls group by 1) select n.id id, case when regexp_matches(lower(replace(coalesce(file_path, ''), '\\', '/')), '(^|/)(__tests__|tests?|specs?|fixtures)(/|$)|\\.(test|spec)\\.[^/]+$') then 'test'
 when label in ('File', 'Module', 'Package', 'Namespace', 'Class', 'Interface', 'Trait', 'Enum') then 'structural' when label = 'Route' or """
    + " or ".join(f"coalesce({j('n', k)} in ('true', '1'), false)" for k in ("is_entry_point", "is_entry"))
    + " then 'entry' when "
    + " or ".join(f"coalesce({j('n', k)} in ('true', '1'), false)" for k in ("is_exported", "exported"))
    + " then 'exported' when label in ('Function', 'Method', 'Constructor') and coalesce(i, 0) = 0 then 'dead' when label in ('Function', 'Method', 'Constructor') and i = 1 then 'single' else 'normal' end status from n left join d on d.id = n.id"
)
def fn_status(g, notes):
    return P.node_status(g)


def str_freshness(spark, sf_dir):
    """How fresh each project's index is against the latest delivery of any project."""
    nodes, projects = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "projects")
    at = nodes.agg(F.max("indexed_at").alias("now"))
    late = nodes.join(projects.select(F.col("name").alias("project"), F.col("indexed_at").alias("built")), "project").where("indexed_at > built").groupBy("project").agg(F.count_distinct("file_path").alias("changed_files"))
    state = projects.select(F.col("name").alias("project"), F.col("indexed_at").alias("built"), F.col("root_path").isNull().alias("git_failed")).join(late, "project", "left").join(F.broadcast(at), F.lit(True))
    state = state.select("project", F.lit(False).alias("stale"), F.lit(False).alias("semantics_changed"), F.coalesce("changed_files", F.lit(0)).alias("changed_files"), "git_failed", (F.unix_timestamp("now") - F.unix_timestamp("built")).alias("age_s"))
    return P.freshness(state).select("project", "changed_files", "reason", "score", "label")


_TABLE["str_freshness"] = (
    str_freshness,
    """with s as (select p.name project, p.root_path is null git_failed, coalesce((select count(distinct file_path) from nodes where nodes.project = p.name and nodes.indexed_at > p.indexed_at), 0) changed_files, epoch(date_trunc('second', (select max(indexed_at) from nodes))) - epoch(date_trunc('second', p.indexed_at)) age from projects p),
 r as (select *, case when changed_files > 0 then 'changed' when git_failed then 'unverified' when age > 3600 then 'old' else 'fresh' end reason from s),
 k as (select *, (case when changed_files > 50 then 0.2 when changed_files > 10 then 0.4 when changed_files > 0 then 0.6 when age > 86400 then 0.5 when age > 3600 then 0.8 else 1.0 end)::double score from r)
 select project, changed_files, reason, score, case when score >= 0.9 then 'FRESH' when score >= 0.7 then 'RECENT' when score >= 0.5 then 'STALE' when score >= 0.3 then 'OLD' else 'CRITICAL' end as label from k""",
)


def queries() -> dict:
    return {k: f for k, (f, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _TABLE.items() if s}
