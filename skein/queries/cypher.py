"""Queries in the graph query language, each with its SQL over the same graph."""

from __future__ import annotations

from skein.plans.cypher import query
from skein.plans.graph import PropertyGraph

#: The graph in being, as common table expressions: nodes `n`, edges `e`.
GRAPH = """with recursive n as (select id, project, label, name, qualified_name, file_path, start_line, end_line, properties_json from
 (select *, row_number() over (partition by id order by indexed_at desc nulls last, deleted_at desc nulls last, project desc nulls last) rn from nodes where id is not null) where rn = 1 and deleted_at is null),
e as (select id, project, source_id, target_id, type, properties_json from
 (select *, row_number() over (partition by id order by indexed_at desc nulls last, project desc nulls last, source_id desc, target_id desc, type desc nulls last) rn from edges
  where id is not null and source_id is not null and target_id is not null) where rn = 1),
calls as (select * from e where type = 'CALLS')
"""


def j(alias: str, key: str) -> str:
    return f"(case when json_valid({alias}.properties_json) then json_extract_string({alias}.properties_json, '$.{key}') end)"


CX = f"try_cast({j('f', 'complexity')} as double)"
_FN = "MATCH (f:Function) "
_SEL = "select f.id id, f.name name from n f where f.label = 'Function' and "

#: name -> (graph query, SQL behind GRAPH)
TABLE: dict[str, tuple[str, str]] = {
    # scans
    "src_scan_label": ("MATCH (f:Interface) RETURN f.id AS id, f.name AS name", "select id, name from n where label = 'Interface'"),
    "src_scan_label_alt": ("MATCH (f:Interface|Class) RETURN f.id AS id, f.label AS label", "select id, label from n where label in ('Interface', 'Class')"),
    "src_scan_all": ("MATCH (f) RETURN f.id AS id, f.name AS name ORDER BY name, id", "select id, name from n"),
    # conditions
    "flt_eq": (_FN + "WHERE f.name = 'logEvent' RETURN f.id AS id, f.name AS name", _SEL + "f.name = 'logEvent'"),
    "flt_neq": (_FN + "WHERE f.name <> 'logEvent' AND f.project != 'atlas-core' RETURN f.id AS id, f.name AS name", _SEL + "f.name <> 'logEvent' and f.project <> 'atlas-core'"),
    "flt_cmp": (_FN + "WHERE f.complexity >= 20 AND f.start_line < 100 RETURN f.id AS id, f.name AS name", _SEL + f"{CX} >= 20 and f.start_line < 100"),
    "flt_regex": (_FN + "WHERE f.name =~ '^(parse|scan).*er$' RETURN f.id AS id, f.name AS name", _SEL + "regexp_matches(f.name, '^(parse|scan).*er$')"),
    "flt_contains": (_FN + "WHERE f.name CONTAINS 'Guard' RETURN f.id AS id, f.name AS name", _SEL + "contains(f.name, 'Guard')"),
    "flt_starts": (_FN + "WHERE f.name STARTS WITH 'parse' RETURN f.id AS id, f.name AS name", _SEL + "starts_with(f.name, 'parse')"),
    "flt_ends": (_FN + "WHERE f.name ENDS WITH 'Walker' RETURN f.id AS id, f.name AS name", _SEL + "ends_with(f.name, 'Walker')"),
    "flt_in": (_FN + "WHERE f.name IN ['logEvent', 'readSetting'] OR f.complexity IN [7, 9] RETURN f.id AS id, f.name AS name", _SEL + f"(f.name in ('logEvent', 'readSetting') or coalesce({CX} in (7, 9), false))"),
    "flt_null": (_FN + "WHERE f.start_line IS NULL OR f.complexity IS NULL RETURN f.id AS id, f.name AS name", _SEL + f"(f.start_line is null or coalesce({j('f', 'complexity')}, '') = '')"),
    "flt_not_null": (_FN + "WHERE f.complexity IS NOT NULL RETURN f.id AS id, f.name AS name", _SEL + f"coalesce({j('f', 'complexity')}, '') <> ''"),
    "flt_label": ("MATCH (f) WHERE f:Method RETURN f.id AS id, f.name AS name", "select id, name from n where label = 'Method'"),
    "flt_exists": (_FN + "WHERE EXISTS { (f)<-[:TESTS]-() } RETURN f.id AS id, f.name AS name", _SEL + "exists (select 1 from e where e.target_id = f.id and type = 'TESTS')"),
    "flt_not_exists": (_FN + "WHERE NOT EXISTS { (f)<-[:CALLS]-() } AND f.complexity > 10 RETURN f.id AS id, f.name AS name", _SEL + f"not exists (select 1 from calls where calls.target_id = f.id) and {CX} > 10"),
    "flt_exists_any": (_FN + "WHERE EXISTS { (f)-[:EMITS]-() } OR f.name = 'logEvent' RETURN f.id AS id, f.name AS name", _SEL + "(exists (select 1 from e where type = 'EMITS' and (e.target_id = f.id or e.source_id = f.id)) or f.name = 'logEvent')"),
    "flt_bool": (_FN + "WHERE (f.complexity > 20 XOR f.start_line > 300) AND NOT f.project = 'atlas-core' RETURN f.id AS id, f.name AS name", _SEL + f"({CX} > 20) <> (f.start_line > 300) and not f.project = 'atlas-core'"),
    "flt_inline": ("MATCH (f:Function {name: 'logEvent'}) RETURN f.id AS id, f.name AS name", _SEL + "f.name = 'logEvent'"),
    "flt_inline_regex": ("MATCH (f:Function {name: '^parse.*'}) RETURN f.id AS id, f.name AS name", _SEL + "regexp_matches(f.name, '^parse.*')"),
    "flt_bool_lit": (_FN + "WHERE f.is_exported = true RETURN f.id AS id, f.name AS name", _SEL + f"lower({j('f', 'is_exported')}) = 'true'"),
    "flt_post_with": ("MATCH (f:Function) WITH f.project AS project, count(f) AS n WHERE n > 20 RETURN project, n", "select project, count(*) n from n where label = 'Function' group by 1 having count(*) > 20"),
    "quirk_unbound": (
        "MATCH (c:Class) OPTIONAL MATCH (c)<-[:INHERITS]-(x:Class) RETURN c.id AS id, count(x) AS n, count(*) AS n_rows",
        "select c.id id, count(x.id) n, count(*) n_rows from n c left join (select x.id, e.target_id t from e join n x on x.id = e.source_id and x.label = 'Class' where e.type = 'INHERITS') x on x.t = c.id where c.label = 'Class' group by 1",
    ),
    # projections
    "proj_items": ("MATCH (i:Interface) RETURN i.name, i.start_line AS line, labels(i) AS labels", "select name i_name, start_line line, [label] labels from n where label = 'Interface'"),
    "proj_expr": (
        "MATCH (f:Function) RETURN f.id AS id, f AS shown, CASE WHEN f.complexity > 15 THEN 'high' WHEN f.complexity > 5 THEN 'mid' ELSE 'low' END AS level",
        f"select f.id id, f.name shown, case when {CX} > 15 then 'high' when {CX} > 5 then 'mid' else 'low' end as level from n f where label = 'Function'",
    ),
    "proj_star": (
        "MATCH (c:Function)-[r:INHERITS]->(d:Function) RETURN *",
        """select c.name c_name, c.qualified_name c_qualified_name, c.label c_label, c.file_path c_file_path, e.type r, d.name d_name, d.qualified_name d_qualified_name, d.label d_label, d.file_path d_file_path
        from e join n c on c.id = e.source_id join n d on d.id = e.target_id where e.type = 'INHERITS' and c.label = 'Function' and d.label = 'Function'""",
    ),
    "proj_default": ("MATCH (i:Interface)", 'select name i_name, qualified_name i_qualified_name, label i_label from n where label = \'Interface\''),
    "proj_with": (
        "MATCH (c:File)-[:DEFINES]->(m) WITH c, count(m) AS members WHERE members > 1 RETURN c.name AS name, c.file_path AS path, members",
        "select c.name name, c.file_path path, count(*) members from e join n c on c.id = e.source_id join n m on m.id = e.target_id where e.type = 'DEFINES' and c.label = 'File' group by c.id, c.name, c.file_path having count(*) > 1",
    ),
    "proj_property": (
        "MATCH (f:Function) WHERE f.in_degree > 3 RETURN f.id AS id, f.in_degree AS fan_in, f.out_degree AS fan_out, f.is_exported AS exported",
        f"""select f.id id, coalesce(i.c, 0) fan_in, coalesce(o.c, 0) fan_out, {j('f', 'is_exported')} exported from n f left join (select target_id t, count(*) c from calls group by 1) i on i.t = f.id
        left join (select source_id s, count(*) c from calls group by 1) o on o.s = f.id where f.label = 'Function' and i.c > 3""",
    ),
    "proj_grammar": ("match (f:Function) /* all */ where f.name = \"logEvent\" // one\n return f.id as id, 1.5 as x, 'a\\'b' as q", "select f.id id, 1.5::double x, 'a''b' q from n f where label = 'Function' and name = 'logEvent'"),
    # joins
    "join_expand_1": ("MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a.id AS a, b.id AS b", "select a.id a, b.id b from calls join n a on a.id = source_id and a.label = 'Function' join n b on b.id = target_id and b.label = 'Function'"),
    "join_expand_in": ("MATCH (a:Class)<-[r:INHERITS|IMPLEMENTS]-(b) RETURN a.id AS a, b.id AS b, type(r) AS kind", "select a.id a, b.id b, e.type kind from e join n a on a.id = target_id and a.label = 'Class' join n b on b.id = source_id where e.type in ('INHERITS', 'IMPLEMENTS')"),
    "join_expand_any": (
        "MATCH (a:Interface)-[r]-(b) RETURN a.id AS a, b.id AS b, id(r) AS r",
        "select a.id a, b.id b, e.id r from e join n a on a.id = source_id and a.label = 'Interface' join n b on b.id = target_id union all select a.id, b.id, e.id from e join n a on a.id = target_id and a.label = 'Interface' join n b on b.id = source_id",
    ),
    "join_bound": ("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(a) RETURN a.id AS a, b.id AS b", "select a.id a, b.id b from calls x join calls y on x.target_id = y.source_id and y.target_id = x.source_id join n a on a.id = x.source_id join n b on b.id = x.target_id"),
    "join_chain": (
        "MATCH (a:File)-[:DEFINES]->(b:Function)-[:CALLS]->(c:Function) RETURN a.id AS a, b.id AS b, c.id AS c",
        "select a.id a, b.id b, c.id c from e join n a on a.id = source_id and a.label = 'File' join n b on b.id = target_id and b.label = 'Function' join calls k on k.source_id = b.id join n c on c.id = k.target_id and c.label = 'Function' where e.type = 'DEFINES'",
    ),
    "join_optional": (
        "MATCH (f:Function) OPTIONAL MATCH (f)-[:EMITS]->(g) RETURN f.id AS f, g.id AS g",
        "select f.id f, g.id g from n f left join (select e.source_id s, g.id from e join n g on g.id = e.target_id where e.type = 'EMITS') g on g.s = f.id where f.label = 'Function'",
    ),
    "join_optional_where": (
        "MATCH (f:Class) OPTIONAL MATCH (f)-[:DEFINES]->(g) WHERE g.start_line > f.start_line RETURN f.id AS f, g.id AS g",
        "select f.id f, g.id g from n f left join (select e.source_id s, g.id, g.start_line from e join n g on g.id = e.target_id where e.type = 'DEFINES') g on g.s = f.id and g.start_line > f.start_line where f.label = 'Class'",
    ),
    "join_var_len": (
        "MATCH (a:Interface)<-[:IMPLEMENTS|INHERITS*1..3]-(b) RETURN a.id AS a, b.id AS b",
        """, step as (select distinct target_id s, source_id t from e where type in ('IMPLEMENTS', 'INHERITS')), w as (select distinct a.id a, t b, 1 hop from n a join step on s = a.id where a.label = 'Interface'
        union select w.a, step.t, hop + 1 from w join step on step.s = w.b where hop < 3) select w.a, w.b from w join n on n.id = w.b""",
    ),
    "join_var_len_any": (
        "MATCH (a:Interface)-[:INHERITS*1..2]-(b) RETURN DISTINCT a.id AS a, b.id AS b",
        """, step as (select target_id s, source_id t from e where type = 'INHERITS' union select source_id, target_id from e where type = 'INHERITS')
        select distinct a.id a, b.id b from n a join (select s, t from step union select x.s, y.t from step x join step y on x.t = y.s) w on w.s = a.id join n b on b.id = w.t where a.label = 'Interface'""",
    ),
    "join_multi_match": (
        "MATCH (a:File)-[:DEFINES]->(b:Function) MATCH (b)-[:CALLS]->(c:Method) RETURN a.id AS a, b.id AS b, c.id AS c",
        "select a.id a, b.id b, c.id c from e join n a on a.id = source_id and a.label = 'File' join n b on b.id = target_id and b.label = 'Function' join calls k on k.source_id = b.id join n c on c.id = k.target_id and c.label = 'Method' where e.type = 'DEFINES'",
    ),
    "join_reverse": (
        "MATCH (b:Method {name: '^(load|save|read).*'}) MATCH (a:Function)-[:CALLS]->(b) RETURN a.id AS a, b.id AS b",
        "select a.id a, b.id b from calls join n a on a.id = source_id and a.label = 'Function' join n b on b.id = target_id and b.label = 'Method' and regexp_matches(b.name, '^(load|save|read).*')",
    ),
    "join_cross": ("MATCH (a:Interface), (b:Interface) WHERE a.id < b.id AND a.name = b.name RETURN a.id AS a, b.id AS b", "select a.id a, b.id b from n a, n b where a.label = 'Interface' and b.label = 'Interface' and a.id < b.id and a.name = b.name"),
    # aggregates
    "agg_count": ("MATCH (a)-[r:CALLS]->(b) RETURN count(*) AS n, count(r) AS edges, count(a.start_line) AS lines", "select count(*) n, count(*) edges, count(a.start_line) as lines from calls join n a on a.id = source_id join n b on b.id = target_id"),
    "agg_count_distinct": ("MATCH (a)-[:CALLS]->(b) RETURN count(DISTINCT a.project) AS projects, count(DISTINCT b) AS targets", "select count(distinct a.project) projects, count(distinct b.id) targets from calls join n a on a.id = source_id join n b on b.id = target_id"),
    "agg_sum": ("MATCH (f:Function) RETURN f.project AS project, sum(f.complexity) AS total", f"select f.project project, sum({CX}) total from n f where label = 'Function' group by 1"),
    "agg_avg": ("MATCH (f:Function) RETURN f.project AS project, avg(f.complexity) AS mean", f"select f.project project, avg({CX}) mean from n f where label = 'Function' group by 1"),
    "agg_min_max": ("MATCH (f:Function) RETURN f.project AS project, min(f.complexity) AS lo, max(f.end_line) AS hi", f"select f.project project, min({CX}) lo, max(end_line)::double hi from n f where label = 'Function' group by 1"),
    "agg_collect": ("MATCH (c:Class)-[:INHERITS]->(d) RETURN c.id AS id, collect(d.name) AS parents", "select c.id id, list_sort(list(d.name)) parents from e join n c on c.id = source_id and c.label = 'Class' join n d on d.id = target_id where e.type = 'INHERITS' group by 1"),
    "agg_group": ("MATCH (f) RETURN f.project AS project, f.label AS label, count(*) AS n", "select project, label, count(*) n from n group by all"),
    "agg_with": (
        "MATCH (f:Function)-[:CALLS]->(g) WITH f.project AS project, g.label AS label, count(*) AS n RETURN label, sum(n) AS total, max(n) AS most",
        "select label, sum(n)::double total, max(n)::double most from (select f.project, g.label, count(*) n from calls join n f on f.id = source_id and f.label = 'Function' join n g on g.id = target_id group by all) group by 1",
    ),
    "quirk_func_group": ("MATCH (f:Function) RETURN toLower(f.label) AS label, count(*) AS n", "select lower(label) label, count(*) n from n where label = 'Function' group by 1"),
    # order, limits, sets
    "srt_order": ("MATCH (f:Function) RETURN f.id AS id, f.complexity AS c ORDER BY f.start_line DESC, id LIMIT 50", f"select f.id id, {j('f', 'complexity')} c from n f where label = 'Function' order by start_line desc nulls last, id limit 50"),
    "srt_with": ("MATCH (f:Function) WITH f.project AS project, count(*) AS n ORDER BY n DESC, project LIMIT 5 RETURN project, n", "select project, count(*) n from n where label = 'Function' group by 1 order by n desc, project limit 5"),
    "lim_skip": ("MATCH (f:Function) RETURN f.id AS id ORDER BY id SKIP 10 LIMIT 20", "select id from n where label = 'Function' order by id limit 20 offset 10"),
    "lim_zero": ("MATCH (f:Function) RETURN f.id AS id LIMIT 0", "select id from n limit 0"),
    "quirk_distinct_after_limit": ("MATCH (f:Function) RETURN DISTINCT f.project AS project ORDER BY project LIMIT 3", "select distinct project from n where label = 'Function' order by 1 limit 3"),
    "set_union_all": ("MATCH (c:Class) RETURN c.project AS p UNION ALL MATCH (i:Interface) RETURN i.project AS p", "select project p from n where label in ('Class', 'Interface')"),
    "set_union": ("MATCH (c:Class) RETURN c.project AS p UNION MATCH (i:Interface) RETURN i.project AS p", "select distinct project p from n where label in ('Class', 'Interface')"),
    "set_distinct": ("MATCH (f:Function) RETURN DISTINCT f.project AS project, f.name AS name", "select distinct project, name from n where label = 'Function'"),
    "set_unwind": ("UNWIND ['Class', 'Interface'] AS kind MATCH (x) WHERE x.label = kind RETURN kind, count(*) AS n", "select label kind, count(*) n from n where label in ('Class', 'Interface') group by 1"),
    # scalar functions
    "fn_case_change": (_FN + "RETURN f.id AS id, toLower(f.name) AS l, toUpper(f.name) AS u, toString(f.start_line) AS t", "select id, lower(name) l, upper(name) u, start_line::varchar t from n where label = 'Function'"),
    "fn_to_number": (
        _FN + "RETURN f.id AS id, toInteger(f.complexity) AS i, toFloat(f.complexity) AS x, toBoolean(f.is_exported) AS b",
        f"select f.id id, try_cast(regexp_extract({j('f', 'complexity')}, '^\\s*([-+]?\\d+)', 1) as bigint) i, {CX} x, case lower({j('f', 'is_exported')}) when 'true' then true when 'false' then false end b from n f where label = 'Function'",
    ),
    "fn_size": (_FN + "RETURN f.id AS id, size(f.qualified_name) AS s, length(f.name) AS l", "select id, strlen(qualified_name) s, strlen(name) l from n where label = 'Function'"),
    "fn_trim": (_FN + "RETURN f.id AS id, trim(' \\t x ') AS t, ltrim(' x ') AS l, rtrim(' x ') AS r", "select id, 'x' t, 'x ' l, ' x' r from n where label = 'Function'"),
    "fn_reverse": (_FN + "RETURN f.id AS id, reverse(f.name) AS r", "select id, reverse(name) r from n where label = 'Function'"),
    "fn_coalesce": (_FN + "RETURN f.id AS id, coalesce(f.nothing, f.complexity, 'none') AS c", f"select f.id id, coalesce(nullif({j('f', 'complexity')}, ''), 'none') c from n f where label = 'Function'"),
    "fn_substring": (_FN + "RETURN f.id AS id, substring(f.name, 2, 4) AS s, substring(f.name, 3) AS t", "select id, substring(name, 3, 4) s, substring(name, 4) t from n where label = 'Function'"),
    "fn_left_right": (_FN + "RETURN f.id AS id, left(f.name, 3) AS l, right(f.name, 3) AS r, replace(f.name, 'a', '4') AS x", 'select id, "left"(name, 3) l, "right"(name, 3) r, replace(name, \'a\', \'4\') x from n where label = \'Function\''),
    "fn_labels": ("MATCH (c:Class)-[r]->(d) RETURN id(c) AS c, labels(d) AS d, type(r) AS t, properties(r) AS p", "select c.id c, [d.label] d, e.type t, e.properties_json p from e join n c on c.id = source_id and c.label = 'Class' join n d on d.id = target_id"),
    "fn_json": (
        "MATCH ()-[r:CALLS]->() WHERE r.confidence >= 0.5 RETURN id(r) AS id, r.resolution AS resolution, r.line AS line",
        f"select e.id id, {j('e', 'resolution')} resolution, {j('e', 'line')} line from e join n a on a.id = source_id join n b on b.id = target_id where type = 'CALLS' and try_cast({j('e', 'confidence')} as double) >= 0.5",
    ),
    "fn_case": ("MATCH (a)-[r]->(b:Interface) RETURN id(r) AS id, CASE WHEN type(r) = 'IMPLEMENTS' THEN b.name ELSE 'other' END AS target", "select e.id id, case when type = 'IMPLEMENTS' then b.name else 'other' end target from e join n a on a.id = source_id join n b on b.id = target_id and b.label = 'Interface'"),
}


def _run(text: str):
    def run(spark, sf_dir):
        df = query(PropertyGraph.from_tables(spark, sf_dir), text)
        return df.toDF(*[c.replace(".", "_") for c in df.columns])  # plain names for any reader

    return run


def queries() -> dict:
    return {name: _run(text) for name, (text, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: GRAPH + sql for name, (_, sql) in TABLE.items()}
