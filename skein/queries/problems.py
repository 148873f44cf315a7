"""Queries of the general data problems (p1 to p4, p6, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.changefeed import ChangeTable, Effect, Effects
from skein.operators.hotkeys import hot_keys, key_profile, split_join
from skein.operators.nested import object_graph, object_store, occurrences_of
from skein.operators.orphans import References, orphan_references, record_states
from skein.operators.snapshots import json_form, ordered_generations, snapshot_changes
from skein.operators.tablediff import number_form, table_diff
from skein.session import materialize, table

HOT_SHARE = 0.02
_QUANTILES = {"q25": 0.25, "median": 0.5, "q90": 0.9}


def _weight():
    return F.get_json_object("properties_json", "$.weight").try_cast("double")


# --- p1: a few keys holding most records


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "edges"), ["target_id", "type"], HOT_SHARE).select("field", "hot_key")


def _profile(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return key_profile(table(spark, sf_dir, "edges"), [key], _weight(), _QUANTILES).select(
        key, "n_rows", "n_values", F.round("sum_value", 6).alias("sum_value"), "min_value", "max_value", *_QUANTILES
    )


def p1_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "target_id")


def p1_type_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "type")


def p1_target_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the rows, distinct edges, distinct sources and distinct types; the distinct
    counts go through (target, source, type) first, so a hot target is spread over its sources."""
    edges = table(spark, sf_dir, "edges").where("target_id is not null")
    pairs = edges.groupBy("target_id", "source_id", "type").agg(F.count(F.lit(1)).alias("n"))
    by_source = pairs.groupBy("target_id", "source_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    by_type = pairs.where("type is not null").groupBy("target_id", "type").agg(F.lit(1).alias("one"))
    degrees = by_source.groupBy("target_id").agg(F.sum("n").alias("n_rows"), F.sum("kinds").alias("n_edges"), F.count("source_id").alias("n_sources"))
    types = by_type.groupBy("target_id").agg(F.count("one").alias("n_types"))
    return degrees.join(types, "target_id", "left").select("target_id", "n_rows", "n_edges", "n_sources", F.coalesce("n_types", F.lit(0)).alias("n_types"))


_RANKED = """
with v as (select {key} k, try_cast(case when json_valid(properties_json) then properties_json::json->>'$.weight' end as double) w from edges),
r as (select k, w, row_number() over (partition by k order by w) rn, count(*) over (partition by k) n from v where w is not null),
q as (select k, max(case when rn = greatest(1, ceil(0.25*n)) then w end) q25, max(case when rn = greatest(1, ceil(0.5*n)) then w end) median,
      max(case when rn = greatest(1, ceil(0.9*n)) then w end) q90 from r group by k)
select t.k as {key}, n_rows, n_values, sum_value, min_value, max_value, q25, median, q90 from
 (select k, count(*) n_rows, count(w) n_values, round(sum(w), 6) sum_value, min(w) min_value, max(w) max_value from v group by k) t
 left join q on t.k is not distinct from q.k"""

# --- p2: references to records that do not exist


def _orphans(spark: SparkSession, sf_dir: str, inherited: bool) -> DataFrame:
    states = record_states(table(spark, sf_dir, "nodes"), "id", "indexed_at", "deleted_at", "project", "qualified_name")
    qn = F.col("qualified_name")
    inside = F.substring_index(qn, "::", -1)
    container = F.when(
        qn.contains("::"),
        F.when(inside.contains("."), F.regexp_replace(qn, r"\.[^.]*$", "")).otherwise(F.regexp_replace(qn, r"::(?!.*::).*$", "")),
    )
    # a name without a project is its own place
    place = lambda name: F.concat_ws("\u0001", F.coalesce("project", F.lit("\u0002")), name)
    held = states.where(container.isNotNull()).select(F.col("node_id").alias("child"), place(container).alias("place"))
    holders = states.where(qn.isNotNull() & F.col("project").isNotNull()).select(F.col("node_id").alias("parent"), place(qn).alias("place"))
    links = split_join(held, holders, "place").select("child", "parent") if inherited else None
    edges, notes = table(spark, sf_dir, "edges"), table(spark, sf_dir, "human_nodes")
    return orphan_references(
        states,
        links,
        References("edges", edges, F.col("id"), F.col("indexed_at"), {"source_id": F.col("source_id"), "target_id": F.col("target_id")}),
        References("human_nodes", notes, F.col("id"), F.col("updated_at"), {"cbm_node_ids": F.filter("cbm_node_ids", lambda x: x > 0)}),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct orphans, which are the cascade's first round; later rounds add inherited ones."""
    return _orphans(spark, sf_dir, inherited=False).select("ref_table", "ref_field", "ref_id", "node_id", "reason").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _orphans(spark, sf_dir, inherited=True)
        .select("ref_table", "ref_field", "ref_id", "node_id", F.date_format("ref_time", "yyyy-MM").alias("month"), "kind", "reason")
        .distinct()
        .groupBy("ref_table", "ref_field", "month", "kind", "reason")
        .agg(F.count(F.lit(1)).alias("n_references"))
    )


_REFS = """
with state as (select id, min(indexed_at) first_at, arg_max(deleted_at is not null, (indexed_at, deleted_at is not null)) deleted from nodes where id is not null group by id),
refs as (
 select 'edges' ref_table, 'source_id' ref_field, id ref_id, source_id node_id, indexed_at t from edges where source_id is not null
 union all select 'edges', 'target_id', id, target_id, indexed_at from edges where target_id is not null
 union all select 'human_nodes', 'cbm_node_ids', id, x, updated_at from (select id, updated_at, unnest(cbm_node_ids) x from human_nodes) where x > 0)
"""
_P2 = (
    _REFS
    + """select distinct ref_table, ref_field, ref_id, node_id, case when s.id is null then 'missing' when deleted then 'deleted' else 'late' end reason
from refs left join state s on s.id = refs.node_id where s.id is null or deleted or first_at > t"""
)
_P2_REPORT = """
with recursive latest as (select id, min(indexed_at) first_at, arg_max({'d': deleted_at is not null, 'p': project, 'q': qualified_name}, (indexed_at, deleted_at is not null)) s from nodes where id is not null group by id),
state as (select id, first_at, s.d deleted, s.p project, s.q qn from latest),
held as (select id child, project, case when contains(regexp_extract(qn, '.*::(.*)$', 1), '.') then regexp_replace(qn, '\\.[^.]*$', '') else regexp_extract(qn, '^(.*)::', 1) end container
 from state where contains(qn, '::') and not deleted),
links as (select child, s.id parent, s.deleted dead from held left join state s on s.project = held.project and s.qn = held.container),
orphan as (select distinct child id from links where parent is null or dead union select l.child from links l join orphan o on l.parent = o.id),
refs as (
 select 'edges' ref_table, 'source_id' ref_field, id ref_id, source_id node_id, indexed_at t from edges where source_id is not null
 union all select 'edges', 'target_id', id, target_id, indexed_at from edges where target_id is not null
 union all select 'human_nodes', 'cbm_node_ids', id, x, updated_at from (select id, updated_at, unnest(cbm_node_ids) x from human_nodes) where x > 0),
told as (select distinct ref_table, ref_field, ref_id, node_id, strftime(t, '%Y-%m') as month,
 case when s.id is null then 'missing' when deleted then 'deleted' when first_at > t then 'late' when o.id is not null then 'orphaned' end reason
 from refs left join state s on s.id = refs.node_id left join (select distinct id from orphan) o on o.id = refs.node_id)
select ref_table, ref_field, month, case when reason = 'orphaned' then 'inherited' else 'direct' end kind, reason, count(*) n_references from told where reason is not null group by all"""

# --- p3: what changed between full snapshots


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = table(spark, sf_dir, "node_snapshots"), table(spark, sf_dir, "edge_snapshots")
    order = materialize(ordered_generations(nodes, table(spark, sf_dir, "generation_catalog")), "generations")
    form = json_form(F.col("properties_json"))
    of_nodes = snapshot_changes(nodes, order, ["qualified_name"], [*map(F.col, ("label", "name", "file_path", "start_line", "end_line")), form])
    of_edges = snapshot_changes(edges, order, ["source_qn", "target_qn", "type"], [form])
    return of_nodes.select(
        F.lit("node").alias("record_kind"), "generation_id", F.col("k0").alias("record_qn"), F.lit("").alias("target_qn"), F.lit("").alias("edge_type"), "change_kind"
    ).unionByName(
        of_edges.select(F.lit("edge").alias("record_kind"), "generation_id", F.col("k0").alias("record_qn"), F.col("k1").alias("target_qn"), F.col("k2").alias("edge_type"), "change_kind")
    )


_P3 = """
with g as (select project, generation_id, row_number() over (partition by project order by since nulls first, generation_id) seq, lead(generation_id) over (partition by project order by since nulls first, generation_id) nxt
 from (select distinct project, generation_id from node_snapshots) left join (select generation_id, min(first_published_at) since from generation_catalog group by 1) using (generation_id)),
forms as (select j, case when json_valid(j) then list_sort(list_transform(json_keys(j), lambda k: k || '=' || json_extract(j, '$."' || k || '"')::varchar))::varchar else j end form
 from (select properties_json j from node_snapshots union select properties_json from edge_snapshots)),
r as (select 'node' record_kind, project, generation_id, qualified_name a, '' b, '' c, row(label, name, file_path, start_line, end_line, form)::varchar v from node_snapshots left join forms on j is not distinct from properties_json
 union select 'edge', project, generation_id, source_qn, target_qn, type, row(form)::varchar from edge_snapshots left join forms on j is not distinct from properties_json),
s as (select record_kind, project, a, b, c, seq, r.generation_id, nxt, max(v) v from r join g using (project, generation_id) group by all),
p as (select cur.*, prev.v pv, prev.seq ps from s cur left join s prev on cur.record_kind = prev.record_kind and cur.project = prev.project and cur.a is not distinct from prev.a and cur.b is not distinct from prev.b and cur.c is not distinct from prev.c and prev.seq = cur.seq - 1)
select record_kind, generation_id, a record_qn, b target_qn, c edge_type, case when ps is null then 'added' else 'changed' end change_kind from p where seq > 1 and (ps is null or v is distinct from pv)
union all
select cur.record_kind, cur.nxt, cur.a, cur.b, cur.c, 'removed' from s cur left join s n on cur.record_kind = n.record_kind and cur.project = n.project and cur.a is not distinct from n.a and cur.b is not distinct from n.b and cur.c is not distinct from n.c and n.seq = cur.seq + 1
where cur.nxt is not null and n.seq is null"""

# --- p4: differences between two copies


def _copy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    kept = ("project", "qualified_name", "label", "name", "start_line", "end_line")
    state = nodes.groupBy("id").agg(F.max(F.struct("indexed_at", "deleted_at", *kept)).alias("s")).select(*[f"s.{c}" for c in kept])
    exact = {c: (F.col(c), F.col(c)) for c in ("label", "name")}
    lines = {c: (number_form(F.col(c)), number_form(F.col(c))) for c in ("start_line", "end_line")}
    return table_diff(state, table(spark, sf_dir, "nodes_copy"), ["project", "qualified_name"], exact | lines)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("presence") == "only_left", F.array(F.lit("only_nodes"))).when(F.col("presence") == "only_right", F.array(F.lit("only_copy"))).otherwise(F.col("differences.field"))
    return _copy_diff(spark, sf_dir).select("project", "qualified_name", F.explode(named).alias("difference"))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["project", "qualified_name", "presence", "n_left", "n_right"]
    return _copy_diff(spark, sf_dir).select(*kept, F.explode_outer("differences").alias("d")).select(*kept, "d.field", "d.left_value", "d.right_value")


_P4_BOTH = """
with ls as (select project, qualified_name, label, name, start_line::double::varchar start_line, end_line::double::varchar end_line from
  (select *, row_number() over (partition by id order by indexed_at desc, deleted_at desc nulls last) rn from nodes) where rn = 1),
rs as (select project, qualified_name, label, name, coalesce(try_cast(trim(start_line) as double)::varchar, nullif(trim(start_line), '')) start_line, coalesce(try_cast(trim(end_line) as double)::varchar, nullif(trim(end_line), '')) end_line from nodes_copy),
l as (select *, count(*) n_left from ls group by all), r as (select *, count(*) n_right from rs group by all),
b as (select coalesce(n_left, 0) n_left, coalesce(n_right, 0) n_right, coalesce(l.project, r.project) project, coalesce(l.qualified_name, r.qualified_name) qualified_name, l.qualified_name lq, r.qualified_name rq,
 l.label ll, r.label rl, l.name ln, r.name rn, l.start_line ls, r.start_line rs, l.end_line le, r.end_line re from l full join r on l.project = r.project and l.qualified_name = r.qualified_name)
"""
_P4 = (
    _P4_BOTH
    + """select project, qualified_name, unnest(list_filter([case when rq is null then 'only_nodes' when lq is null then 'only_copy' end,
 case when lq is not null and rq is not null and ll is distinct from rl then 'label' end, case when lq is not null and rq is not null and ln is distinct from rn then 'name' end,
 case when lq is not null and rq is not null and ls is distinct from rs then 'start_line' end, case when lq is not null and rq is not null and le is distinct from re then 'end_line' end], lambda x: x is not null)) difference from b"""
)

# --- p6: applying a stream of inserts, updates, deletes


#: What the actions of the publication feed do to a generation.
PUBLICATION = Effects(
    {"status": "string", "pinned": "bigint"},
    {
        "PUBLISH": Effect({"status": "ACTIVE", "pinned": 0}, {"status": "ACTIVE"}),
        "DELETE": Effect(None, None),
        "MARK_DELETING": Effect(None, {"status": "DELETING"}),
        "RECOVER": Effect(None, {"status": "ACTIVE"}),
        "PIN": Effect(None, {"pinned": 1}),
        "UNPIN": Effect(None, {"pinned": 0}),
    },
)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed comes in four batches, by history_id as they were written down; three of them are
    compacted into one run before the last comes."""
    feed = table(spark, sf_dir, "publication_history").select(
        F.col("project").alias("scope"),
        F.col("cas_revision").alias("seq"),
        F.lower(F.trim("generation_id")).alias("record"),
        F.upper(F.trim("action")).alias("action"),
        F.col("history_id").alias("tie"),
    )
    low, high = feed.agg(F.min("tie"), F.max("tie")).first()
    batch = F.least(F.lit(3), F.floor((F.col("tie") - F.lit(low)) * 4 / (F.lit(high) - F.lit(low) + 1))) if low is not None else F.lit(0)
    changes = ChangeTable(spark, PUBLICATION, fan_in=3)
    for n in range(4):
        changes.append(feed.where(F.coalesce(batch, F.lit(0)) == n))
    return changes.read().select(F.col("scope").alias("project"), F.col("record").alias("generation_id"), "status", "pinned")


_P6 = """
with f as (select project, cas_revision rev, arg_min(lower(trim(generation_id)), history_id) gen, arg_min(upper(trim(action)), history_id) act from publication_history
  where project is not null and cas_revision is not null and generation_id is not null group by 1, 2),
d as (select project, gen, max(rev) filter (act = 'DELETE') del, max(rev) filter (act = 'PUBLISH') pub from f group by all),
s as (select f.project, f.gen, min(rev) filter (act = 'PUBLISH' and rev > coalesce(del, -1)) born, arg_max(act, rev) filter (act in ('PUBLISH', 'MARK_DELETING', 'RECOVER')) st,
  arg_max(act, rev) filter (act in ('PIN', 'UNPIN')) pin, max(rev) filter (act in ('PIN', 'UNPIN')) pinned_at
  from f join d on f.project = d.project and f.gen = d.gen where pub > coalesce(del, -1) group by all)
select project, gen generation_id, case when st = 'MARK_DELETING' then 'DELETING' else 'ACTIVE' end status, case when pin = 'PIN' and pinned_at > born then 1 else 0 end::bigint pinned from s"""

# --- p7: deeply nested records


def _json_sources(spark: SparkSession, sf_dir: str):
    return (
        ("nodes", table(spark, sf_dir, "nodes"), "id", "properties_json"),
        ("edges", table(spark, sf_dir, "edges"), "id", "properties_json"),
        ("human_nodes", table(spark, sf_dir, "human_nodes"), "id", "frontmatter_json"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record with several texts may hold a path in more than one of them; it counts once."""
    graph = object_graph(*_json_sources(spark, sf_dir), columns=("parent_path", "child_path"), nested_only=True)
    return occurrences_of(*graph).drop("root_hash").distinct()


def p7_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences_of(*object_graph(*_json_sources(spark, sf_dir), columns=("parent_path", "child_path", "depth", "ordinal", "parent_hash", "object_hash")))


def p7_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_store(*object_graph(*_json_sources(spark, sf_dir), columns=("object_hash", "fields")))


def p7_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects the records of each table hold at each depth."""
    rows = occurrences_of(*object_graph(*_json_sources(spark, sf_dir), columns=("child_path", "depth"))).drop("root_hash").distinct()
    return rows.groupBy("src_table", "depth").agg(F.count(F.lit(1)).alias("n_objects"))


_JSON = """
with recursive t as (select distinct 'nodes' src_table, id src_id, properties_json j from nodes union select 'edges', id, properties_json from edges union select 'human_nodes', id, frontmatter_json from human_nodes),
v as (select src_table, src_id, json(j) j from t where json_valid(j) union select src_table, src_id, json(j->>'$') from v where json_type(j) = 'VARCHAR' and json_valid(j->>'$')),
w as (select src_table, src_id, '' held, '' path, 0 depth, null::varchar parent, j from v where json_type(j) in ('OBJECT', 'ARRAY')
 union all select src_table, src_id, case when json_type(x) = 'OBJECT' then p else held end, p, depth + (json_type(x) = 'OBJECT')::int, held, x from (
  select src_table, src_id, held, depth, case when path = '' then k else path || '.' || k end p, json_extract(j, '/' || replace(replace(k, '~', '~0'), '/', '~1')) x from (select *, unnest(json_keys(j)) k from w where json_type(j) = 'OBJECT')
  union all select src_table, src_id, held, depth, path || '[' || i || ']', json_extract(j, '/' || i) from (select *, unnest(range(json_array_length(j)::bigint)) i from w where json_type(j) = 'ARRAY'))
 where json_type(x) in ('OBJECT', 'ARRAY'))
"""


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_target_weights": p1_target_weights,
        "p1_type_weights": p1_type_weights,
        "p1_target_degrees": p1_target_degrees,
        "p2_found": p2_found,
        "p2_report": p2_report,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_values": p4_values,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_bridge": p7_bridge,
        "p7_objects": p7_objects,
        "p7_shapes": p7_shapes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """select 'target_id' field, target_id::varchar hot_key from edges where target_id is not null group by target_id having count(*) >= 0.02 * (select count(*) from edges)
            union all select 'type', type from edges where type is not null group by type having count(*) >= 0.02 * (select count(*) from edges)""",
        "p1_target_weights": _RANKED.format(key="target_id"),
        "p1_type_weights": _RANKED.format(key="type"),
        "p1_target_degrees": """select target_id, count(*) n_rows, count(distinct (coalesce(source_id, -999), coalesce(type, '?'))) n_edges, count(distinct source_id) n_sources, count(distinct type) n_types
            from edges where target_id is not null group by 1""",
        "p2_found": _P2,
        "p2_report": _P2_REPORT,
        "p3_found": _P3,
        "p4_found": _P4,
        "p4_values": _P4_BOTH
        + """select project, qualified_name, presence, n_left, n_right, u.field field, u.left_value left_value, u.right_value right_value from (select project, qualified_name, n_left, n_right,
            case when rq is null then 'only_left' when lq is null then 'only_right' else 'both' end presence, unnest(case when rq is null or lq is null then [null] else list_filter([
            case when ll is distinct from rl then {'field': 'label', 'left_value': ll, 'right_value': rl} end, case when ln is distinct from rn then {'field': 'name', 'left_value': ln, 'right_value': rn} end,
            case when ls is distinct from rs then {'field': 'start_line', 'left_value': ls, 'right_value': rs} end,
            case when le is distinct from re then {'field': 'end_line', 'left_value': le, 'right_value': re} end], lambda x: x is not null) end) u from b)""",
        "p6_found": _P6,
        "p7_found": _JSON + "select distinct src_table, src_id, parent parent_path, path child_path from w where json_type(j) = 'OBJECT' and parent is not null",
        "p7_shapes": _JSON + "select src_table, depth, count(*) n_objects from (select distinct src_table, src_id, path, depth from w where json_type(j) = 'OBJECT') group by 1, 2",
    }
