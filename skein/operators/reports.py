"""Risk, documentation and context reports over the graph and its notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import hop_risk, is_test_path, risk_score, truthy
from skein.plans.graph import PropertyGraph, prop
from skein.session import materialize


def note_links(notes: DataFrame) -> DataFrame:
    """(note_id, node_id), once each; ids that are no ids, 0 and below, are left out."""
    return notes.select(F.col("id").alias("note_id"), F.explode("cbm_node_ids").alias("node_id")).where("node_id > 0").distinct()


def note_states(notes: DataFrame) -> DataFrame:
    """One row per note: its latest update."""
    cols = [c for c in notes.columns if c not in ("id", "updated_at")]
    return notes.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", *cols)).alias("s")).select("id", "s.*")


def facts(g: PropertyGraph, notes: DataFrame) -> DataFrame:
    """Per node: degree, complexity, notes, and the flags that rules ask for."""
    d = g.degrees().select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    n = note_links(notes).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n_notes"))
    base = g.nodes.select(
        "id", "project", "label", "name", F.coalesce(prop("complexity").try_cast("double"), F.lit(0.0)).alias("complexity"),
        is_test_path(F.col("file_path")).alias("is_test"), (truthy(prop("is_exported")) | truthy(prop("exported"))).alias("is_exported"),
    )
    out = base.join(d, "id", "left").join(n, "id", "left")
    return out.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("n_notes", F.coalesce("n_notes", F.lit(0)))


def _level(value: Column, *steps: tuple[int, str]) -> Column:
    out = None
    for least, name in sorted(steps, reverse=True):
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out


def risks(f: DataFrame) -> DataFrame:
    """The five rules, one row per node and rule it breaks, with a severity."""
    d = F.col("degree")
    module, function = F.col("label").isin(*MODULES), F.col("label") == "Function"
    rules = [
        ("high_coupling", F.when(module, _level(d, (40, "medium"), (60, "high"), (80, "critical")))),
        ("dead_code_candidate", F.when(function & (d == 0) & ~F.col("is_exported") & ~F.col("is_test"), "low")),
        ("fragile_interface", F.when(F.col("label") == "Interface", _level(d, (10, "medium"), (30, "high")))),
        ("central_function", F.when(function, _level(d, (20, "medium"), (30, "high"), (50, "critical")))),
        ("no_documentation", F.when(module & (d >= 30) & (F.col("n_notes") == 0), "high")),
    ]
    broken = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("severity")) for r, s in rules]), lambda x: x["severity"].isNotNull())
    return f.withColumn("r", F.explode(broken)).select("id", "name", "label", "degree", "r.rule", "r.severity")


#: What stands for a module: a graph without Module nodes has files.
MODULES = ("Module", "File")
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def top_risks(f: DataFrame, top: int = 200) -> DataFrame:
    order = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")]
    return risks(f).orderBy(order, F.desc("degree"), "id", "rule").limit(top)


def hotspots(f: DataFrame, top: int = 100, least: int = 20) -> DataFrame:
    """Modules of degree `least` and more by risk."""
    score = F.round(risk_score(F.col("degree"), F.col("complexity"), F.col("n_notes")), 6)
    return f.where(F.col("label").isin(*MODULES) & (F.col("degree") >= least)).select("id", "name", "degree", score.alias("risk")).orderBy(F.desc("risk"), "id").limit(top)


def undocumented(f: DataFrame) -> DataFrame:
    """Definitions without an active note, per label, and how many of them are critical."""
    critical = (F.col("degree") >= 30) | (F.col("complexity") >= 10)
    bare = f.where(F.col("label").isin("Function", "Method", "Class", "Interface", "File") & (F.col("n_notes") == 0))
    return bare.groupBy("label").agg(F.count(F.lit(1)).alias("n_undocumented"), F.sum(critical.cast("bigint")).alias("n_critical"))


def undocumented_hotspots(f: DataFrame, top: int = 50) -> DataFrame:
    return f.where((F.col("n_notes") == 0) & F.col("label").isin("Function", "Method", "Class", "Interface", "File")).select("id", "name", "label", "degree", "complexity", (F.col("degree") + F.col("complexity")).alias("weight")).orderBy(F.desc("weight"), "id").limit(top)


def overview(g: PropertyGraph, f: DataFrame) -> DataFrame:
    """Per project: nodes, edges, and the share of nodes of degree 20 and more that have a note;
    null where there is no such node."""
    n = f.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum((F.col("degree") >= 20).cast("bigint")).alias("n_central"),
        F.round(F.sum(((F.col("degree") >= 20) & (F.col("n_notes") > 0)).cast("double")) / F.nullif(F.sum((F.col("degree") >= 20).cast("double")), F.lit(0.0)), 6).alias("coverage"),
    )
    e = g.edges.groupBy("project").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "project", "left").select("project", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_central", "coverage")


def module_context(g: PropertyGraph, notes: DataFrame, f: DataFrame) -> DataFrame:
    """Per file: its definitions, its degree, notes on it or its definitions by label, and the
    greatest risk in it."""
    at = g.nodes.select("id", "project", "file_path")
    r = f.select("id", risk_score(F.col("degree"), F.col("complexity"), F.col("n_notes")).alias("risk"), "degree", F.col("label"))
    per = at.join(r, "id").groupBy("project", "file_path").agg(F.sum((F.col("label") != "File").cast("bigint")).alias("n_definitions"), F.sum("degree").alias("degree"), F.round(F.max("risk"), 6).alias("max_risk"))
    linked = note_links(notes.where("status <> 'deprecated'")).join(at.withColumnRenamed("id", "node_id"), "node_id").select("project", "file_path", "note_id").distinct()
    n = linked.groupBy("project", "file_path").agg(F.count(F.lit(1)).alias("n_notes"))
    return per.join(n, ["project", "file_path"], "left").withColumn("n_notes", F.coalesce("n_notes", F.lit(0)))


def edit_context(g: PropertyGraph, notes: DataFrame, f: DataFrame, nodes: DataFrame) -> DataFrame:
    """For nodes about to be edited (`id`): callers and callees (imports for files), direct
    dependents, active bugs, refactor plans, decisions and conventions, the risk by active bugs and
    plans, its level, and whether an edit is safe: low risk and no bug, plan or convention."""
    picked = g.nodes.join(nodes.distinct(), "id", "left_semi").select("id", "name", F.when(F.col("label").isin("File", "Module"), "IMPORTS").otherwise("CALLS").alias("type"))
    e = g.edges.where(F.col("type").isin("CALLS", "IMPORTS"))
    into = e.select(F.col("target_id").alias("id"), "type", "source_id").join(picked.select("id", "type"), ["id", "type"], "left_semi")
    into = into.groupBy("id", "source_id").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum("n").alias("n_in"), F.count(F.lit(1)).alias("n_dependents"))
    out = e.select(F.col("source_id").alias("id"), "type").join(picked.select("id", "type"), ["id", "type"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_out"))
    kinds = {"BugNote": "n_bugs", "RefactorPlan": "n_refactors", "ADR": "n_adrs", "Convention": "n_conventions"}
    active = note_links(notes).join(notes.where(F.col("status") == "active").select(F.col("id").alias("note_id"), F.col("label").alias("kind")), "note_id")
    counts = active.groupBy(F.col("node_id").alias("id")).agg(*[F.sum((F.col("kind") == k).cast("bigint")).alias(n) for k, n in kinds.items()])
    joined = reduce(lambda a, b: a.join(b, "id", "left"), [picked.drop("type"), into, out, counts, f.select("id", "degree", "complexity")])
    for c in ("n_in", "n_out", "n_dependents", *kinds.values()):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    risk = F.round(risk_score(F.col("degree"), F.col("complexity"), F.col("n_bugs") + F.col("n_refactors")), 6)
    safe = (F.col("risk") < 0.7) & (F.col("n_bugs") + F.col("n_refactors") + F.col("n_conventions") == 0)
    level = F.when(F.col("risk") >= 0.7, "HIGH").when(F.col("risk") >= 0.4, "MEDIUM").otherwise("LOW")
    return joined.withColumn("risk", risk).select("id", "name", "n_in", "n_out", "n_dependents", *kinds.values(), "risk", level.alias("level"), safe.alias("safe"))


def note_counts(notes: DataFrame) -> DataFrame:
    """Notes by label, all and active, with a row `_total`."""
    n = notes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "active").cast("bigint")).alias("n_active"))
    total = notes.agg(F.lit("_total").alias("label"), F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "active").cast("bigint")).alias("n_active"))
    return n.unionByName(total)


def notes_of_nodes(notes: DataFrame, keep: int = 3) -> DataFrame:
    """The `keep` notes of each node that were updated last, ties by id. A node that all notes name
    is ranked in two steps, so no task sorts all of them."""
    linked = note_links(notes).join(notes.select(F.col("id").alias("note_id"), "label", "updated_at"), "note_id")
    order = [F.col("updated_at").desc_nulls_last(), F.col("note_id")]
    part = Window.partitionBy("node_id", F.pmod(F.xxhash64("note_id"), F.lit(16))).orderBy(*order)
    few = linked.withColumn("r", F.row_number().over(part)).where(F.col("r") <= keep)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).where(F.col("rank") <= keep).select("node_id", "rank", "note_id", "label")


def freshness(state: DataFrame) -> DataFrame:
    """Score and label of an index from `stale`, `semantics_changed`, `changed_files`, `git_failed`
    and `age_s`; the first cause that applies decides."""
    n, age = F.col("changed_files"), F.col("age_s")
    reason = F.when(F.col("stale"), "stale").when(F.col("semantics_changed"), "semantics").when(n > 0, "changed").when(F.col("git_failed"), "unverified").when(age > 3600, "old").otherwise("fresh")
    score = (
        F.when(F.col("stale") | F.col("semantics_changed"), 0.0).when(n > 50, 0.2).when(n > 10, 0.4).when(n > 0, 0.6).when(age > 86400, 0.5).when(age > 3600, 0.8).otherwise(1.0)
    )
    label = F.when(score >= 0.9, "FRESH").when(score >= 0.7, "RECENT").when(score >= 0.5, "STALE").when(score >= 0.3, "OLD").otherwise("CRITICAL")
    return state.withColumn("reason", reason).withColumn("score", score).withColumn("label", label)


def node_status(g: PropertyGraph) -> DataFrame:
    """What a node is at a glance: test, structural, entry, exported, dead, single or normal; the
    first that applies."""
    n = g.nodes.join(g.degrees("CALLS"), "id", "left")
    path = F.lower(F.regexp_replace(F.coalesce("file_path", F.lit("")), r"\\", "/"))
    calls, callable_ = F.coalesce("in_degree", F.lit(0)), F.col("label").isin("Function", "Method", "Constructor")
    status = (
        F.when(path.rlike(r"(^|/)(__tests__|tests?|specs?|fixtures)(/|$)|\.(test|spec)\.[^/]+$"), "test")
        .when(F.col("label").isin("File", "Module", "Package", "Namespace", "Class", "Interface", "Trait", "Enum"), "structural")
        .when((F.col("label") == "Route") | truthy(prop("is_entry_point")) | truthy(prop("is_entry")), "entry")
        .when(truthy(prop("is_exported")) | truthy(prop("exported")), "exported")
        .when(callable_ & (calls == 0), "dead")
        .when(callable_ & (calls == 1), "single")
        .otherwise("normal")
    )
    return n.select("id", status.alias("status"))


def impact_summary(hops: DataFrame) -> DataFrame:
    return hops.groupBy("node").agg(F.min("hop").alias("hop")).groupBy(hop_risk(F.col("hop")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def snippet(g: PropertyGraph, wanted: str, project: str | None = None, neighbors: int = 0) -> DataFrame:
    """(how, id, qualified_name, label, file_path, start_line, end_line, callers, callees) of a
    symbol: by its qualified name, else by its ending behind a dot or colon, else by its name; the
    first way that finds any decides. One row is the symbol; of several, definitions go before
    files, callables before types and longer bodies before shorter ones, and if that leaves one,
    it is the symbol; else `how` is 'suggestion'. With `neighbors` up to so many names of callers
    and callees stand beside it. No row means that nothing bears the name."""
    n = g.nodes if project is None else g.nodes.where(F.col("project") == project)
    qn = F.col("qualified_name")
    way = F.when(qn == wanted, 0).when(qn.endswith("." + wanted) | qn.endswith("::" + wanted), 1).when(F.col("name") == wanted, 2)
    found = n.withColumn("way", way).where("way is not null")
    kind = F.when(F.col("label").isin("Function", "Method"), 0).when(F.col("label").isin("File", "Module", "Folder", "Package"), 2).otherwise(1)
    span = F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(-1))
    found = materialize(found.select("way", kind.alias("kind"), span.alias("span"), "id", "qualified_name", "label", "file_path", "start_line", "end_line"), "found")
    best = found.agg(F.min("way").alias("way"))
    here = found.join(F.broadcast(best), "way")
    top = here.agg(F.min(F.struct("kind", (-F.col("span")).alias("span"))).alias("t"), F.count(F.lit(1)).alias("all"))
    tied = here.join(F.broadcast(top), (F.col("kind") == F.col("t.kind")) & (F.col("span") == -F.col("t.span")))
    n_tied = tied.agg(F.count(F.lit(1)).alias("tied"))
    ways = F.element_at(F.array(*[F.lit(x) for x in ("exact", "suffix", "name")]), F.col("way") + 1)
    cols = ["id", "qualified_name", "label", "file_path", "start_line", "end_line"]
    one = tied.join(F.broadcast(n_tied), F.lit(True)).where("tied = 1").select(ways.alias("how"), *cols)
    many = here.join(F.broadcast(n_tied), F.lit(True)).where("tied > 1").select(F.lit("suggestion").alias("how"), *cols)
    out = one.unionByName(many)
    if not neighbors:
        return out.select("*", F.lit(None).cast("array<string>").alias("callers"), F.lit(None).cast("array<string>").alias("callees"))
    names = g.nodes.select(F.col("id").alias("other"), "name")
    ids = out.where("how <> 'suggestion'").select("id")
    for column, at, other in (("callers", "target_id", "source_id"), ("callees", "source_id", "target_id")):
        near = g.calls.select(F.col(at).alias("id"), F.col(other).alias("other")).join(ids, "id", "left_semi").join(names, "other").select("id", "name").distinct()
        few = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("name"))).where(F.col("r") <= neighbors)
        out = out.join(few.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias(column)), "id", "left")
    return out.select("how", *cols, "callers", "callees")


#: The labels among which a module's name is sought, stage by stage (fixed values).
MODULE_STAGES = (("Module",), ("File",), ("Class", "Interface"))


def find_module(g: PropertyGraph, project: str, wanted: str, suggestions: int = 10) -> DataFrame:
    """(how, stage, id, name, label, file_path) of the module that `wanted` means: a part of name,
    qualified name or path, in any letter case, sought stage by stage; within the first stage that
    finds any an exact match goes before parts. One row is it ('found'), several are 'ambiguous',
    and if no stage finds any, modules that hold the first half of the text are 'suggestion's."""
    low = wanted.replace("\\", "/").removeprefix("./").lower()
    stage = None
    for i, labels in enumerate(MODULE_STAGES):
        stage = F.when(F.col("label").isin(*labels), i) if stage is None else stage.when(F.col("label").isin(*labels), i)
    form = lambda c: F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/")), r"^\./", "")
    texts = [form(F.col(c)) for c in ("name", "qualified_name", "file_path")]
    any_of = lambda test: reduce(lambda a, b: a | b, [test(t) for t in texts])
    n = g.nodes.where(F.col("project") == project).withColumn("stage", stage).where("stage is not null")
    hit = n.where(any_of(lambda t: t.contains(low))).withColumn("exact", any_of(lambda t: t == low))
    hit = materialize(hit.select("stage", "exact", "id", "name", "label", "file_path"), "modules")
    first = hit.agg(F.min(F.struct("stage", (~F.col("exact")).alias("part"))).alias("f"))
    best = hit.join(F.broadcast(first), (F.col("stage") == F.col("f.stage")) & (F.col("exact") != F.col("f.part")))
    count = best.agg(F.count(F.lit(1)).alias("k"))
    out = best.join(F.broadcast(count), F.lit(True)).select(F.when(F.col("k") == 1, "found").otherwise("ambiguous").alias("how"), "stage", "id", "name", "label", "file_path")
    half = low[: max(3, len(low) // 2)]
    near = n.where(any_of(lambda t: t.contains(half))).join(F.broadcast(count), F.lit(True)).where("k = 0").orderBy("id").limit(suggestions)
    return out.unionByName(near.select(F.lit("suggestion").alias("how"), "stage", "id", "name", "label", "file_path"))


def recommendations(f: DataFrame, notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """(project, advice, n) of what a project's reader should do next: 'reindex' where the index is
    not fresh (`fresh(project, label)`), 'document' central nodes without a note, 'fix' active
    bugs, 'plan' active refactor plans, 'start_notes' where nothing is noted yet. n is how many."""
    central = f.where("degree >= 20 and n_notes = 0").groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit("document").alias("advice"), "n")
    active = lambda kind, advice: notes.where((F.col("status") == "active") & (F.col("label") == kind)).groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(advice).alias("advice"), "n")
    none = f.select("project").distinct().join(notes.select("project").distinct(), "project", "left_anti").select("project", F.lit("start_notes").alias("advice"), F.lit(1).cast("bigint").alias("n"))
    old = fresh.where(~F.col("label").isin("FRESH", "RECENT")).select("project", F.lit("reindex").alias("advice"), F.lit(1).cast("bigint").alias("n"))
    return reduce(DataFrame.unionByName, [central, active("BugNote", "fix"), active("RefactorPlan", "plan"), none, old])
