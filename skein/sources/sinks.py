"""Writing graphs and notes: keyed upserts, deletes, merges, exports and backups.

A table is a folder of Parquet below a path, partitioned by project. A rewrite touches only the
projects it changes, through dynamic partition overwrite, and writes next to the old files before
they are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.plans.graph import PropertyGraph
from skein.session import materialize
from skein.sources.readers import human_section
from skein.streaming.changes import revision


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of rows with one key the one with the greatest version; ties by the whole row."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("s"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"s.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`new` over `old`: a key of both sides has the new row; repeated keys in `new` must be
    settled before (`latest`)."""
    named = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return old.join(named, same, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_nodes(g: PropertyGraph, gone: Column) -> PropertyGraph:
    """A graph without the nodes that `gone` names, nor the edges at them."""
    dead = g.nodes.where(gone).select("id")
    e = g.edges.join(dead.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(dead.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return PropertyGraph(g.nodes.join(dead, "id", "left_anti"), e.select(*g.edges.columns))


def delete_edges(g: PropertyGraph, gone: Column) -> PropertyGraph:
    """A graph without the edges that `gone` names."""
    return PropertyGraph(g.nodes, g.edges.where(~gone))


def merge_graphs(base: PropertyGraph, other: PropertyGraph) -> PropertyGraph:
    """One graph of two: nodes of one qualified name are one node, with the base's id and the
    other's values; edges of one (source, target, type) are one edge, whose properties the later
    side extends and overrides key by key."""
    key = ["project", "qualified_name"]
    ids = base.nodes.select(*key, F.col("id").alias("base_id"))
    mapped = other.nodes.join(ids, key, "left")
    renamed = materialize(mapped.select("*", F.coalesce("base_id", "id").alias("new_id")), "merged")
    fresh = renamed.drop("id", "base_id").withColumnRenamed("new_id", "id").select(*base.nodes.columns)
    nodes = base.nodes.join(fresh.select("id"), "id", "left_anti").select(*base.nodes.columns).unionByName(fresh)
    to = renamed.select(F.col("id").alias("old"), "new_id")
    moved = other.edges.join(to.withColumnsRenamed({"old": "source_id", "new_id": "s"}), "source_id").join(to.withColumnsRenamed({"old": "target_id", "new_id": "t"}), "target_id")
    moved = moved.select("id", "project", F.col("s").alias("source_id"), F.col("t").alias("target_id"), "type", "properties_json", F.lit(1).alias("side"))
    every = base.edges.select("id", "project", "source_id", "target_id", "type", "properties_json", F.lit(0).alias("side")).unionByName(moved)
    key = ["source_id", "target_id", "type"]
    head = every.groupBy(*key).agg(F.min(F.struct("side", "id", "project")).alias("h"))
    # key by key, so however many parallel edges there are, only their different keys meet
    cells = every.select(*key, F.struct("side", "id").alias("at"), F.explode(F.from_json("properties_json", "map<string,string>")).alias("k", "v"))
    last = cells.groupBy(*key, "k").agg(F.max_by("v", "at").alias("v"))
    props = last.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("m"))
    same = [head[c].eqNullSafe(props[c]) for c in key]
    one = head.join(props, reduce(lambda a, b: a & b, same), "left").select(*[head[c] for c in key], "h", "m")
    edges = one.select(F.col("h.id").alias("id"), F.col("h.project").alias("project"), *key, F.to_json(F.coalesce("m", F.create_map().cast("map<string,string>"))).alias("properties_json"))
    return PropertyGraph(nodes, edges)


def write_projects(rows: DataFrame, path: str) -> None:
    """Replace the projects that occur in `rows`, and no others, in the table at `path`. The rows
    are spread by project and id, so a large project is written by many tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "project"][:1]), F.lit(8))
    rows.repartition("project", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def drop_project(spark: SparkSession, path: str, project: str) -> None:
    """Remove one project's folder from the table at `path`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/project={project}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """A table of rows by file (call sites, imports, exports) after some `files(project,
    file_path)` were read again: their old rows go, and all of `new` comes; a file that now has no
    rows has none left."""
    return old.join(files.select("project", "file_path").distinct(), ["project", "file_path"], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


#: The tables that hold a project's graph; what a file was once called is kept.
PROJECT_TABLES = ("nodes", "edges", "file_hashes", "call_sites", "imports", "exports")


def clear_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """The tables without the rows of a project, all of PROJECT_TABLES that are given; others, such
    as an alias history, are as they were."""
    keep = F.coalesce(F.col("project") != project, F.lit(True))
    return {name: df.where(keep) if name in PROJECT_TABLES else df for name, df in tables.items()}


def export_graph(g: PropertyGraph, path: str) -> None:
    """The graph as two compressed tables, with their row counts and revisions beside them."""
    for name, df in (("nodes", g.nodes), ("edges", g.edges)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    _marks(g).write.mode("overwrite").json(f"{path}/marks")


def _marks(g: PropertyGraph) -> DataFrame:
    rows = [revision(df).withColumn("table", F.lit(name)) for name, df in (("nodes", g.nodes), ("edges", g.edges))]
    return rows[0].unionByName(rows[1])


def import_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from `export_graph`; an export that was cut off or changed since is an error."""
    g = PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
    told = spark.read.schema("project string, revision string, table string").json(f"{path}/marks")
    off = _marks(g).select("table", "project", "revision").exceptAll(told.select("table", "project", "revision")).limit(1).count()
    if off or _marks(g).count() != told.count():
        raise ValueError(f"the tables at {path} are not those that were exported")
    return g


def integrity(g: PropertyGraph, projects: DataFrame) -> DataFrame:
    """(check, n): how many rows break a rule of the tables; 0 everywhere is sound."""
    ids = g.nodes.select("id")
    checks = {
        "repeated_node_id": g.nodes.groupBy("id").count().where("count > 1"),
        "repeated_qualified_name": g.nodes.groupBy("project", "qualified_name").count().where("count > 1"),
        "edge_without_source": g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti"),
        "edge_without_target": g.edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti"),
        "project_without_name": projects.where("name is null or name = ''"),
        "node_of_no_project": g.nodes.where("project is not null").join(projects.select(F.col("name").alias("project")), "project", "left_anti"),
    }
    parts = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def backup(notes: DataFrame, path: str, dry_run: bool = False) -> int:
    """Notes as JSON lines; `dry_run` only counts them."""
    n = notes.count()
    if not dry_run:
        notes.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return n


def restore(spark: SparkSession, path: str, existing: DataFrame, dry_run: bool = False) -> tuple[DataFrame, int]:
    """Notes with those of a backup put in by id, and how many came new; `dry_run` only counts
    them. Ids that are there are kept as they are; a line that is no note is an error."""
    told = spark.read.schema(existing.schema).option("mode", "FAILFAST").json(path)
    new = told.where("id is not null").join(existing.select("id"), "id", "left_anti").select(*existing.columns)
    n = new.count()
    return (existing if dry_run else existing.unionByName(new)), n


def keep_human(text: Column, before: Column) -> Column:
    """A rendered note with what people wrote, between the marks of its old text, put behind it."""
    kept = human_section(before)
    marked = F.concat(F.lit("<!-- HUMAN NOTES -->\n"), kept, F.lit("<!-- /HUMAN NOTES -->\n"))
    return F.when(kept.isNull(), text).otherwise(F.concat(F.regexp_replace(text, r"\n*\z", "\n"), marked))


#: How many old texts of a note's file are kept.
BACKUPS = 5


def write_vault(notes: DataFrame, path: str, backups: int = BACKUPS) -> None:
    """Notes as Markdown files below a folder of the shared file system, written by the executors.
    A file that differs is first put aside as `name.bak-1`, older ones moving up to `backups`;
    what people wrote between the marks is kept; files that are the same are left alone."""

    def run(rows) -> None:
        for r in rows:
            at = Path(path) / r["path"]
            old = at.read_text("utf-8") if at.exists() else None
            text = r["text"]
            if old is not None and "<!-- HUMAN NOTES -->" in old:
                kept = old.split("<!-- HUMAN NOTES -->", 1)[1].split("<!-- /HUMAN NOTES -->", 1)[0].lstrip("\r\n")
                text = text.rstrip("\n") + f"\n<!-- HUMAN NOTES -->\n{kept}<!-- /HUMAN NOTES -->\n"
            if text == old:
                continue
            at.parent.mkdir(parents=True, exist_ok=True)
            if old is not None:
                for n in range(backups, 1, -1):
                    if (older := at.with_name(f"{at.name}.bak-{n - 1}")).exists():
                        older.replace(at.with_name(f"{at.name}.bak-{n}"))
                at.replace(at.with_name(f"{at.name}.bak-1"))
            fresh = at.with_name(f".{at.name}.new")
            fresh.write_text(text, "utf-8")
            fresh.replace(at)

    render_notes(notes).groupBy("path").agg(F.max("text").alias("text")).foreachPartition(run)


def render_notes(notes: DataFrame) -> DataFrame:
    """(path, text): notes as Markdown files with frontmatter."""
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), "label"), F.concat(F.lit("status: "), "status"), F.concat(F.lit("tags: ["), F.array_join(F.coalesce("tags", F.array()), ", "), F.lit("]")), F.lit("---"), F.lit(""))
    return notes.select(F.coalesce("obsidian_path", F.concat(F.lit("Notes/"), "slug", F.lit(".md"))).alias("path"), F.concat(front, F.coalesce("body_markdown", F.lit(""))).alias("text"))


def unique_slugs(notes: DataFrame) -> DataFrame:
    """Notes with slugs made unique per project: the first by id keeps its slug, others get -2, -3
    and so on. Only slugs that collide are numbered."""
    by = Window.partitionBy("project", "slug").orderBy("id")
    n = F.row_number().over(by)
    return notes.withColumn("slug", F.when(n > 1, F.concat("slug", F.lit("-"), n.cast("string"))).otherwise(F.col("slug")))
