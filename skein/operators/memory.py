"""Creating, changing and linking notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import slug
from skein.session import materialize

#: What a note may be (fixed values).
STATUSES = ("active", "draft", "deprecated", "archived")
SOURCES = ("human", "generated", "mixed")


def checked(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes that may be stored, and those that may not, with the `problem`: no title, an unknown
    status or source, a confidence outside 0 to 1."""
    problem = (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title")
        .when(~F.coalesce("status", F.lit("")).isin(*STATUSES), "status")
        .when(~F.coalesce("source", F.lit("")).isin(*SOURCES), "source")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence")
    )
    judged = notes.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null")


def create(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All notes with `new(project, title, ...)` added: slugs from titles, numbered behind those in
    use, and ids behind the greatest one, in the order of project, slug and title."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    base = new.withColumn("slug", slug(F.col("title")))
    # the greatest number in use: a slug is number 1 of itself and number k of what stands before -k
    number = F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int")
    forms = F.filter(F.array(F.struct("slug", F.lit(1).alias("k")), F.struct(F.regexp_replace("slug", r"-\d+$", "").alias("slug"), number.alias("k"))), lambda x: x["k"].isNotNull())
    used = existing.select("project", F.explode(forms).alias("x")).groupBy("project", F.col("x.slug").alias("slug")).agg(F.max("x.k").alias("used"))
    n = F.row_number().over(Window.partitionBy("project", "slug").orderBy("title")) + F.coalesce("used", F.lit(0))
    named = base.join(used, ["project", "slug"], "left").withColumn("n", n)
    named = named.withColumn("slug", F.when(F.col("n") > 1, F.concat("slug", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("slug"))).drop("n", "used")
    # a running number over sorted partitions: within each behind the counts of those before it
    sorted_ = named.orderBy("project", "slug", "title").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sorted_ = materialize(sorted_, "notes")
    counts = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # one row a partition
    before = counts.withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c")).select("part", "before")
    numbered = sorted_.join(F.broadcast(before), "part").join(F.broadcast(top), F.lit(True)).withColumn("id", (F.col("top") + F.col("before") + F.col("place") + 1).cast("bigint"))
    return existing.unionByName(numbered.drop("top", "part", "place", "before", "c"), allowMissingColumns=True)


def update(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with the columns of `changes(id, updated_at, ...)` put in place, one row an id; a null
    keeps what was. A title that changes does not change the slug. Changes of unknown ids do
    nothing."""
    cols = [c for c in changes.columns if c != "id"]
    told = changes.select("id", *[F.col(c).alias(f"__{c}") for c in cols])
    return notes.join(told, "id", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in notes.columns])


def delete(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes without those of `ids(id)`; their links go with them, being part of the note."""
    return notes.join(ids.select("id"), "id", "left_anti")


def link(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes with the ids of `links(note_id, node_id)` added to their node ids, each once, sorted."""
    more = links.where("node_id > 0").groupBy(F.col("note_id").alias("id")).agg(F.collect_set("node_id").alias("more"))
    joined = notes.join(more, "id", "left")
    none = F.array().cast("array<bigint>")
    merged = F.array_sort(F.array_union(F.coalesce("cbm_node_ids", none), F.coalesce("more", none)))
    return joined.withColumn("cbm_node_ids", F.when(F.col("more").isNull(), F.col("cbm_node_ids")).otherwise(merged)).drop("more")


def sync_stale(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(note_id, node_id): links of notes to nodes that are gone, to be taken away by a sync."""
    links = notes.select(F.col("id").alias("note_id"), F.explode("cbm_node_ids").alias("node_id")).where("node_id > 0").distinct()
    return links.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def sync_renames(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, old_path, new_path): notes of `stored(path, slug)` whose file moved: the old path is
    gone from `files(path, slug)`, and exactly one new path has the slug."""
    gone = stored.join(files.select("path"), "path", "left_anti").select("slug", F.col("path").alias("old_path"))
    new = files.join(stored.select("path"), "path", "left_anti").groupBy("slug").agg(F.min("path").alias("new_path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return gone.join(new, "slug").select("slug", "old_path", "new_path")


def sync_plan(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action) for `stored(path, hash)` against `files(path, hash)`: import what is new or
    changed on disk, export what is missing there, keep the rest. Rows without a path are no
    files."""
    s, f = stored.select("path", F.col("hash").alias("s")), files.select("path", F.col("hash").alias("f"))
    action = F.when(F.col("s").isNull(), "import").when(F.col("f").isNull(), "export").when(F.col("s") != F.col("f"), "import").otherwise("keep")
    return s.where("path is not null").join(f.where("path is not null"), "path", "full_outer").select("path", action.alias("action"))
