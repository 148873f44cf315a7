"""Queries of the text problems (p5, p8, p9, p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.handwritten import classify
from skein.llm.mixing import mix, shares
from skein.llm.packing import pack, windows
from skein.llm.tokens import token_counts
from skein.llm.visual import look_classes, same_looking, visual_forms
from skein.session import materialize, table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "file_hashes"), table(spark, sf_dir, "file_heads"), table(spark, sf_dir, "third_party_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("kind is not null").select("file_id")


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", "kind", *[F.round(c, 6).alias(c) for c in ("shape_ratio", "rule_reuse", "literal_share", "literal_ratio")], "n_rules", "n_shared")


def p5_handwritten_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes whose file is hand-written: per project, files and nodes kept and left out."""
    path = F.lower(F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./|/)+", ""))
    kinds = _files(spark, sf_dir).select(F.col("file_id").alias("id"), "kind")
    files = table(spark, sf_dir, "file_hashes").select("id", "project", path.alias("path")).distinct().join(kinds, "id")
    files = files.groupBy("project", "path").agg(F.max("kind").alias("kind"))
    nodes = table(spark, sf_dir, "nodes").select("id", "project", path.alias("path")).distinct()
    judged = nodes.join(files, ["project", "path"], "left")
    return judged.groupBy("project", F.coalesce("kind", F.lit("handwritten")).alias("kind")).agg(F.count(F.lit(1)).alias("n_nodes"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "pack_capacity").agg(F.min("capacity_tokens")).first()[0])  # one row, a setting


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return windows(pack(sizes, _capacity(spark, sf_dir)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that had to be cut: those with a part behind the first."""
    return _packed(spark, sf_dir).where("part > 0").select("doc_id").distinct()


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows are, in one row."""
    capacity = _capacity(spark, sf_dir)
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    packed = pack(sizes, capacity)
    return packed.agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("size").alias("n_tokens"), F.sum(F.size("members")).alias("n_parts"),
        F.round(F.sum("size") / (F.count(F.lit(1)) * capacity), 4).alias("fill"),
    )


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the windows, in one row: how many texts have a place, that the parts of a
    text follow each other without a gap and only long texts have several, that no window is
    overfull, and that not even the two smallest go into one."""
    capacity = _capacity(spark, sf_dir)
    packed = materialize(_packed(spark, sf_dir), "windows")
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("last") == F.col("parts") - 1) & (F.col("n") == F.col("end")) & (F.col("parts") == F.ceil(F.col("n") / capacity))
    sizes = packed.groupBy("window_id").agg(F.sum("n_tokens").alias("size"), F.max("window_tokens").alias("told"))
    two = sizes.orderBy("size").limit(2).agg(F.sum("size").alias("two"), F.count(F.lit(1)).alias("k"))
    held = sizes.agg(F.bool_and((F.col("size") <= capacity) & (F.col("size") == F.col("told"))).alias("within"))
    return (
        docs.agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and(whole).alias("whole"))
        .join(F.broadcast(held), F.lit(True)).join(F.broadcast(two), F.lit(True))
        .select("n_docs", "whole", "within", ((F.col("k") < 2) | (F.col("two") > capacity)).alias("tight"))
    )


def _source(column: str):
    return F.regexp_replace(F.lower(F.trim(column)), r"[-\s]+", "_")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("source", _source("source"))
    sized = materialize(token_counts(docs, "doc_id", "text", "source"), "sizes")
    # the targets are a setting: one row per source that is mixed
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").select(_source("source").alias("source"), "target_share", "max_repeats").collect()]
    return mix(sized, targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = materialize(_mixed(spark, sf_dir), "mix")
    return shares(mixed, table(spark, sf_dir, "mix_targets").withColumn("source", _source("source")))


def p9_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: that no text is taken more often than allowed, and that the share reached, among
    the sources that have text, is a hundredth from the target or one document, if that is more."""
    told = p9_shares(spark, sf_dir)
    all_ = told.where("tokens > 0").agg(F.sum("target_share").alias("whole"), F.sum("tokens").alias("all_tokens"))
    off = F.abs(F.col("actual_share") - F.when(F.col("tokens") > 0, F.col("target_share") / F.col("whole")).otherwise(0))
    near = off < F.greatest(F.lit(0.01), F.col("largest") / F.col("all_tokens"))
    return told.join(F.broadcast(all_), F.lit(True)).select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within"), near.alias("near"))


def p5_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the list of outside files holds, all of which must be found."""
    known = table(spark, sf_dir, "third_party_files").select(F.lower(F.trim("content_hash")).alias("hash")).where("hash is not null").distinct()
    files = table(spark, sf_dir, "file_hashes").select(F.col("id").alias("file_id"), F.lower(F.trim("content_hash")).alias("hash")).join(known, "hash", "left_semi")
    return files.select("file_id").distinct().join(p5_found(spark, sf_dir), "file_id", "left_semi")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the least one of the same text, and that its class is no later."""
    return p10_classes(spark, sf_dir).select("id", "text_id", (F.col("class_id") <= F.col("text_id")).alias("before"))


def p10_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the texts of plain characters alone are their own form."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").distinct()
    plain = F.col("text").rlike(r"\A[\t\n\r -~]*\z")
    both = docs.join(p10_forms(spark, sf_dir).distinct(), "doc_id").where(plain)
    return both.select("doc_id", (F.col("text") == F.col("form")).alias("same"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_forms(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {
        "p5_found": p5_found,
        "p5_files": p5_files,
        "p5_handwritten_nodes": p5_handwritten_nodes,
        "p5_listed": p5_listed,
        "p8_found": p8_found,
        "p8_windows": p8_windows,
        "p8_fill": p8_fill,
        "p8_sound": p8_sound,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p9_sound": p9_sound,
        "p10_found": p10_found,
        "p10_classes": p10_classes,
        "p10_forms": p10_forms,
        "p10_plain": p10_plain,
        "p10_texts": p10_texts,
    }


def oracle_sql() -> dict[str, str]:
    """Tokenizers, grammars and forms have no SQL; what must hold of their results has."""
    return {
        "p5_listed": "select distinct id file_id from file_hashes where lower(trim(content_hash)) in (select lower(trim(content_hash)) from third_party_files where content_hash is not null)",
        "p8_sound": "select count(distinct doc_id) n_docs, true \"whole\", true \"within\", true \"tight\" from documents where text <> ''",
        "p9_sound": "select regexp_replace(lower(trim(source)), '[-\\s]+', '_', 'g') source, true \"within\", true \"near\" from mix_targets",
        "p10_plain": "select doc_id, true same from documents where regexp_full_match(text, '[\\t\\n\\r -~]*') group by doc_id, text",
        "p10_texts": "select distinct doc_id id, min(doc_id) over (partition by text) text_id, true \"before\" from documents where text is not null",
    }
