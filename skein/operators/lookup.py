"""Point, batch and range look-ups, structured search and paging over a property graph."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import glob_to_like, graph_path, is_test_path, owner_qn
from skein.plans.graph import PropertyGraph, prop

CONTAINERS = ("Module", "Package", "File", "Folder")


def listed(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is one of `values`; the list comes with the call, and up to `FEW_VALUES`
    it is broadcast."""
    kind = dict(df.dtypes)[column]
    wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"`{column}` {kind}")
    return df.join(_small(wanted, len(values)), column, "left_semi")


#: Up to so many values a list is broadcast; beyond, it is shuffled.
FEW_VALUES = 100_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW_VALUES else df


def ids_by_qns(g: PropertyGraph, project: str, qns: Sequence[str]) -> DataFrame:
    """(qualified_name, id) for each asked name; 0 where there is none."""
    wanted = g.nodes.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(qns)], "qualified_name string")
    found = g.nodes.where(F.col("project") == project).select("qualified_name", "id")
    return _small(wanted, len(qns)).join(found, "qualified_name", "left").groupBy("qualified_name").agg(F.coalesce(F.min("id"), F.lit(0)).alias("id"))


def qn_suffix(g: PropertyGraph, suffix: str) -> DataFrame:
    qn = F.col("qualified_name")
    return g.nodes.where(qn.endswith("." + suffix) | (qn == suffix))


def line_overlap(g: PropertyGraph, path: str, low: int, high: int) -> DataFrame:
    """Definitions of a file that touch the lines low..high."""
    return g.nodes.where((F.col("file_path") == path) & (F.col("start_line") <= high) & (F.col("end_line") >= low) & ~F.col("label").isin(*CONTAINERS))


def innermost(g: PropertyGraph, points: DataFrame, keep: int = 1, bucket: int = 64) -> DataFrame:
    """For rows of `points(point_id, project, file_path, line)` the `keep` innermost definitions
    around the line: smallest span, then latest start, then smallest id.

    A range join in equi-form: definitions are listed under every block of `bucket` lines they
    touch, points under theirs; a definition longer than 64 blocks is listed once, under its file.
    """
    d = g.nodes.where(~F.col("label").isin(*CONTAINERS) & F.col("start_line").isNotNull() & (F.col("end_line") >= F.col("start_line")))
    d = d.select("id", "project", "file_path", "start_line", "end_line")
    lo, hi = F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket)
    blocks = F.when(hi - lo < 64, F.sequence(lo, hi)).otherwise(F.array(F.lit(-1).cast("bigint")))
    d = d.withColumn("block", F.explode(blocks))
    p = points.withColumn("block", F.explode(F.array(F.floor(F.col("line") / bucket), F.lit(-1).cast("bigint"))))
    hit = p.join(d, ["project", "file_path", "block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    by = Window.partitionBy("point_id").orderBy(F.col("end_line") - F.col("start_line"), F.col("start_line").desc(), "id")
    return hit.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep).select("point_id", "id", "start_line", "end_line", "rank")


def by_path(g: PropertyGraph, part: str) -> DataFrame:
    return g.nodes.where(graph_path(F.col("file_path")).contains(part.replace("\\", "/").strip("/")))


def by_name_or_path(g: PropertyGraph, part: str, labels: Sequence[str]) -> DataFrame:
    low = part.lower()
    has = [F.lower(F.col(c)).contains(low) for c in ("name", "qualified_name", "file_path")]
    return g.nodes.where(F.col("label").isin(*labels) & (F.coalesce(has[0], F.lit(False)) | F.coalesce(has[1], F.lit(False)) | F.coalesce(has[2], F.lit(False))))


def routes(g: PropertyGraph, method: str, path: str) -> DataFrame:
    """Route nodes by method, case apart, and exact path; broken properties match nothing."""
    return g.nodes.where((F.col("label") == "Route") & (F.upper(prop("method")) == method.upper()) & (prop("path") == path))


def call_sites(g: PropertyGraph) -> DataFrame:
    """One row per call edge outside tests: the caller's named owner, its path, callee and line."""
    src = g.nodes.where(~is_test_path(F.col("file_path"))).select(F.col("id").alias("source_id"), owner_qn(F.col("qualified_name")).alias("owner_qn"), "file_path", F.col("project").alias("p"))
    calls = g.calls.select("id", "source_id", "target_id", prop("line").try_cast("int").alias("line"))
    return calls.join(src, "source_id").select(F.col("id").alias("site_id"), F.col("p").alias("project"), "owner_qn", "file_path", "source_id", "target_id", "line")


def search(
    g: PropertyGraph,
    project: str | None = None,
    label: str | None = None,
    name: str | None = None,
    qn: str | None = None,
    file: str | None = None,
    relationship: str | None = None,
    not_entry: bool = False,
    exclude_labels: Sequence[str] = (),
    min_degree: int | None = None,
    max_degree: int | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """Structured search: every given condition holds. `name` and `qn` are regular expressions
    that may match anywhere, `file` a glob or a part of the path; degrees count CALLS, USAGE,
    INHERITS and IMPLEMENTS in either direction. A pattern's longest plain part is tested first."""
    df = g.nodes
    if project:
        df = df.where(F.col("project") == project)
    if label:
        df = df.where(F.col("label") == label)
    for column, pattern in (("name", name), ("qualified_name", qn)):
        if pattern:
            for plain in _literal(pattern):
                c = F.col(column) if case_sensitive else F.lower(column)
                df = df.where(c.contains(plain if case_sensitive else plain.lower()))
            df = df.where(F.col(column).rlike(pattern if case_sensitive else f"(?i){pattern}"))
    if file:
        df = df.where(F.lower("file_path").like(glob_to_like(file).lower()))
    if relationship:
        of = g.edges.where(F.col("type") == relationship)
        ends = of.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        df = df.join(ends, "id", "left_semi")
    if not_entry:
        d = g.degrees("CALLS").where("in_degree = 0 and out_degree > 0")
        df = df.join(d, "id", "left_anti")
    if exclude_labels:
        df = df.where(~F.col("label").isin(*exclude_labels))
    if min_degree is not None or max_degree is not None:
        d = g.degrees("CALLS", "USAGE", "INHERITS", "IMPLEMENTS")
        df = df.join(d, "id", "left").withColumn("degree", F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0))).drop("in_degree", "out_degree")
        if min_degree is not None:
            df = df.where(F.col("degree") >= min_degree)
        if max_degree is not None:
            df = df.where(F.col("degree") <= max_degree)
    return df


def _literal(pattern: str) -> list[str]:
    """The longest text every match must hold; none if there is a choice or an option."""
    if re.search(r"[|?*{(\[]", pattern):
        return []
    parts = re.split(r"\\[a-zA-Z]|[.^$+)\]}\\]", pattern)
    best = max(parts, key=len, default="")
    return [best] if len(best) >= 3 else []


def page(df: DataFrame, size: int, offset: int, *order: Column | str) -> DataFrame:
    """One page in a total order, each row with the exact `total` and `has_more`. Only the page is
    sorted out; the total is one aggregate row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(size)
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + size)


def connected(g: PropertyGraph, found: DataFrame, keep: int = 10) -> DataFrame:
    """(id, neighbors): up to `keep` distinct names next to each found node, in order."""
    ids = found.select("id")
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("o")))).alias("x")).select("x.*")
    names = ends.join(ids, "id", "left_semi").distinct().join(g.nodes.select(F.col("id").alias("o"), "name"), "o").select("id", "name").distinct()
    by = Window.partitionBy("id").orderBy("name")
    return names.withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep).groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("neighbors"))


def ranked_search(g: PropertyGraph, text: str) -> DataFrame:
    """Rank 0 to 5: name is it, qualified name or path is it, name starts with it, name holds it,
    qualified name holds it, path holds it; case apart."""
    t = text.lower()
    name, qn, path = (F.coalesce(F.lower(c), F.lit("")) for c in ("name", "qualified_name", "file_path"))
    rank = F.when(name == t, 0).when((qn == t) | (path == t), 1).when(name.startswith(t), 2).when(name.contains(t), 3).when(qn.contains(t), 4).when(path.contains(t), 5)
    return g.nodes.withColumn("rank", rank).where("rank is not null")


def after(df: DataFrame, size: int, **last) -> DataFrame:
    """The next page behind a cursor: the first `size` rows after the tuple `last`, in its order."""
    names = list(last)
    behind = F.struct(*names) > F.struct(*[F.lit(v).alias(n) for n, v in last.items()])
    return df.where(behind).orderBy(*names).limit(size)


def call_sites_state(sites: DataFrame, limit: int) -> DataFrame:
    """One row on a listing of call sites cut at `limit`: whether there are sites at all, whether
    it is cut, how many it shows and how many there are."""
    n = sites.agg(F.count(F.lit(1)).alias("n_sites"))
    return n.select((F.col("n_sites") > 0).alias("available"), (F.col("n_sites") > limit).alias("truncated"), F.least("n_sites", F.lit(limit)).cast("bigint").alias("n_shown"), "n_sites")


def architecture_documents(g: PropertyGraph, top: int = 20) -> DataFrame:
    """The first files, by path, that by name or folder tell of the architecture."""
    told = F.lower("file_path").rlike(r"(^|/)(readme|architecture|design)|(^|/)docs?/")
    return g.nodes.where((F.col("label") == "File") & told).select("id", "file_path").orderBy("file_path", "id").limit(top)
