"""The property graph: node and edge tables with open JSON properties, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import materialize, shared_dir, table

NODE = ("id", "project", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties_json")
EDGE = ("id", "project", "source_id", "target_id", "type", "properties_json")


#: Snapshots by application and state of the files they were made from.
_SNAPSHOTS: dict[tuple, PropertyGraph] = {}


def _revision(spark: SparkSession, sf_dir: str) -> tuple:
    """The files of the node and edge tables with their lengths and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in ("nodes", "edges"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        for f in p.getFileSystem(conf).listStatus(p):
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (spark.sparkContext.applicationId, *sorted(seen))


@dataclass(frozen=True)
class PropertyGraph:
    """`nodes` has the columns NODE, one row per id; `edges` the columns EDGE, one row per id."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        """The graph in being, from the delivered tables in a folder, as a snapshot: it is written
        to the shared folder once for each state of the files (their names, lengths and times), so
        queries read settled tables. A cluster that names no shared folder is an error."""
        at = _revision(spark, sf_dir)
        shared_dir(spark)
        if at not in _SNAPSHOTS:
            g = cls.settled(spark, sf_dir)
            # laid out so that look-ups prune: by id, by source, and by filters on names and targets
            nodes = g.nodes.repartitionByRange("id").sortWithinPartitions("id")
            edges = g.edges.repartitionByRange("source_id", "id").sortWithinPartitions("source_id", "id")
            told = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("qualified_name", "name", "target_id")}
            _SNAPSHOTS[at] = cls(materialize(nodes, "nodes", **told), materialize(edges, "edges", **told))
        return _SNAPSHOTS[at]

    @classmethod
    def settled(cls, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        """Of each node id its latest delivery, unless that is a deletion; of each edge id one row.
        Rows without an id, and edges without an endpoint, are left out."""
        n = table(spark, sf_dir, "nodes").where("id is not null")
        state = n.groupBy("id").agg(F.max(F.struct("indexed_at", "deleted_at", *NODE[1:])).alias("s"))
        nodes = state.where("s.deleted_at is null").select("id", *[f"s.{c}" for c in NODE[1:]])
        e = table(spark, sf_dir, "edges").where("id is not null and source_id is not null and target_id is not null")
        edges = e.groupBy("id").agg(F.max(F.struct("indexed_at", *EDGE[1:])).alias("s")).select("id", *[f"s.{c}" for c in EDGE[1:]])
        return cls(nodes, edges)

    @cached_property
    def calls(self) -> DataFrame:
        return self.edges.where("type = 'CALLS'")

    def degrees(self, *types: str) -> DataFrame:
        """(id, in_degree, out_degree) of the nodes that have an edge of `types` (all if none): one
        pass over the edges, combined before the shuffle, so a hub is one row per partition."""
        edges = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i")))).alias("x"))
        return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").cast("bigint").alias("in_degree"), F.sum(1 - F.col("x.i")).cast("bigint").alias("out_degree"))


def prop(key: str, column: str = "properties_json") -> Column:
    """A JSON property as text; null if absent or if the text is no JSON."""
    return F.get_json_object(column, f"$.{key}")
