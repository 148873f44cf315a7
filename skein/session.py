"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need not find
    it on their own path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = Path(__file__).resolve().parent
    at = tempfile.mkdtemp(prefix="skein-code-")  # the driver serves it from here until it ends
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    packed = Path(at) / f"{home.name}.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(packed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only a local master, whose executors are this machine, gets a folder of its own when the
    setting is absent; a cluster without the setting is an error, since a machine-local folder
    would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="skein-")
    spark.conf.set("spark.checkpoint.dir", named)
    _OWN_DIRS.append((spark, named))
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN_DIRS.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage is cut, and the files
    outlive any executor. `options` go to the Parquet writer."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*written: DataFrame | None) -> None:
    """Remove the tables of DataFrames from `materialize` that nothing reads any more, as those of a
    round when the next one is written, so a long loop keeps two rounds on disk."""
    for df in written:
        path = getattr(df, "written_to", None)
        if path is None:
            continue
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _OWN_DIRS.remove((spark, path))


def evaluated(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """`df` with a column that is computed once per row: a generator keeps the optimizer from
    writing the expression out again inside every lambda that refers to it."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def size_of(df: DataFrame) -> int:
    """Catalyst's size estimate in bytes; for files, their length."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_OWN_DIRS):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            return
