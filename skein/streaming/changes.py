"""Change-driven updates: incremental classification, debounced notices, revisions, traces."""

from __future__ import annotations

import base64
import json
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import materialize, size_of


def incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, file_path, change) between two states `(project, file_path, mtime_ns, size,
    content_hash)`, each with one row per file: new, deleted, unchanged (same time and size, or the
    same content) or changed. A file whose hash is missing on either side counts as changed when
    its time or size differ."""
    key = ["project", "file_path"]
    o = old.select(*key, F.struct("mtime_ns", "size", F.lower(F.trim("content_hash")).alias("h")).alias("o"))
    n = new.select(F.col("project").alias("np"), F.col("file_path").alias("nf"), F.struct("mtime_ns", "size", F.lower(F.trim("content_hash")).alias("h")).alias("n"))
    on = F.col("project").eqNullSafe(F.col("np")) & F.col("file_path").eqNullSafe(F.col("nf"))
    both = o.join(n, on, "full_outer").select(F.coalesce("project", "np").alias("project"), F.coalesce("file_path", "nf").alias("file_path"), "o", "n")
    same = (F.col("o.mtime_ns").eqNullSafe(F.col("n.mtime_ns")) & F.col("o.size").eqNullSafe(F.col("n.size"))) | F.coalesce(F.col("o.h") == F.col("n.h"), F.lit(False))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return both.select(*key, change.alias("change"))


def debounce(notices: DataFrame, gap: str = "200 milliseconds", late: str | None = None) -> DataFrame:
    """The last notice of every burst of `notices(project, type, at, payload)`: notices of one
    project and type less than `gap` apart are one burst. Works on tables and on streams; a stream
    takes notices up to `late` (default: twice the gap) behind the latest, later ones are dropped,
    and tells a burst once it is over. Ties in time go to the greater payload."""
    if notices.isStreaming:
        notices = notices.withWatermark("at", late or _twice(gap))
    burst = notices.where("at is not null").groupBy("project", "type", F.session_window("at", gap).alias("w")).agg(F.max(F.struct("at", "payload")).alias("m"), F.count(F.lit(1)).alias("n"))
    return burst.select("project", "type", F.col("w.start").alias("began"), F.col("m.at").alias("at"), F.col("m.payload").alias("payload"), "n")


def _twice(gap: str) -> str:
    number, unit = gap.split()
    return f"{2 * int(number)} {unit}"


def poll_seconds(n_files: Column) -> Column:
    """How long to wait between looks at a repository: 5 s, one more per 500 files, at most 60."""
    return F.least(F.lit(60), 5 + F.floor(n_files / 500)).cast("int")


def revision(rows: DataFrame) -> DataFrame:
    """(project, revision): a token of each project's rows that changes with any of them and not
    with their order; it is combined before the shuffle."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rows.columns])
    mark = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    parts = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("s"))
    return parts.select("project", F.md5(F.concat_ws(":", "n", "x", "s")).alias("revision"))


class StaleCursor(ValueError):
    """A page was asked for by a cursor of another state of the table."""


def cursor(token: str, *place: object) -> str:
    """A place in a listing, bound to the revision it was read at."""
    return base64.urlsafe_b64encode(json.dumps([token, *place]).encode()).decode()


def resumed(text: str, token: str) -> list:
    """The place a cursor names, if the table is still at the revision `token`; else `StaleCursor`,
    upon which the reader begins again."""
    try:
        was, *place = json.loads(base64.urlsafe_b64decode(text.encode()))
    except (ValueError, TypeError) as e:
        raise ValueError("no cursor") from e
    if was != token:
        raise StaleCursor(f"the table went from {was} to {token}")
    return place


def rederived(change: DataFrame, old: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows by file after `change(project, file_path, change)`, see `incremental`: those of unchanged
    files as they were in `old`, those of new and changed files from `derive(files)`, and none of
    deleted ones. If files were only deleted nothing is derived."""
    key = ["project", "file_path"]
    todo = change.where(F.col("change").isin("new", "changed")).select(*key)
    kept = old.join(change.where("change = 'unchanged'").select(*key), key, "left_semi").select(*old.columns)
    return kept if todo.isEmpty() else kept.unionByName(derive(todo).select(*old.columns))


class Watcher:
    """What changed below a folder since the last look. The state of the last look lies in the
    shared folder, so a watcher that is opened again goes on where it was; a look that fails
    changes nothing. Files are listed by the executors and not read."""

    def __init__(self, spark: SparkSession, root: str, state: str, pattern: str = "*"):
        self.spark, self.root, self.state, self.pattern = spark, root, state, pattern

    def _seen(self, at: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        return self.spark.read.parquet(at) if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None

    def look(self) -> DataFrame:
        """(project, file_path, change) of the files that are new, changed or deleted."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern).load(self.root)
        none = F.lit(None).cast("string")
        now = files.select(F.lit(self.root).alias("project"), F.col("path").alias("file_path"), F.col("modificationTime").cast("string").alias("mtime_ns"), F.col("length").alias("size"), none.alias("content_hash"))
        now = materialize(now, "listing")
        was = self._seen(self.state)
        out = materialize(incremental(now.where(F.lit(False)) if was is None else materialize(was, "listing"), now).where("change <> 'unchanged'"), "changes")
        now.write.mode("overwrite").parquet(self.state)
        return out

    def watch(self, act: Callable[[DataFrame], None], looks: int, pause: float | None = None, quiet: float = 0.5) -> int:
        """Look `looks` times, `pause` seconds apart (by default by the number of files, see
        `poll_seconds`), and call `act` with what changed once it has been quiet for `quiet`
        seconds: changes that come while it waits are told together. Returns how often it acted."""
        acted = 0
        for n in range(looks):
            seen = self.look()
            if not seen.isEmpty():
                time.sleep(quiet)
                while not (more := self.look()).isEmpty():
                    last = seen.join(more.select("project", "file_path"), ["project", "file_path"], "left_anti")
                    seen = materialize(last.unionByName(more), "changes")
                    time.sleep(quiet)
                act(seen)
                acted += 1
            if n + 1 < looks:
                time.sleep(min(60, 5 + self.spark.read.parquet(self.state).count() // 500) if pause is None else pause)
        return acted


class RevisionCache:
    """Results kept by key and revision: a result is fresh for `fresh` seconds, then stale for as
    long again, when it is still served while `refresh` builds it anew, and gone after that. Results
    that are asked for often stay fresh longer, up to `longest` seconds; a result of another
    revision is never served. The least recently used go when all take more than `most_bytes`, as
    Spark estimates their size. Results are tables in the shared folder, so losing an executor
    loses none."""

    def __init__(self, fresh: float = 30, longest: float = 120, most_bytes: int = 1 << 30, clock: Callable[[], float] = time.monotonic):
        self.fresh, self.longest, self.most_bytes, self.clock = fresh, longest, most_bytes, clock
        self.kept: OrderedDict[str, dict] = OrderedDict()
        self.counts = {"fresh": 0, "stale": 0, "miss": 0}

    def get(self, key: str, token: str, build: Callable[[], DataFrame]) -> DataFrame:
        entry, now = self.kept.get(key), self.clock()
        if entry is None or entry["token"] != token or now >= entry["at"] + 2 * entry["ttl"]:
            self.counts["miss"] += 1
            return self._put(key, token, build)
        self.kept.move_to_end(key)
        entry["hits"] += 1
        if now < entry["at"] + entry["ttl"]:
            self.counts["fresh"] += 1
        else:
            self.counts["stale"] += 1
            entry["wanted"] = build
        return entry["df"]

    def refresh(self) -> int:
        """Build anew what was served stale; for whoever has time between questions."""
        due = [(k, e) for k, e in self.kept.items() if e["wanted"] is not None]
        for key, e in due:
            self._put(key, e["token"], e["wanted"])
        return len(due)

    def _put(self, key: str, token: str, build: Callable[[], DataFrame]) -> DataFrame:
        old = self.kept.pop(key, None)
        hits = old["hits"] if old is not None and old["token"] == token else 0
        ttl = min(self.longest, self.fresh * (4 if hits >= 10 else 2 if hits >= 3 else 1))
        df = materialize(build(), "cached")
        self.kept[key] = {"df": df, "token": token, "at": self.clock(), "ttl": ttl, "hits": hits, "bytes": size_of(df), "wanted": None}
        while len(self.kept) > 1 and sum(e["bytes"] for e in self.kept.values()) > self.most_bytes:
            self.kept.popitem(last=False)
        return df


def apply_batches(stream: DataFrame, path: str, write, checkpoint: str):
    """Run `write(batch, path)` for every micro-batch of a change feed, exactly once per batch id
    with an idempotent `write`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(batch, path)).trigger(availableNow=True).start()


def p99(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the value at place floor(0.99 * n), counted from 0 in ascending order. A key of many
    values is ranked by a window within its value's power of two, after the counts below it, so
    that no task sorts all of a key."""
    v = values.where(F.col(value).isNotNull()).withColumn("__b", F.when(F.col(value) > 0, F.floor(F.log2(F.col(value)))).otherwise(F.lit(-1)))
    from pyspark.sql import Window

    hist = v.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    by = Window.partitionBy(*keys).orderBy("__b")
    hist = hist.withColumn("__below", F.sum("__c").over(by) - F.col("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    place = F.floor(F.lit(0.99) * F.col("__n"))
    pick = hist.where((place >= F.col("__below")) & (place < F.col("__below") + F.col("__c"))).select(*keys, "__b", (place - F.col("__below") + 1).alias("__at"))
    inside = v.groupBy(*keys, "__b", value).agg(F.count(F.lit(1)).alias("__c")).join(pick, [*keys, "__b"])
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value))
    return inside.withColumn("__u", upto).where((F.col("__u") >= F.col("__at")) & (F.col("__u") - F.col("__c") < F.col("__at"))).select(*keys, F.col(value).alias("p99"))


def traffic(spans: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Requests per method, path and time window of `spans(at, method, path, duration_ns)`."""
    if spans.isStreaming:
        spans = spans.withWatermark("at", late)
    return spans.groupBy(F.window("at", width).alias("w"), "method", "path").agg(F.count(F.lit(1)).alias("n"), F.max("duration_ns").alias("slowest_ns")).select(F.col("w.start").alias("began"), "method", "path", "n", "slowest_ns")
