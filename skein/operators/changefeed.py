"""Applying a feed of changes: a log-structured table of sorted runs, merged on read.

Every appended batch becomes a run: its changes, each once, in ranges of sequence numbers, sorted
by record and sequence inside a range. A manifest names the runs in being. Reading merges the runs
range by range, which bounds what meets in one place by the width of a range, and folds the
effects of a record in the order of sequence. Compaction merges the runs of a level into one run of
the next, leaves out repeats and what a later change of the record makes void, writes a new
manifest and removes its inputs. A tombstone is a change that leaves the record absent whatever was
before; it stays, since older changes may still lie in other runs or be on their way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein.session import shared_path


@dataclass(frozen=True)
class Effect:
    """What an action does. `absent`: the record's columns if it was absent before, None if it
    stays so. `present`: the columns it overwrites if the record was there, None if the record
    goes; other columns are kept."""

    absent: Mapping[str, object] | None
    present: Mapping[str, object] | None

    def absolute(self, columns: list[str]) -> bool:
        """Whether the outcome is the same whatever was before."""
        if self.absent is None or self.present is None:
            return self.absent is None and self.present is None
        return all(c in self.present and self.present[c] == self.absent.get(c) for c in columns)


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool | int | float):
        return str(value).lower()
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Effects:
    """The actions of a feed and the `columns` (name to SQL type) of its records. Actions that are
    not listed change nothing. A value of null in `present` keeps what was before. Expressions are
    written as SQL, which Spark parses at once however many actions there are."""

    def __init__(self, columns: Mapping[str, str], actions: Mapping[str, Effect]):
        self.columns, self.actions = dict(columns), dict(actions)
        fields = ", ".join(f"{c}: {t}" for c, t in self.columns.items())
        self.type = f"struct<n_in: boolean, n: struct<{fields}>, p_in: boolean, p: struct<{fields}>>"
        self.identity = self._struct(False, {}, True, {})

    def _struct(self, n_in: bool, n: Mapping, p_in: bool, p: Mapping) -> str:
        state = lambda values: "named_struct(" + ", ".join(f"'{c}', cast({_literal(values.get(c))} as {t})" for c, t in self.columns.items()) + ")"
        return f"cast(named_struct('n_in', {_literal(n_in)}, 'n', {state(n)}, 'p_in', {_literal(p_in)}, 'p', {state(p)}) as {self.type})"

    def of(self, action: str) -> Column:
        """The effect of the change in a column: what it makes of a record absent before (n) and
        present (p)."""
        cases = [f"when {_literal(a)} then {self._struct(e.absent is not None, e.absent or {}, e.present is not None, e.present or {})}" for a, e in self.actions.items()]
        return F.expr(f"case {action} {' '.join(cases)} else {self.identity} end" if cases else self.identity)

    def tombstone(self, action: Column) -> Column:
        return action.isin([a for a, e in self.actions.items() if e.absent is None and e.present is None])

    def absolute(self, action: Column) -> Column:
        return action.isin([a for a, e in self.actions.items() if e.absolute(list(self.columns))])

    def _composed(self, first: str, then: str) -> str:
        """The effect of `first` followed by `then`."""

        def after(side: str) -> str:
            was_in, was = f"{first}.{side}_in", f"{first}.{side}"
            present = f"if({was_in}, {then}.p_in, {then}.n_in)"
            cells = ", ".join(f"'{c}', if({present}, if({was_in}, coalesce({then}.p.{c}, {was}.{c}), {then}.n.{c}), null)" for c in self.columns)
            return f"'{side}_in', {present}, '{side}', named_struct({cells})"

        return f"cast(named_struct({after('n')}, {after('p')}) as {self.type})"

    def fold(self, effects: str) -> Column:
        """All effects of an array in a column, one after the other."""
        return F.expr(f"aggregate({effects}, {self.identity}, (acc, x) -> {self._composed('acc', 'x')})")


class ChangeTable:
    """A table kept as sorted runs below one folder of the shared file system; opened again by its
    path it goes on where it was.

    `append` takes rows of (scope, seq, record, action, tie): scope and seq identify a change,
    delivered any number of times and in any order. Of differing deliveries of one change the one
    in the earliest run counts, and within a run the one with the least tie, then record, then
    action; a change that compaction has found void is forgotten, and its number counts as new. A
    change without a seq, a scope or a record cannot be placed and is left out. `read` gives the
    records present after all changes, with the columns of `effects`; an empty feed gives no rows.

    `width` is the number of sequence numbers in a range: as a number counts once, no group holds
    more changes, whatever share of the feed a scope or a record has. `fan_in` runs of one level
    are compacted into one of the next when `append` has written the last of them.
    """

    def __init__(self, spark: SparkSession, effects: Effects, path: str | None = None, fan_in: int = 8, width: int = 1024):
        self.spark, self.effects, self.fan_in, self.width = spark, effects, fan_in, width
        self.path = path or shared_path(spark, "changes")
        self.version, self.runs = self._manifest()

    # --- the manifest: one small file a version, the greatest one counts

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, list[dict]]:
        jvm, at, fs = self._fs()
        if not fs.exists(at):
            return 0, []
        last = max((f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("v")), default=None)
        if last is None:
            return 0, []
        text = self.spark.read.text(f"{self.path}/manifest/{last}", wholetext=True).first()[0]
        return int(last[1:]), json.loads(text)

    def _publish(self, runs: list[dict]) -> None:
        """Write the next version beside the last and put it in place by renaming, so a reader sees
        the runs of one version or of the other."""
        jvm, at, fs = self._fs()
        temp = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        if not fs.rename(temp, jvm.org.apache.hadoop.fs.Path(at, f"v{self.version + 1:010d}")):
            raise RuntimeError(f"another writer has changed {self.path}")
        self.version, self.runs = self.version + 1, runs

    # --- writing

    def _ranged(self, changes: DataFrame) -> DataFrame:
        return changes.withColumn("range", F.floor(F.col("seq") / self.width))

    def _write(self, changes: DataFrame, level: int, inputs: list[dict]) -> None:
        name = f"level={level}-{uuid.uuid4().hex}"
        seen = Observation()
        told = changes.observe(seen, F.min("seq").alias("low"), F.max("seq").alias("high"))
        told.sortWithinPartitions("scope", "range", "record", "seq").write.parquet(f"{self.path}/runs/{name}")
        born = min((r["born"] for r in inputs), default=self.version)
        self._publish([r for r in self.runs if r not in inputs] + [{"run": name, "level": level, "born": born, **seen.get}])

    def _once(self, changes: DataFrame) -> DataFrame:
        """Each change once, with the run it first came in; the rows of a range stay together."""
        together = self._ranged(changes).repartition("scope", "range")
        one = together.groupBy("scope", "range", "seq").agg(F.min(F.struct("born", "tie", "record", "action")).alias("c"))
        return one.select("scope", "range", "seq", "c.record", "c.action", "c.tie", "c.born")

    def append(self, changes: DataFrame) -> None:
        whole = changes.where("scope is not null and seq is not null and record is not null").select("scope", "seq", "record", "action", "tie")
        self._write(self._once(whole.withColumn("born", F.lit(self.version))).drop("born"), 0, [])
        level = 0
        while sum(r["level"] == level for r in self.runs) >= self.fan_in:
            self.compact(level)
            level += 1

    def compact(self, level: int | None = None, settled: int | None = None) -> None:
        """Merge the runs of `level`, or all of them, into one of the next level. Changes that come
        before an absolute one of their record are void. If all runs are merged and no change up
        to the number `settled` is still to come, tombstones up to it go too."""
        inputs = [r for r in self.runs if level is None or r["level"] == level]
        if not inputs:
            return
        once = self._once(self._stored(inputs))
        last = once.where(self.effects.absolute(F.col("action"))).groupBy("scope", "record").agg(F.max("seq").alias("from"))
        kept = once.join(last, ["scope", "record"], "left").where("from is null or seq >= from")
        if settled is not None and len(inputs) == len(self.runs):
            kept = kept.where(~(self.effects.tombstone(F.col("action")) & (F.col("seq") <= settled)))
        kept = kept.select("scope", "range", "seq", "record", "action", "tie").repartition("scope", "range")
        self._write(kept, max(r["level"] for r in inputs) + 1, inputs)
        jvm, _, fs = self._fs()
        for r in inputs:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{r['run']}"), True)

    # --- reading

    def _stored(self, runs: list[dict]) -> DataFrame:
        each = [self.spark.read.parquet(f"{self.path}/runs/{r['run']}").select("scope", "seq", "record", "action", "tie").withColumn("born", F.lit(r["born"])) for r in runs]
        return reduce(DataFrame.unionByName, each)

    def folded(self) -> DataFrame:
        """(scope, record, effect) of all changes: the runs merge range by range, where the changes
        of a record meet in order; then `width` neighbouring ranges fold at a time."""
        once = self._once(self._stored(self.runs)).select("scope", "range", "record", "seq", self.effects.of("action").alias("effect"))
        level = self._folded(once, "seq", ["scope", "range", "record"])
        low, high = (f((r[k] for r in self.runs if r[k] is not None), default=0) for f, k in ((min, "low"), (max, "high")))
        base, span = low // self.width, high // self.width - low // self.width
        level = level.withColumn("range", F.col("range") - F.lit(base))
        while span:
            span //= self.width
            level = self._folded(level.withColumnRenamed("range", "at").withColumn("range", F.floor(F.col("at") / self.width)), "at", ["scope", "range", "record"])
        return level.select("scope", "record", "effect")

    def _folded(self, rows: DataFrame, order: str, by: list[str]) -> DataFrame:
        seq = F.sort_array(F.collect_list(F.struct(order, "effect")))
        return rows.groupBy(*by).agg(seq.alias("s")).select(*by, self.effects.fold("s.effect").alias("effect"))

    def read(self) -> DataFrame:
        """(scope, record, *columns) of the records present."""
        if not self.runs:
            fields = ", ".join(f"{c} {t}" for c, t in self.effects.columns.items())
            return self.spark.createDataFrame([], f"scope string, record string, {fields}")
        return self.folded().where("effect.n_in").select("scope", "record", *[F.col(f"effect.n.{c}").alias(c) for c in self.effects.columns])
