"""Stored tables that take changes without being rewritten.

A table is a base and a log. The base is Parquet, one folder per part (a month, or a bucket of the key); the log is
one folder per change, with the new state of each row that changed, or its key and a mark that it is gone. Reading merges:
parts without changes are read as they are, in the others the newest log row of a key replaces its base row. So a
change costs what it changes, and compaction rewrites the parts that have changes and no other.

What belongs to the table is said by a small version file. Every change writes the next one, which must not exist
yet: readers see the table before or after a change, and of two writers that started from one version the later
one is refused (:class:`Outdated`) and starts again. Nothing is renamed or overwritten that a reader may hold.

A key has one row, and its part never changes. Parts are plain text such as ``1995-03``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxtally.operators.dedup import first_per_key
from boxtally.operators.tables import new_rows

BUCKETS = 32


class Outdated(RuntimeError):
    """Another writer was first; read again and repeat the change."""


class LoggedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], *,
                 part: Callable[[], Column] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()
        self._by_key = part is None
        self._part = part or (lambda: F.lpad(F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string"), 4, "0"))

    # -- versions ---------------------------------------------------------------

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, conf, jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """Number of the newest version; 0 for a table that was never written."""
        _, conf, path = self._files()
        folder = path(f"{self.path}/versions")
        fs = folder.getFileSystem(conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "base": {}, "log": {}}
        rows = self.spark.read.text(f"{self.path}/versions/{version:08d}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def _commit(self, state: dict) -> None:
        """Write the version after the one ``state`` was read from. The file appears whole or not at all."""
        jvm, conf, path = self._files()
        state = state | {"version": state["version"] + 1}
        target, draft = path(f"{self.path}/versions/{state['version']:08d}.json"), path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs = target.getFileSystem(conf)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # unlike a rename of the file system, this one refuses a target that exists
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(
                fs.makeQualified(draft), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Outdated(f"version {state['version']} of {self.path} was written by another change") from e
            raise

    # -- reading ----------------------------------------------------------------

    def _base(self, state: dict, keep: Callable[[str], bool] = lambda part: True) -> DataFrame:
        folders = [f"{self.path}/base/{folder}/_part={part}" for part, (folder, _) in state["base"].items() if folder and keep(part)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _log(self, state: dict) -> DataFrame:
        """Log rows without those that compaction has taken up."""
        schema = StructType(list(self.schema.fields)).add("_seq", "long").add("_gone", "boolean").add("_part", "string")
        if not state["log"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/log/{folder}" for folder, _ in state["log"].values()])
        floors = {part: seq for part, (_, seq) in state["base"].items() if seq}
        if floors:
            floor = F.create_map(*[F.lit(v) for pair in floors.items() for v in pair])
            rows = rows.where(F.col("_seq") > F.coalesce(floor[F.col("_part")].cast("long"), F.lit(0)))
        return rows

    def _newest(self, state: dict) -> DataFrame:
        """Newest log row of every key. A window, since it moves only the columns that its reader takes."""
        rows = self._log(state)
        return rows if len(state["log"]) == 1 else first_per_key(rows, self.key, [F.desc("_seq")])

    @staticmethod
    def _busy(state: dict) -> set[str]:
        """Parts with changes that compaction has not taken up."""
        return {part for seq, (_, parts) in state["log"].items() for part in parts
                if int(seq) > state["base"].get(part, ["", 0])[1]}

    def _merged(self, state: dict, keep: Callable[[str], bool] = lambda part: True) -> DataFrame:
        busy = self._busy(state)
        calm = self._base(state, lambda part: keep(part) and part not in busy)
        if not busy:
            return calm
        changed = self._base(state, lambda part: keep(part) and part in busy).join(
            self._log(state).select(*self.key), self.key, "left_anti")
        alive = self._newest(state).where(~F.col("_gone"))
        wanted = [p for p in busy if keep(p)]
        if len(wanted) < len(busy):
            alive = alive.where(F.col("_part").isin(wanted))
        return calm.unionByName(changed.select(*self.columns)).unionByName(alive.select(*self.columns))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was at an earlier version that was not cleaned up."""
        return self._merged(self._state(version))

    def current(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys. Where parts follow from the key, only their folders are opened."""
        return self._current(self._state(), keys.select(*self.key))

    def _current(self, state: dict, keys: DataFrame) -> DataFrame:
        if not self._by_key:
            return self._merged(state).join(keys, self.key, "left_semi")
        parts = {r[0] for r in keys.select(self._part().alias("p")).distinct().collect()}
        return self._merged(state, parts.__contains__).join(keys, self.key, "left_semi")

    # -- changes ----------------------------------------------------------------

    def create(self, rows: DataFrame) -> None:
        """Write the first base. Busy parts become several files, since the rows stay in the tasks they come in."""
        self._rebase({"version": 0, "base": {}, "log": {}}, rows, set())

    def _rebase(self, state: dict, rows: DataFrame, parts: set[str], seq: int = 0) -> None:
        folder = uuid.uuid4().hex
        to = f"{self.path}/base/{folder}"
        rows.select(*self.columns, F.coalesce(self._part(), F.lit("none")).alias("_part")).write.partitionBy("_part").parquet(to)
        _, conf, path = self._files()
        listed = path(to).getFileSystem(conf).listStatus(path(to))
        found = {n.split("=", 1)[1] for n in (s.getPath().getName() for s in listed) if n.startswith("_part=")}
        base = state["base"] | {p: ["", seq] for p in parts} | {p: [folder, seq] for p in found}
        log = {s: e for s, e in state["log"].items() if any(int(s) > base.get(p, ["", 0])[1] for p in e[1])}
        self._commit(state | {"base": base, "log": log})

    def _append(self, state: dict, rows: DataFrame) -> None:
        folder, seq = uuid.uuid4().hex, state["version"] + 1
        to = f"{self.path}/log/{folder}"
        columns = [F.col(c) if c in self.key else F.when(~F.col("_gone"), F.col(c)).alias(c) for c in self.columns]
        rows.select(*columns, F.lit(seq).cast("long").alias("_seq"), "_gone",
                    F.coalesce(self._part(), F.lit("none")).alias("_part")).write.parquet(to)
        parts = sorted(r[0] for r in self.spark.read.schema("_part string").parquet(to).distinct().collect())
        if parts:
            self._commit(state | {"log": state["log"] | {str(seq): [folder, parts]}})

    def put(self, rows: DataFrame) -> None:
        """New state of the rows of some keys, or new rows; one row per key."""
        self._append(self._state(), rows.withColumn("_gone", F.lit(False)))

    def insert_if_absent(self, batch: DataFrame, order: list) -> None:
        """Insert the first row of each key that is not stored; stored rows stay as they are."""
        state = self._state()
        fresh = new_rows(self._current(state, batch.select(*self.key).distinct()), batch, self.key, order)
        self._append(state, fresh.withColumn("_gone", F.lit(False)))

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Put ``change`` of the stored rows of ``keys``; keys that are not stored are passed over."""
        state = self._state()
        self._append(state, change(self._current(state, keys.select(*self.key).distinct())).withColumn("_gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        state = self._state()
        self._append(state, self._current(state, keys.select(*self.key).distinct()).withColumn("_gone", F.lit(True)))

    def delete_where(self, column: str, values: DataFrame) -> None:
        """Delete the rows whose ``column`` is among the values (clear, cascading delete)."""
        state = self._state()
        gone = self._merged(state).join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
        self._append(state, gone.select(*self.columns).withColumn("_gone", F.lit(True)))

    def compact(self, parts: Iterable[str] | None = None) -> None:
        """Rewrite the parts that have changes (or some of them) as base; other parts are not touched."""
        state = self._state()
        busy = self._busy(state) if parts is None else self._busy(state) & set(parts)
        if busy:
            self._rebase(state, self._merged(state, busy.__contains__), busy, state["version"])

    def clean(self, keep: int = 1) -> None:
        """Delete what only versions before the newest ``keep`` refer to."""
        newest = self.version()
        states = [self._state(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        used = {folder for s in states for folder, _ in [*s["base"].values(), *s["log"].values()]}
        _, conf, path = self._files()
        for kind in ("base", "log"):
            folder = path(f"{self.path}/{kind}")
            fs = folder.getFileSystem(conf)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName() not in used:
                    fs.delete(status.getPath(), True)
        for v in range(1, newest - keep + 1):
            target = path(f"{self.path}/versions/{v:08d}.json")
            target.getFileSystem(conf).delete(target, False)
