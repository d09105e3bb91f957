"""Keyed Parquet tables: create, read, upsert, snapshots, marks, training sets.

A table is a folder of immutable commit folders and a list of snapshots:

    data/commit=<id>/dt=<day>/...   the merged days one upsert wrote (day or month of the event time)
    marks/<id>/...                  oldest and newest time of each series in that upsert's batch
    _snapshots/<number>.json        which commit holds each day, whose marks add up, the schema

An upsert merges the old rows of the days its batch touches with the batch (last write per key wins), writes
them once into a folder of its own, and then creates the next snapshot file. Only that last step makes
them visible, so a job that stops before it changes nothing. A reader lists the files of one snapshot; later
upserts write elsewhere, so what it opened stays as it was until ``expire`` removes old snapshots.

The snapshot file is created exclusively. Of two writers that started from the same snapshot the second
one finds it taken and fails with ``ConcurrentWriteError``; nothing of its batch is visible.

``marks`` keeps the oldest and newest stored time of every series without a scan of the history: upserts
never remove keys, so the batches' own extremes add up to the table's.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.errors import ConcurrentWriteError, DataContractError
from tidemark.operators.keyed import dedup_last
from tidemark.session import scratch_path

DAY_COLUMN = "dt"
FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
OLDEST, NEWEST = "stored_min", "stored_max"
_SEQ = "_write_order"
MARK_PARTS = 8  # so many upserts' marks are added up on reading before they are written as one
GRACE_SECONDS = 5  # a snapshot file still unreadable after this belongs to a writer that died


@dataclass(frozen=True)
class Snapshot:
    """One state of a table. The driver holds a row a day (or month), whatever the rows."""

    number: int = 0
    base: int = 0
    schema: str | None = None
    days: dict[str, str] = field(default_factory=dict)
    marks: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    root: str
    name: str
    version: int
    keys: tuple[str, ...]
    event_time: str
    period: str = "day"

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}/version={self.version}"

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    @property
    def series(self) -> tuple[str, ...]:
        """The keys that name a series: all but the event time; none where rows are not keyed by time."""
        return tuple(k for k in self.keys if k != self.event_time) if self.event_time in self.keys else ()

    # -- snapshots ---------------------------------------------------------------
    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in _fs_list(self.spark, f"{self.path}/_snapshots") if n.endswith(".json"))

    def _load(self, number: int) -> Snapshot | None:
        """A snapshot, or None while its file is being written or is gone."""
        try:
            return Snapshot(**json.loads(_fs_text(self.spark, f"{self.path}/_snapshots/{number:012d}.json")))
        except (ValueError, TypeError, Py4JJavaError):
            return None

    def snapshot(self, as_of: int | None = None) -> Snapshot:
        """The newest snapshot, or a given one; an empty one for a table without rows."""
        if as_of is not None:
            found = self._load(as_of)
            if found is None:
                raise DataContractError(f"{self.name} has no snapshot {as_of}")
            return found
        return next((s for n in reversed(self._numbers()) if (s := self._load(n))), Snapshot())

    def _publish(self, base: Snapshot, days: dict[str, str], marks: list[str], schema: str,
                 batches: dict[str, int]) -> Snapshot:
        taken = [n for n in self._numbers() if n > base.number]
        if taken and not any(map(self._load, taken)):
            time.sleep(GRACE_SECONDS)
        if any(map(self._load, taken)):
            raise ConcurrentWriteError(f"{self.name}: another writer has published since snapshot {base.number}")
        new = Snapshot(max([base.number, *taken]) + 1, base.number, schema, {**base.days, **days}, marks,
                       {**base.batches, **batches})
        if not _fs_create(self.spark, f"{self.path}/_snapshots/{new.number:012d}.json", json.dumps(asdict(new))):
            raise ConcurrentWriteError(f"{self.name}: another writer has published snapshot {new.number}")
        later = (self._load(n) for n in self._numbers() if n > new.number)
        if any(s and s.base < new.number for s in later):  # taken for dead while it wrote this file
            raise ConcurrentWriteError(f"{self.name}: snapshot {new.number} was passed over by another writer")
        return new

    # -- reading -----------------------------------------------------------------
    def exists(self) -> bool:
        return self.snapshot().number > 0

    def read(self, columns: list[str] | None = None, since=None, days: list[str] | None = None,
             as_of: int | None = None) -> DataFrame:
        """Lazy scan of one snapshot, the newest unless ``as_of`` names one. ``columns`` prunes the
        scan; ``since`` prunes days as well as rows; ``days`` lists the days (or months) wanted."""
        snap = self.snapshot(as_of)
        if not snap.number:
            raise DataContractError(f"{self.name} holds no rows yet")
        df = self._scan(snap, snap.days if days is None else days, since)
        return df.select(*columns) if columns else df.drop(DAY_COLUMN)

    def _scan(self, snap: Snapshot, days, since=None) -> DataFrame:
        if since is not None:
            low = str(since)[: len("yyyy-MM-dd" if self.period == "day" else "yyyy-MM")]
            days = [d for d in days if d >= low]
        paths = [f"{self.data}/commit={snap.days[d]}/{DAY_COLUMN}={d}" for d in sorted(days) if d in snap.days]
        schema = snap.rows.add(DAY_COLUMN, T.StringType())
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", self.data).parquet(*paths).select(*schema.names)
        if since is None:
            return df
        bound = F.lit(since).cast("timestamp_ntz")
        return df.where(F.col(DAY_COLUMN) >= F.date_format(bound, FORMATS[self.period])).where(F.col(self.event_time) >= bound)

    def marks(self) -> DataFrame:
        """Oldest and newest stored time of each series (of the table, where it has no series)."""
        snap = self.snapshot()
        if not snap.number:
            raise DataContractError(f"{self.name} holds no rows yet")
        return self._marks(snap)

    def _marks(self, snap: Snapshot) -> DataFrame:
        schema = T.StructType([snap.rows[k] for k in self.series] + [
            T.StructField(c, snap.rows[self.event_time].dataType) for c in (OLDEST, NEWEST)])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/marks/{m}" for m in snap.marks])
        return rows.groupBy(*self.series).agg(F.min(OLDEST).alias(OLDEST), F.max(NEWEST).alias(NEWEST))

    # -- writing -----------------------------------------------------------------
    def _dated(self, df: DataFrame) -> DataFrame:
        return df.withColumn(DAY_COLUMN, F.date_format(self.event_time, FORMATS[self.period]))

    def upsert(self, batch: DataFrame, order: str | None = None, stored: bool = False,
               unique: bool = False, stream: tuple[str, int] | None = None) -> int:
        """Insert new keys and replace known ones; returns the number of days written.

        The batch is read more than once, so it is written to the shared folder first, unless
        ``stored`` says that it is a plain scan already.

        ``order`` ranks several rows of one key inside the batch (and against stored rows when
        the table keeps that column). Without it a batch that repeats a key is refused; ``unique``
        says that this was checked before. ``stream`` is (name, batch number): a batch with no greater
        number than the last one published under that name is skipped, so a repeated one counts once.
        """
        base = self.snapshot()
        if stream and base.batches.get(stream[0], -1) >= stream[1]:
            return 0
        path = None
        if not stored:
            path = scratch_path(self.spark, "batch")
            batch.write.parquet(path)
            batch = self.spark.read.schema(batch.schema).parquet(path)
        try:
            return self._merge(base, self._dated(batch), order, unique, dict([stream] if stream else []))
        finally:
            if path:
                _fs_delete(self.spark, path)

    def _merge(self, base: Snapshot, dated: DataFrame, order: str | None, unique: bool, batches: dict[str, int]) -> int:
        if order is None and not unique:
            twice = dated.groupBy(*self.keys).count().where("count > 1").limit(5).collect()
            if twice:
                raise DataContractError(f"the batch repeats keys: {[tuple(r)[:-1] for r in twice]}")
        commit = uuid.uuid4().hex
        target = f"{self.data}/commit={commit}"
        try:
            self._write(self._merged(base, dated, order), target)
            days = [n.split("=", 1)[1] for n in _fs_list(self.spark, target) if n.startswith(f"{DAY_COLUMN}=")]
            if not days and not batches:
                return 0
            rows = base.schema or dated.drop(DAY_COLUMN).schema.json()
            marks = self._write_marks(base, dated, commit) if days else base.marks
            self._publish(base, dict.fromkeys(days, commit), marks, rows, batches)
        except BaseException:
            for gone in (target, f"{self.path}/marks/{commit}"):
                _fs_delete(self.spark, gone)
            raise
        return len(days)

    def _merged(self, base: Snapshot, dated: DataFrame, order: str | None) -> DataFrame:
        """The rows of the touched days as they are after the upsert."""
        if not base.days:
            rows = dated.where(F.col(DAY_COLUMN).isNotNull() | F.raise_error(F.lit(f"{self.event_time} must not be NULL")))
            return dedup_last(rows, list(self.keys), [order or self.event_time])
        # days (or months) of the calendar: a few hundred a year, whatever the rows
        days = [r[0] for r in dated.select(DAY_COLUMN).distinct().collect()]
        if None in days:
            raise DataContractError(f"{self.event_time} must not be NULL")
        if set(dated.columns) != {*base.rows.names, DAY_COLUMN}:
            raise DataContractError(f"columns differ from the table's: {sorted(set(dated.columns) ^ {*base.rows.names, DAY_COLUMN})}")
        dated = dated.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in base.rows], DAY_COLUMN)
        old = self._scan(base, days)
        new = old.withColumn(_SEQ, F.lit(0)).unionByName(dated.withColumn(_SEQ, F.lit(1)))
        return dedup_last(new, list(self.keys), [order, _SEQ] if order else [_SEQ]).drop(_SEQ)

    def _write(self, df: DataFrame, path: str) -> None:
        # REBALANCE lets adaptive execution split a heavy day and join light ones
        df.hint("rebalance", DAY_COLUMN).write.option("partitionOverwriteMode", "static").partitionBy(DAY_COLUMN).parquet(path)

    def _write_marks(self, base: Snapshot, dated: DataFrame, commit: str) -> list[str]:
        own = dated.groupBy(*self.series).agg(F.min(self.event_time).alias(OLDEST), F.max(self.event_time).alias(NEWEST))
        full = len(base.marks) >= MARK_PARTS
        if full:
            own = self._marks(base).unionByName(own).groupBy(*self.series).agg(
                F.min(OLDEST).alias(OLDEST), F.max(NEWEST).alias(NEWEST))
        own.write.parquet(f"{self.path}/marks/{commit}")
        return [commit] if full else [*base.marks, commit]

    def expire(self, keep: int = 10, hours: float = 168.0) -> int:
        """Remove all but the newest ``keep`` snapshots and what only they, or stopped writers, refer to.

        Files younger than ``hours`` stay: they may belong to a running writer, or a reader may have
        them open. Returns the number of folders removed."""
        numbers = [n for n in self._numbers() if self._load(n)]
        held = [self._load(n) for n in numbers[-keep:]]
        used = {(c, d) for s in held for d, c in s.days.items()}
        marks = {m for s in held for m in s.marks}
        before = time.time() - hours * 3600
        for n in numbers[:-keep]:
            _fs_delete(self.spark, f"{self.path}/_snapshots/{n:012d}.json")
        gone = 0
        for name, changed in _fs_status(self.spark, self.data):
            commit = name.removeprefix("commit=")
            if changed >= before:
                continue
            if commit not in {c for c, _ in used}:
                _fs_delete(self.spark, f"{self.data}/{name}")
                gone += 1
                continue
            for day, _ in _fs_status(self.spark, f"{self.data}/{name}"):
                if day.startswith(f"{DAY_COLUMN}=") and (commit, day.split("=", 1)[1]) not in used:
                    _fs_delete(self.spark, f"{self.data}/{name}/{day}")
                    gone += 1
        for name, changed in _fs_status(self.spark, f"{self.path}/marks"):
            if name not in marks and changed < before:
                _fs_delete(self.spark, f"{self.path}/marks/{name}")
                gone += 1
        return gone


def create_table(spark: SparkSession, root: str, name: str, version: int, keys: tuple[str, ...],
                 event_time: str, period: str = "day") -> KeyedTable:
    """Get or create; a table that exists with other keys is an error."""
    table = KeyedTable(spark, root.rstrip("/"), name, version, tuple(keys), event_time, period)
    meta = f"{table.path}/_meta/table.json"
    wanted = {"name": name, "version": version, "keys": list(keys), "event_time": event_time,
              "period": period}
    if _fs_exists(spark, meta):
        stored = json.loads(_fs_read(spark, meta))
        if stored != wanted:
            raise DataContractError(f"table exists as {stored}")
    else:
        _fs_write(spark, meta, json.dumps(wanted))
    return table


def table_meta(table: KeyedTable) -> DataFrame:
    return table.spark.read.json(f"{table.path}/_meta/table.json")


def next_version(spark: SparkSession, root: str) -> int:
    return max(versions(spark, root), default=0) + 1


def versions(spark: SparkSession, root: str) -> list[int]:
    names = [n for n in _fs_list(spark, root) if n.startswith("version=")]
    return sorted(int(n.split("=", 1)[1]) for n in names)


def write_training_set(df: DataFrame, root: str) -> int:
    """Immutable Parquet snapshot with the next version number."""
    spark = df.sparkSession
    version = next_version(spark, root)
    df.write.mode("error").parquet(f"{root}/version={version}")
    return version


def read_training_set(spark: SparkSession, root: str, version: int, keys: list[str],
                      labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, labels), both with the key so that they can be joined again."""
    df = spark.read.parquet(f"{root}/version={version}")
    features = [c for c in df.columns if c not in keys and c not in labels]
    return df.select(*keys, *features), df.select(*keys, *labels)


# -- file system, through the Hadoop API Spark itself uses ---------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _fs_exists(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _fs_list(spark, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _fs_delete(spark, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _fs_write(spark, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _fs_create(spark, path: str, text: str) -> bool:
    """Create a file with its content; False if there is one of that name already."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _fs_status(spark, path: str) -> list[tuple[str, float]]:
    """(name, time of the last change in seconds) of what a folder holds."""
    fs, p = _fs(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []


def _fs_text(spark, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _fs_claim(spark, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    fs, p = _fs(spark, path)
    return fs.createNewFile(p)


def _fs_read(spark, path: str) -> str:
    return _fs_text(spark, path)
