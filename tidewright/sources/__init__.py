"""Readers and writers of tables, versioned tables, a change log, and subset loading."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.functions.columns import Compiler
from tidewright.plans.ir import Ref, Table, replace
from tidewright.plans.planner import _struct
from tidewright.plans.predicates import Loads, Subset, is_subset

FORMATS = ("parquet", "orc", "json", "csv", "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and executors share: spark.checkpoint.dir, or, where all run on one machine, one of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def read(spark: SparkSession, path: str, key: tuple[str, ...] = (), format: str = "parquet", schema: Any = None, name: str = "", **options: Any) -> Table:
    """A keyed table of files.  JSON and CSV want a schema, as inferring one reads everything twice."""
    if format not in FORMATS:
        raise ValueError(f"no reader for {format!r}")
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif format in ("json", "csv"):
        raise ValueError(f"{format} is read with a schema")
    return Table(reader.load(path), tuple(key), name)


def read_jdbc(spark: SparkSession, url: str, table: str, key: tuple[str, ...] = (), partition: tuple[str, int, int, int] | None = None, **properties: str) -> Table:
    """A database table; ``partition`` is (column, least, largest, parts).  Filters, projections and limits go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return Table(reader.load(), tuple(key), table)


def in_memory(spark: SparkSession, rows: list, schema: Any, key: tuple[str, ...] = (), name: str = "") -> Table:
    return Table(spark.createDataFrame(rows, schema), tuple(key), name)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    if format not in FORMATS:
        raise ValueError(f"no writer for {format!r}")
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


class _Published:
    """A folder in which the small file CURRENT-n of the highest n names what is current.

    A pointer is written under another name and renamed to a new one, so that
    at every moment the folder has either the old state or the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _pointers(self) -> list[str]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]
        return sorted(n for n in names if n.startswith("CURRENT-"))

    def _pointer(self) -> dict:
        names = self._pointers()
        if not names:
            return {"version": 0, "batch": -1, "schema": None}
        stream = self._fs.open(self._path(f"{self.path}/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, now: dict) -> None:
        names = self._pointers()
        n = int(names[-1].removeprefix("CURRENT-")) + 1 if names else 1
        draft, at = self._path(f"{self.path}/_next-{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT-{n:012d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._fs.rename(draft, at):
            raise OSError(f"another writer has published {at}")
        for old in names[:-1]:
            self._fs.delete(self._path(f"{self.path}/{old}"), False)

    def _forget(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _read(self, now: dict, *paths: str) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    @property
    def batch(self) -> int:
        """The last batch that is in the current version."""
        return self._pointer()["batch"]


class VersionedTable(_Published):
    """A table kept as immutable versions, each written whole."""

    def read(self) -> DataFrame | None:
        now = self._pointer()
        return self._read(now, f"{self.path}/v{now['version']:08d}") if now["version"] else None

    def publish(self, df: DataFrame, batch: int | None = None, keep: int = 2) -> DataFrame:
        """Writes a version and makes it current; versions before the last ``keep`` go."""
        now = self._pointer()
        version = now["version"] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version:08d}")
        self._point({"version": version, "batch": now["batch"] if batch is None else batch, "schema": df.schema.jsonValue()})
        if version - keep > 0:
            self._forget(f"{self.path}/v{version - keep:08d}")
        return self.read()


class KeyedStore(_Published):
    """A keyed table in hashed buckets, of which a change rewrites only those that hold its keys.

    The number of buckets is fixed when the table is made, and sized so that one is a task's worth of rows; the file that names
    the current files has one entry a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 16):
        super().__init__(spark, path)
        self.key, self.buckets = list(key), self._pointer().get("buckets", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that hold the keys; a number for each bucket at most."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        now = self._pointer()
        if not now["version"]:
            return None
        files = now["files"]
        return self._read(now, *[files[k] for k in (files if buckets is None else map(str, buckets)) if k in files])

    def publish(self, df: DataFrame, batch: int | None = None) -> None:
        """Replaces the whole table."""
        self.replace(df, list(range(self.buckets)), batch)

    def replace(self, df: DataFrame, buckets: list[int], batch: int | None = None, keep: int = 2) -> None:
        """Replaces the rows of some buckets by ``df``, which has rows of no others; what they replace goes ``keep`` versions later."""
        now = self._pointer()
        version, files, old = now["version"] + 1, dict(now.get("files", {})), now.get("old", [])
        root = f"{self.path}/v{version:08d}"
        if buckets:
            df.withColumn("__bucket", self.bucket()).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(root)
            there = {s.getPath().getName(): str(s.getPath()) for s in self._fs.listStatus(self._path(root))}
            for k in map(str, buckets):
                if k in files:
                    old = [*old, [version, files.pop(k)]]
                if (name := f"__bucket={k}") in there:
                    files[k] = f"{root}/{name}"
        for v, path in old:
            if v <= version - keep:
                self._forget(path)
        schema = now["schema"] or df.schema.jsonValue()
        self._point({"version": version, "batch": now["batch"] if batch is None else batch, "schema": schema, "files": files, "buckets": self.buckets, "old": [x for x in old if x[0] > version - keep]})


def upsert(table: VersionedTable, rows: DataFrame, key: list[str], delete: Column | None = None) -> DataFrame:
    """Merges rows by key into a versioned table; rows for which ``delete`` holds take their key away.  A key several times in ``rows`` keeps one of them."""
    rows = rows.dropDuplicates(key)
    old = table.read()
    new = rows if delete is None else rows.where(~F.coalesce(delete, F.lit(False)))
    if old is not None:
        new = old.join(rows.select(*key), key, "left_anti").unionByName(new.select(*old.columns))
    return table.publish(new)


class TxLog:
    """An append-only log of changes in Parquet, by sequence number, with a versioned snapshot to fall back on."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.state = VersionedTable(spark, f"{self.path}/state")
        self.marks = VersionedTable(spark, f"{self.path}/marks")

    def _mark(self) -> tuple[int, int]:
        """(last sequence number, the one up to which the log is pruned)"""
        marks = self.marks.read()
        return (0, 0) if marks is None else tuple(marks.first())

    def append(self, changes: DataFrame) -> int:
        """Appends rows (key, row columns, type) as one transaction and gives its sequence number."""
        from tidewright.streaming.cdc import apply_changes

        seq, pruned = self._mark()
        seq += 1
        changes.withColumn("seq", F.lit(seq)).write.mode("overwrite").parquet(f"{self.path}/log/tx={seq}")
        columns = [c for c in changes.columns if c != "type"]
        old = self.state.read()
        old = old if old is not None else self.spark.createDataFrame([], changes.select(*columns).schema)
        self.state.publish(apply_changes(old, changes.withColumn("seq", F.lit(seq)), self.key))
        self.marks.publish(self.spark.createDataFrame([(seq, pruned)], "seq int, pruned int"))
        return seq

    def prune(self, before: int) -> None:
        """Forgets transactions up to a number."""
        seq, pruned = self._mark()
        for n in range(pruned + 1, min(before, seq) + 1):
            self.state._fs.delete(self.state._path(f"{self.path}/log/tx={n}"), True)
        self.marks.publish(self.spark.createDataFrame([(seq, max(pruned, min(before, seq)))], "seq int, pruned int"))

    def pull_since(self, seq: int, most: int | None = None) -> tuple[str, DataFrame]:
        """("changes", what happened after ``seq``, deletes included), or ("reload", the whole state) if the log has been pruned past it or has more than ``most`` changes."""
        last, pruned = self._mark()
        if seq < pruned:
            return "reload", self.state.read()
        paths = [f"{self.path}/log/tx={n}" for n in range(seq + 1, last + 1)]
        if not paths:
            return "changes", self.state.read().limit(0).withColumn("type", F.lit("")).withColumn("seq", F.lit(0))
        changes = self.spark.read.parquet(*paths)
        if most is not None and changes.limit(most + 1).count() > most:
            return "reload", self.state.read()
        return "changes", changes


class SubsetSource:
    """Loads only what queries ask for from a table, and nothing twice.

    ``load`` gives rows from what has been loaded; filters, orders and limits
    of a load go to the source's reader.
    """

    def __init__(self, table: Table, sink: VersionedTable, alias: str = "t"):
        self.table, self.sink, self.alias, self.loads, self.requests = table, sink, alias, Loads(), 0
        self.windows: list[tuple[Subset, VersionedTable]] = []

    def _select(self, df: DataFrame, load: Subset) -> DataFrame:
        from tidewright.plans.planner import _directed

        frame = _struct(df, self.alias)
        c = Compiler(frame, (self.alias,))
        if load.where is not None:
            named = replace(load.where, lambda e: Ref(self.alias, e.path) if isinstance(e, Ref) else None)
            frame = frame.filter(c.boolean(named))
        if load.order_by:
            frame = frame.orderBy(*[_directed(c(replace(o.expr, lambda e: Ref(self.alias, e.path) if isinstance(e, Ref) else None)), o) for o in load.order_by], *[F.col(f"{self.alias}.{k}") for k in self.table.key])
        frame = frame.offset(load.offset) if load.offset else frame
        frame = frame.limit(load.limit) if load.limit is not None else frame
        return frame.select(*[F.col(f"{self.alias}.{n}") for n in df.columns])

    def load(self, load: Subset) -> DataFrame:
        """The rows that ``load`` asks for; a window of rows is kept by itself, as its place is known only where all before it is."""
        if load.windowed and not self.loads.unlimited(load):
            for known, rows in self.windows:
                if is_subset(load, known):
                    return self._select(rows.read(), Subset(None, load.order_by, load.limit, (load.offset or 0) - (known.offset or 0)))
            self.requests += 1
            rows = VersionedTable(self.table.df.sparkSession, f"{self.sink.path}-window-{len(self.windows)}")
            rows.publish(self._select(self.table.df, load))
            upsert(self.sink, rows.read(), list(self.table.key))
            self.windows.append((load, rows))
            return self._select(rows.read(), Subset(None, load.order_by, load.limit, 0))
        rest = self.loads.missing(load)
        if rest is not None:
            self.requests += 1
            upsert(self.sink, self._select(self.table.df, rest), list(self.table.key))
            self.loads.add(load)
        return self._select(self.sink.read(), load)
