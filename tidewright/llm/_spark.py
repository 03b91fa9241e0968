"""What the operators share on the Spark side: the shared folder, tables written to it, and components of a graph."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a batch that a Python worker gets, so that its memory doesn't depend on how long texts are.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where all run on one machine, one of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation and lineage stays short.

    They go when the application ends; results are read from them until then.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}", 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def write(self, df: DataFrame, label: str) -> DataFrame:
        if not self.n:
            files, root = self._at(self.root)
            files.mkdirs(root)
            files.deleteOnExit(root)
        df.write.parquet(path := self.path(label))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing still to run reads."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                files, where = self._at(path)
                files.delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to Python workers that start outside its folder, once an application, and bounds the batches that they get."""
    bytes_key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(bytes_key)).rstrip("b") != str(BATCH_BYTES):
        spark.conf.set(bytes_key, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="tidewright-")) / "tidewright.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function of a partition's batches."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function of one batch.  The function is called with whole batches in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return map_stream(df, run, schema)


#: Keys that hold more than one row in so many are hot; there are at most as many such keys.
HOT_SHARE = 10_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins ``left`` to ``right``, which has one row a key at most; an inner or left join.

    Keys that hold more than one in HOT_SHARE of the rows of ``left`` are joined by a broadcast
    of their at most HOT_SHARE rows of ``right``, so that no task gets a hot key's rows.
    """
    total = left.count()
    hot = left.groupBy(*on).agg(F.count("*").alias("rows")).where(F.col("rows") * HOT_SHARE > F.lit(total)).where("rows > 1").select(*on)
    mine = right.join(F.broadcast(hot), on, "left_semi")
    return left.join(F.broadcast(mine), on).unionByName(left.join(F.broadcast(mine.select(*on)), on, "left_anti").join(right, on, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns a and b.  Returns (node, component), where
    component is the smallest node reachable, for every node that has an edge
    to another.  Rounds grow with the logarithm of the graph; each is a written
    table, and only two numbers of it reach the driver.
    """
    now, mark = scratch.write(_edges(edges), "edges"), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _edges(large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")))
        after = scratch.write(small, "small-star")
        scratch.drop(now, large)
        was, now = mark, after
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct().toDF("node", "component"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
