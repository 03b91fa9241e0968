"""Operators that are kept up to date by changes of their inputs.

Inputs and outputs are bags with signed multiplicities (``operators.bag``): a
deletion is a row of multiplicity -1, an update one of -1 and one of 1.  State
lies in hashed buckets of a key, and a batch reads and rewrites the buckets that
its keys fall in and no others.  ``apply`` gives the change of the result as a
bag too, so that one operator's output is the next one's input; it reads the
state before and after the batch, so use or write it before the next batch but
one.

A batch with a number that is already in the result changes nothing; one that
failed between the state and the result is taken up again from the state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import bag
from tidewright.operators.bag import M
from tidewright.sources import KeyedStore, VersionedTable


def _same(a: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join that takes nulls for equal, as state has rows with null keys too."""
    keys = keys.select(*[F.col(k).alias(f"__{k}") for k in on])
    return a.join(keys, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on]), how)


class Keyed:
    """The result of a function of bags of which each key's rows depend on that key's rows of the inputs only.

    ``f`` gets a bag for each input, by name, and gives a bag that has the
    columns of ``key`` too.  It runs on the rows of the batch's keys alone.
    ``inputs`` are the bags to start from, which may be empty; rows with a null
    in the key are kept as any other.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], f: Callable[..., DataFrame], inputs: dict[str, DataFrame], buckets: int = 16):
        self.spark, self.key, self.f = spark, list(key), f
        self.inputs = {n: KeyedStore(spark, f"{path}/in-{n}", self.key, buckets) for n in inputs}
        self.result = KeyedStore(spark, f"{path}/result", self.key, buckets)
        for n, df in inputs.items():
            if not self.inputs[n].version:
                self.inputs[n].publish(bag.consolidate(df))
        if not self.result.version:
            self.result.publish(self._made(None))

    def _made(self, hit: list[int] | None, keys: DataFrame | None = None) -> DataFrame:
        parts = {n: s.read(hit) for n, s in self.inputs.items()}
        return self.f(**{n: df if keys is None else _same(df, keys, self.key, "left_semi") for n, df in parts.items()})

    def df(self) -> DataFrame:
        """The result as a bag."""
        return self.result.read()

    def apply(self, batch: int | None = None, **deltas: DataFrame) -> DataFrame:
        """Takes in a batch of changes of some inputs and gives the change of the result."""
        none = self.result.read([])
        if batch is not None and batch <= self.result.batch:
            return none
        if unknown := deltas.keys() - self.inputs.keys():
            raise ValueError(f"there is no input {sorted(unknown)[0]}")
        keys = reduce(DataFrame.union, [d.select(*self.key) for d in deltas.values()]).distinct()
        hit = self.result.touched(keys)
        for n, delta in deltas.items():
            store = self.inputs[n]
            if batch is None or store.batch < batch:
                old = store.read(hit)
                store.replace(bag.consolidate(bag.concat(old, delta.select(*old.columns))), hit, batch)
        before = self.result.read(hit)
        new = self._made(hit, keys).select(*before.columns)
        self.result.replace(_same(before, keys, self.key, "left_anti").unionByName(new), hit, batch)
        return bag.difference(_same(self.result.read(hit), keys, self.key, "left_semi"), _same(before, keys, self.key, "left_semi"))


def join(spark: SparkSession, path: str, left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", buckets: int = 16) -> Keyed:
    """A maintained join of the inputs ``left`` and ``right``; how: inner, left, right, full or anti."""
    return Keyed(spark, path, on, lambda left, right: bag.join(left, right, on, how), {"left": left, "right": right}, buckets)


def distinct(spark: SparkSession, path: str, rows: DataFrame, by: list[str], order: list[str] | None = None, buckets: int = 16) -> Keyed:
    """A maintained distinct of the input ``rows``."""
    return Keyed(spark, path, by, lambda rows: bag.distinct(rows, by, order), {"rows": rows}, buckets)


def group_by(spark: SparkSession, path: str, rows: DataFrame, by: list[str], buckets: int = 16, **aggs: tuple[str, str]) -> Keyed:
    """Maintained aggregates of the input ``rows``, of any kind that bags have; a group that a batch touches is computed again."""
    return Keyed(spark, path, by, lambda rows: bag.lift(bag.group_by(rows, by, **aggs)), {"rows": rows}, buckets)


def grouped_top_k(spark: SparkSession, path: str, rows: DataFrame, by: list[str], order: list[Column], limit: int, offset: int = 0, buckets: int = 16) -> Keyed:
    """A maintained top-k of each ``by`` of the input ``rows``; the order must end in a key."""
    top = lambda rows: bag.top_k(bag.expand(rows), order, limit, offset, by)
    return Keyed(spark, path, by, lambda rows: bag.lift(top(rows)), {"rows": rows}, buckets)


class Totals:
    """Counts, sums and averages by delta: the state is one row a group, and no input row is read a second time.

    aggs: name=(function, column), functions count, sum and avg; nulls count as
    0 in sums and averages and not at all in counts.  A group whose
    multiplicities sum to 0 goes.  Sums of doubles carry the rounding of what
    was added and taken away; decimals and integers are exact.
    """

    def __init__(self, spark: SparkSession, path: str, rows: DataFrame, by: list[str], buckets: int = 16, **aggs: tuple[str, str]):
        if wrong := [how for how, _ in aggs.values() if how not in ("count", "sum", "avg")]:
            raise ValueError(f"{wrong[0]} can't be kept by delta; use group_by")
        self.by, self.aggs = list(by), aggs
        self.state = KeyedStore(spark, f"{path}/totals", self.by, buckets)
        if not self.state.version:
            self.state.publish(self._live(self._partial(rows)))

    def _partial(self, rows: DataFrame) -> DataFrame:
        weight = F.col(M)
        made = [F.sum(F.when(F.col(c).isNotNull(), weight).otherwise(0) if how == "count" else F.coalesce(F.col(c), F.lit(0)) * weight).alias(n) for n, (how, c) in self.aggs.items()]
        return rows.groupBy(*self.by).agg(*made, F.sum(weight).alias(M))

    @staticmethod
    def _live(state: DataFrame) -> DataFrame:
        return state.where(F.col(M) != 0)

    def _shown(self, state: DataFrame) -> DataFrame:
        shown = [(F.col(n) / F.col(M) if how == "avg" else F.col(n)).alias(n) for n, (how, _) in self.aggs.items()]
        return bag.lift(state.where(F.col(M) > 0).select(*self.by, *shown))

    def df(self) -> DataFrame:
        """The groups as a bag."""
        return self._shown(self.state.read())

    def apply(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Adds a batch of changes and gives the change of the groups."""
        if batch is not None and batch <= self.state.batch:
            return self._shown(self.state.read([]))
        delta = self._partial(rows)
        hit = self.state.touched(rows)
        before = self.state.read(hit)
        delta = delta.select(*[F.col(c).cast(before.schema[c].dataType) for c in before.columns])
        summed = before.unionByName(delta).groupBy(*self.by).agg(*[F.sum(c).cast(before.schema[c].dataType).alias(c) for c in before.columns if c not in self.by])
        self.state.replace(self._live(summed).select(*before.columns), hit, batch)
        return bag.difference(self._shown(self.state.read(hit)), self._shown(before))


class TopK:
    """A maintained window offset+1 to offset+limit over all rows, in an order that must end in a key.

    Rows lie in buckets of ``key``; of each bucket only its first offset+limit
    rows can be in the window, and they are kept apart, so that a batch sorts
    its own buckets and then those few rows.  The result has ``index``, a number
    that grows along the order and that a row keeps as long as it stays: what
    ``apply`` gives is only the rows that moved in or out.  Where numbers between
    two neighbours run out, all rows get new ones and are in the change.
    """

    #: The smallest step between neighbours' numbers, below which all are dealt anew.
    STEP = 1e-6

    def __init__(self, spark: SparkSession, path: str, rows: DataFrame, key: list[str], order: list[Column], limit: int, offset: int = 0, index: str = "index", buckets: int = 16):
        self.key, self.order, self.limit, self.offset, self.index = list(key), order, limit, offset, index
        self.rows = KeyedStore(spark, f"{path}/rows", self.key, buckets)
        self.heads = KeyedStore(spark, f"{path}/heads", self.key, buckets)
        self.window = VersionedTable(spark, f"{path}/window")
        if not self.rows.version:
            self.rows.publish(bag.consolidate(rows))
        if not self.heads.version:
            self.heads.publish(self._head(None))
        if not self.window.version:
            self.window.publish(self._numbered(self._top(), None))

    def _head(self, hit: list[int] | None) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("__b").orderBy(*self.order))
        rows = bag.expand(self.rows.read(hit)).withColumn("__b", self.rows.bucket())
        return rows.withColumn("__n", place).where(F.col("__n") <= self.offset + self.limit).drop("__b", "__n")

    def _top(self) -> DataFrame:
        return bag.top_k(self.heads.read(), self.order, self.limit, self.offset, index="__n")

    def _numbered(self, top: DataFrame, before: DataFrame | None) -> DataFrame:
        """The rows with their numbers; rows that were there keep theirs, others share the space between the neighbours that did."""
        names = [c for c in top.columns if c != "__n"]
        if before is None:
            return top.select(*names, F.col("__n").cast("double").alias(self.index))
        # The window has limit rows at most, so one task may order them.
        copies = Window.partitionBy(*names).orderBy
        top = top.withColumn("__c", F.row_number().over(copies("__n")))
        old = before.withColumn("__c", F.row_number().over(copies(self.index)))
        same = reduce(Column.__and__, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in [*names, "__c"]])
        both = top.alias("a").join(old.alias("b"), same, "left").select(*[F.col(f"a.`{c}`").alias(c) for c in [*names, "__n"]], F.col(f"b.`{self.index}`").alias("__i"))
        whole = Window.orderBy("__n")
        above, below = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(0, Window.unboundedFollowing)
        kept = F.when(F.col("__i").isNotNull(), F.struct("__n", "__i"))
        both = both.withColumn("__low", F.last(kept, True).over(above)).withColumn("__high", F.first(kept, True).over(below))
        low, high, n = F.col("__low"), F.col("__high"), F.col("__n")
        between = low["__i"] + (high["__i"] - low["__i"]) * (n - low["__n"]) / (high["__n"] - low["__n"])
        number = F.when(F.col("__i").isNotNull(), F.col("__i")).when(low.isNull() & high.isNull(), n.cast("double")).when(low.isNull(), high["__i"] - (high["__n"] - n)).when(high.isNull(), low["__i"] + (n - low["__n"])).otherwise(between)
        both = both.withColumn(self.index, number)
        both = both.withColumn("__step", F.col(self.index) - F.lag(self.index).over(whole))
        tight = F.min("__step").over(Window.partitionBy(F.lit(1))) < self.STEP
        return both.select(*names, F.when(tight, F.col("__n").cast("double")).otherwise(F.col(self.index)).alias(self.index))

    def df(self) -> DataFrame:
        """The window's rows with their numbers; order by ``index``."""
        return self.window.read()

    def _publish(self, batch: int | None) -> DataFrame:
        before = self.window.read()
        after = self.window.publish(self._numbered(self._top(), before), batch)
        return bag.difference(bag.lift(after), bag.lift(before))

    def apply(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Takes in a batch of changes and gives the rows that moved in (multiplicity 1) or out (-1)."""
        if batch is not None and batch <= self.window.batch:
            return bag.lift(self.window.read().limit(0))
        hit = self.rows.touched(rows)
        if batch is None or self.rows.batch < batch:
            old = self.rows.read(hit)
            self.rows.replace(bag.consolidate(bag.concat(old, rows.select(*old.columns))), hit, batch)
        self.heads.replace(self._head(hit), hit, batch)
        return self._publish(batch)

    def move(self, offset: int, limit: int | None = None) -> DataFrame:
        """Moves the window and gives the rows that moved in or out; rows are sorted again only if it reaches further than before."""
        deeper = offset + (self.limit if limit is None else limit) > self.offset + self.limit
        self.offset, self.limit = offset, self.limit if limit is None else limit
        if deeper:
            self.heads.publish(self._head(None))
        return self._publish(None)
