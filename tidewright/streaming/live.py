"""Incrementally maintained queries.

A live query holds its tables and its result in hashed buckets of their keys.
A batch of changes rewrites only the buckets that its keys fall in.  Where the
query says which of its result's keys a table's rows affect, only those keys
are computed again, by the same planner, and only their buckets of the result
are rewritten; otherwise the whole query is.
One version of the result is published for each batch, so readers see all of a
batch or nothing of it, and a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.builder import Query
from tidewright.plans.ir import Table
from tidewright.sources import KeyedStore, VersionedTable
from tidewright.streaming.cdc import apply_changes, diff


class LiveQuery:
    """A query kept up to date.

    ``build`` gets the tables by name and gives a Query; ``key`` are result
    columns that identify a row; ``affects[table][result column]`` is an SQL
    expression over that table's rows, for every column of the key.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[dict[str, Table]], Query | DataFrame], tables: dict[str, Table], key: list[str], affects: dict[str, dict[str, str]] | None = None, buckets: int = 16):
        self.spark, self.build, self.key, self.affects = spark, build, key, affects or {}
        self.keys = {n: list(t.key) for n, t in tables.items()}
        self.bases = {n: KeyedStore(spark, f"{path}/base-{n}", list(t.key), buckets) for n, t in tables.items()}
        self.result = KeyedStore(spark, f"{path}/result", key, buckets)
        self.listeners: list[Callable[[DataFrame, int], None]] = []
        for n, t in tables.items():
            if not self.bases[n].version:
                self.bases[n].publish(t.df)
        if not self.result.version:
            self.result.publish(self._compute({n: b.read() for n, b in self.bases.items()}))

    def _compute(self, frames: dict[str, DataFrame]) -> DataFrame:
        out = self.build({n: Table(df, tuple(self.keys[n]), n) for n, df in frames.items()})
        return out.to_df() if isinstance(out, Query) else out

    def on_change(self, f: Callable[[DataFrame, int], None]) -> None:
        """``f`` gets each batch's changes of the result (key, event, value, previous) and the batch's number."""
        self.listeners.append(f)

    def df(self) -> DataFrame:
        return self.result.read()

    def apply(self, name: str, changes: DataFrame, batch: int | None = None, mode: str = "full", seq: tuple[str, ...] = ("seq",)) -> None:
        """Applies a batch of changes (the table's columns, seq and type) to a table and publishes the result."""
        if batch is not None and batch <= self.result.batch:
            return
        base, key = self.bases[name], self.keys[name]
        touched = changes.select(*key).distinct()
        hit = base.touched(touched)
        old = base.read(hit)
        again = batch is not None and batch <= base.batch  # it failed between base and result, so the old rows are gone
        if not again:
            base.replace(apply_changes(old, changes, key, list(seq), mode=mode), hit, batch)
        frames = {n: b.read() for n, b in self.bases.items()}
        made = None if again else self.affects.get(name)
        if made is None:
            before, now = self.result.read(), self._compute(frames)
            self.result.publish(now, batch)
            after = self.result.read()
        else:
            rows = old.join(touched, key, "left_semi").unionByName(base.read(hit).join(touched, key, "left_semi"))
            keys = rows.select(*[F.expr(made[k]).alias(f"__{k}") for k in self.key]).distinct()
            same: Callable[[dict[str, str]], Column] = lambda named: reduce(Column.__and__, [F.expr(named[k]).eqNullSafe(F.col(f"__{k}")) for k in self.key])
            own = {k: f"`{k}`" for k in self.key}
            shown = self.result.touched(keys.toDF(*self.key))
            before = self.result.read(shown)
            frames[name] = frames[name].join(keys, same(made), "left_semi")
            new = self._compute(frames).join(keys, same(own), "left_semi")
            self.result.replace(before.join(keys, same(own), "left_anti").unionByName(new.select(*before.columns)), shown, batch)
            after = self.result.read(shown)
        for f in self.listeners:
            f(diff(before, after, self.key), batch)

    def stream(self, name: str, changes: DataFrame, checkpoint: str, mode: str = "full", seq: tuple[str, ...] = ("seq",)):
        """Runs a streaming frame of changes through apply(); start() the returned writer."""
        return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(name, df, n, mode, seq))


class LiveSet:
    """Live queries that read each other's results, brought up to date parents first, each once a flush."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[tuple[str, ...], Callable[[], None]]] = {}
        self.dirty: set[str] = set()

    def add(self, name: str, refresh: Callable[[], None], reads: tuple[str, ...] = ()) -> None:
        if missing := [r for r in reads if r not in self.nodes]:
            raise ValueError(f"{name} reads {missing[0]}, which isn't there")
        self.nodes[name] = (reads, refresh)

    def touch(self, name: str) -> None:
        self.dirty.add(name)

    def flush(self) -> list[str]:
        """Refreshes what was touched and all that reads it; names in the order of refreshing."""
        done = []
        for name, (reads, refresh) in self.nodes.items():  # parents were added first
            if name in self.dirty or self.dirty & set(reads):
                self.dirty.add(name)
                refresh()
                done.append(name)
        self.dirty.clear()
        return done


class Effect:
    """Calls handlers for rows that enter, change in or leave a query's result; holds no result of its own beyond the last state it saw."""

    def __init__(self, state: VersionedTable, key: list[str], on_enter: Callable | None = None, on_update: Callable | None = None, on_exit: Callable | None = None, on_batch: Callable | None = None, skip_initial: bool = False):
        self.state, self.key, self.skip = state, key, skip_initial
        self.handlers = {"enter": on_enter, "update": on_update, "exit": on_exit}
        self.on_batch = on_batch

    def run(self, now: DataFrame, batch: int | None = None) -> None:
        before = self.state.read()
        first = before is None
        before = now.limit(0) if first else before
        now = self.state.publish(now, batch)
        if first and self.skip:
            return
        events = diff(before, now, self.key)
        for kind, f in self.handlers.items():
            if f:
                f(events.where(F.col("event") == kind))
        if self.on_batch:
            self.on_batch(events)
