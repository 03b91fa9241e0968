"""Change messages: applying them, comparing states, filtered feeds, transactions and overlays.

A change feed has the columns seq, key columns, type (insert, update, delete),
value (a struct of the row) and previous (a struct or null).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.bag import M


def latest(changes: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last change of each key.  Combines before the shuffle: a key of many changes is no burden on one task."""
    rest = [c for c in changes.columns if c not in key]
    best = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("__x"))
    return best.select(*key, *[F.col("__x")[c].alias(c) for c in rest]).select(*changes.columns)


def apply_changes(base: DataFrame, changes: DataFrame, key: list[str], seq: list[str] = ("seq",), kind: str = "type", mode: str = "full") -> DataFrame:
    """The base with a batch of changes applied, each key's in the order of ``seq``.

    ``changes`` has the base's columns (those of the row) beside ``seq`` and
    ``kind``.  With mode ``partial`` a null in an update leaves the column as it
    was, also over several updates of one batch; with ``full`` the last row
    replaces the old one.  Deletes of unknown keys do nothing, updates of
    unknown keys insert.
    """
    columns = [c for c in base.columns if c not in key]
    order = F.struct(*seq)
    if mode == "full":
        last = latest(changes, key, list(seq))
        kept = base.join(last.select(*key), key, "left_anti")
        return kept.unionByName(last.where(F.col(kind) != "delete").select(*base.columns))
    # A column's value is its last non-null one after the last delete.
    gone = changes.groupBy(*key).agg(F.max(F.when(F.col(kind) == "delete", order)).alias("__gone"), F.max(order).alias("__last"))
    alive = changes.join(gone, key).where(F.col("__gone").isNull() | (order > F.col("__gone")))
    merged = alive.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"__{c}") for c in columns])
    state = base.join(gone, key, "full_outer").join(merged, key, "left")
    erased = F.col("__gone").isNotNull()
    state = state.where(~erased | (F.col("__last") > F.col("__gone")))
    return state.select(*key, *[F.coalesce(F.col(f"__{c}"), F.when(~erased, F.col(c))).alias(c) for c in columns]).select(*base.columns)


def to_deltas(changes: DataFrame) -> DataFrame:
    """Changes as a bag: an insert counts 1, a delete -1, an update -1 for the previous row and 1 for the new one."""
    minus, plus = F.lit(-1).cast("long"), F.lit(1).cast("long")
    pair = lambda m, v: F.struct(m.alias(M), v.alias("v"))
    made = F.when(F.col("type") == "insert", F.array(pair(plus, F.col("value")))).when(F.col("type") == "delete", F.array(pair(minus, F.coalesce("previous", "value")))).otherwise(F.array(pair(minus, F.col("previous")), pair(plus, F.col("value"))))
    return changes.select(F.explode(made).alias("x")).select("x.v.*", f"x.{M}")


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What happened between two states: key, event (enter, update, exit), value, previous; unchanged rows aren't there."""
    columns = [c for c in after.columns if c not in key]
    pack = lambda df, name: df.select(*key, F.struct(*[F.col(c) for c in columns] or [F.lit(True).alias("there")]).alias(name))
    both = pack(before, "previous").join(pack(after, "value"), key, "full_outer")
    event = F.when(F.col("previous").isNull(), "enter").when(F.col("value").isNull(), "exit").when(~F.col("previous").eqNullSafe(F.col("value")), "update")
    return both.withColumn("event", event).where("event is not null").select(*key, "event", "value", "previous")


def moves(before: DataFrame, after: DataFrame, key: list[str], rank: str) -> DataFrame:
    """Rows whose place changed and whose value didn't: key, from, to."""
    old = before.select(*key, F.col(rank).alias("from"), F.struct(*[c for c in before.columns if c != rank]).alias("__a"))
    new = after.select(*key, F.col(rank).alias("to"), F.struct(*[c for c in before.columns if c != rank]).alias("__b"))
    return old.join(new, key).where("__a <=> __b and `from` <> `to`").select(*key, "from", "to")


def filter_feed(changes: DataFrame, matches: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """A feed of the rows that match: updates that come to match are inserts, those that cease to are deletes with the previous row.

    ``matches`` gets a function from field names to columns, for the new row
    and the previous one in turn; unknown counts as no match.
    """
    new = F.coalesce(matches(lambda n: F.col(f"value.{n}")), F.lit(False))
    old = F.coalesce(matches(lambda n: F.col(f"previous.{n}")), F.lit(False))
    gone = F.coalesce(matches(lambda n: F.coalesce(F.col(f"previous.{n}"), F.col(f"value.{n}"))), F.lit(False))
    kind = (
        F.when((F.col("type") == "insert") & new, "insert")
        .when((F.col("type") == "delete") & gone, "delete")
        .when(F.col("type") == "update", F.when(new & old, "update").when(new, "insert").when(old, "delete"))
    )
    out = changes.withColumn("__t", kind).where("__t is not null")
    left = (F.col("type") == "update") & (F.col("__t") == "delete")
    return out.withColumn("value", F.when(left, F.col("previous")).otherwise(F.col("value"))).withColumn("previous", F.when(F.col("__t") == "update", F.col("previous"))).withColumn("type", F.col("__t")).drop("__t")


def guard_duplicates(changes: DataFrame, visible: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """Changes fit for a subscriber that sees ``visible``: inserts of known keys go, updates of unknown ones insert, deletes of unknown ones go.

    A key is known if the change before, by ``seq``, inserted or updated it, or
    else if it is visible.  Without ``seq`` a key has one change at most.
    """
    seen = visible.select(*key).distinct().withColumn("__seen", F.lit(True))
    out = changes.join(seen, key, "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    if seq is not None:
        before = F.lag("type").over(Window.partitionBy(*key).orderBy(seq))
        out = out.withColumn("__seen", F.coalesce(before != "delete", F.col("__seen")))
    out = out.where(~((F.col("type") == "insert") & F.col("__seen")) & ~((F.col("type") == "delete") & ~F.col("__seen")))
    return out.withColumn("type", F.when((F.col("type") == "update") & ~F.col("__seen"), "insert").otherwise(F.col("type"))).drop("__seen").select(*changes.columns)


def net(deltas: DataFrame, key: list[str], seq: str) -> DataFrame:
    """A batch's deltas (rows with _mult and seq) as one change a key: inserts only insert, both update, deletes only delete."""
    columns = [c for c in deltas.columns if c not in (*key, M, seq)]
    row = F.struct(*columns)
    made = deltas.groupBy(*key).agg(
        F.sum(F.when(F.col(M) > 0, F.col(M)).otherwise(0)).alias("__in"), F.sum(F.when(F.col(M) < 0, -F.col(M)).otherwise(0)).alias("__out"),
        F.max_by(F.when(F.col(M) > 0, row), F.when(F.col(M) > 0, F.col(seq))).alias("__new"), F.max_by(F.when(F.col(M) < 0, row), F.when(F.col(M) < 0, F.col(seq))).alias("__old"),
    )
    kind = F.when((F.col("__in") > 0) & (F.col("__out") > 0), "update").when(F.col("__in") > 0, "insert").otherwise("delete")
    return made.select(*key, kind.alias("type"), F.coalesce("__new", "__old").alias("value"))


def snapshot(df: DataFrame, key: list[str], where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """The state as a feed of inserts."""
    df = df.filter(where) if where is not None else df
    df = df.orderBy(*order) if order else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*key, F.lit("insert").alias("type"), F.struct(*df.columns).alias("value"))


# transactions


@dataclass
class Mutation:
    type: str
    key: tuple
    changes: dict[str, Any]


@dataclass
class Transaction:
    """Mutations of one table that show at once and hold once they are persisted.

    Mutations of one key merge: changes to an inserted row are part of the
    insert, a deleted insert is nothing, a deleted update is a delete, updates
    add up.
    """

    state: str = "pending"
    mutations: dict[tuple, Mutation] = field(default_factory=dict)

    def _put(self, type_: str, key: Any, changes: dict[str, Any]) -> None:
        if self.state != "pending":
            raise ValueError(f"the transaction is {self.state}")
        key = key if isinstance(key, tuple) else (key,)
        old = self.mutations.get(key)
        if old is None:
            self.mutations[key] = Mutation(type_, key, dict(changes))
        elif old.type == "delete" and type_ in ("update", "insert"):
            raise ValueError(f"{key} is deleted in this transaction")
        elif type_ == "delete":
            if old.type == "insert":
                del self.mutations[key]
            else:
                self.mutations[key] = Mutation("delete", key, {})
        elif type_ == "insert" and old.type != "insert":
            raise ValueError(f"{key} is changed in this transaction")
        else:
            self.mutations[key] = Mutation(old.type, key, old.changes | changes)

    def insert(self, key: Any, **row: Any) -> None:
        self._put("insert", key, row)

    def update(self, key: Any, **changes: Any) -> None:
        self._put("update", key, changes)

    def delete(self, key: Any) -> None:
        self._put("delete", key, {})

    def touches(self, other: Transaction) -> bool:
        return bool(self.mutations.keys() & other.mutations.keys())


class Overlay:
    """A synced table with transactions laid over it.

    A failed persist rolls its transaction back, with all pending ones that
    touch its keys.  A persisted one stays laid over until a sync brings what it
    did.  The mutations are what one session wrote by hand, so they are few.
    """

    def __init__(self, base: DataFrame, key: list[str]):
        self.base, self.key, self.transactions = base, key, []

    def begin(self) -> Transaction:
        self.transactions.append(Transaction())
        return self.transactions[-1]

    def commit(self, tx: Transaction, persist: Callable[[list[Mutation]], None]) -> None:
        if tx.state != "pending":
            raise ValueError(f"the transaction is {tx.state}")
        tx.state = "persisting"
        try:
            persist(list(tx.mutations.values()))
        except Exception:
            self.rollback(tx)
            raise
        tx.state = "completed"

    def rollback(self, tx: Transaction) -> None:
        tx.state = "failed"
        for other in self.transactions:
            if other.state == "pending" and tx.touches(other):
                self.rollback(other)

    def sync(self, base: DataFrame, confirmed: list[Any] | None = None) -> None:
        """A newer synced state.  Completed transactions stay laid over it until it has what they did, or all their keys are ``confirmed``."""
        self.base = base
        done = [t for t in self.transactions if t.state == "completed" and t.mutations]
        sure = {k if isinstance(k, tuple) else (k,) for k in confirmed or ()}
        keys = sorted({k for t in done for k in t.mutations}, key=repr)
        found: dict[tuple, dict[str, Any]] = {}
        if keys:
            wanted = base.sparkSession.createDataFrame(keys, _schema([base.schema[k] for k in self.key]))
            found = {tuple(r[k] for k in self.key): r.asDict() for r in base.join(F.broadcast(wanted), self.key, "left_semi").collect()}

        def arrived(m: Mutation) -> bool:
            row = found.get(m.key)
            if m.key in sure:
                return True
            return row is None if m.type == "delete" else row is not None and all(row.get(c) == v for c, v in m.changes.items())

        gone = [t for t in done if all(map(arrived, t.mutations.values()))]
        self.transactions = [t for t in self.transactions if t.state in ("pending", "persisting") or t in done and t not in gone]

    def view(self) -> DataFrame:
        """The rows as the session sees them."""
        df, spark = self.base, self.base.sparkSession
        for tx in (t for t in self.transactions if t.state != "failed"):
            kinds = {t: [m for m in tx.mutations.values() if m.type == t] for t in ("insert", "update", "delete")}
            keys = [df.schema[k] for k in self.key]
            if gone := [m.key for m in (*kinds["delete"], *kinds["insert"])]:
                df = df.join(F.broadcast(spark.createDataFrame(gone, _schema(keys))), self.key, "left_anti")
            if kinds["update"]:
                for m in kinds["update"]:
                    mine = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.key, m.key, strict=True)])
                    df = df.withColumns({c: F.when(mine, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in m.changes.items()})
            if kinds["insert"]:
                rows = [tuple((dict(zip(self.key, m.key, strict=True)) | m.changes).get(c) for c in df.columns) for m in kinds["insert"]]
                df = df.unionByName(spark.createDataFrame(rows, _schema(list(df.schema.fields))))
        return df


class Sync:
    """A source's side of a synced table: begin, write, commit, truncate.

    Nothing of a transaction shows before its commit.  ``truncate`` takes away
    all rows that were there before it in its transaction, and what is written
    after it stays.  With an overlay, commits wait while one of its transactions
    is persisting, as the state they bring may lack its rows; those that
    truncate, or are committed ``immediate``, don't wait, and take what waits
    before them along in order.  ``flush`` publishes what waited.
    """

    def __init__(self, table: Any, key: list[str], overlay: Overlay | None = None, mode: str = "full"):
        self.table, self.key, self.overlay, self.mode = table, key, overlay, mode
        self.ready, self.error = False, None
        self._open: list[DataFrame] | None = None
        self._truncates = False
        self._waiting: list[tuple[list[DataFrame], bool]] = []

    def begin(self) -> None:
        if self._open is not None:
            raise ValueError("a sync transaction is open already")
        self._open, self._truncates = [], False

    def write(self, changes: DataFrame) -> None:
        """Changes of the transaction: the row's columns, seq and type."""
        if self._open is None:
            raise ValueError("no sync transaction is open")
        self._open.append(changes)

    def truncate(self) -> None:
        if self._open is None:
            raise ValueError("no sync transaction is open")
        self._open, self._truncates = [], True

    def commit(self, immediate: bool = False) -> bool:
        """Ends the transaction; whether its state shows now."""
        if self._open is None:
            raise ValueError("no sync transaction is open")
        self._waiting.append((self._open, self._truncates))
        now = immediate or self._truncates
        self._open = None
        return self.flush(now)

    def flush(self, immediate: bool = False) -> bool:
        """Publishes what has been committed, unless a persisting transaction holds it back."""
        if not immediate and self.overlay is not None and any(t.state == "persisting" for t in self.overlay.transactions):
            return False
        if not self._waiting:
            return True
        state = self.table.read()
        for writes, truncates in self._waiting:
            state = state.limit(0) if truncates else state
            for changes in writes:
                state = apply_changes(state, changes, self.key, mode=self.mode)
        state = self.table.publish(state)
        self._waiting = []
        if self.overlay is not None:
            self.overlay.sync(state)
        return True

    def mark_ready(self) -> None:
        self.ready, self.error = True, None

    def mark_error(self, error: Exception) -> None:
        self.error = error


def _schema(fields: list) -> Any:
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
