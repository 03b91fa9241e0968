"""Sort keys, keyset cursors and pages."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import OrderError
from tidewright.functions.columns import Compiler
from tidewright.plans.ir import Expr, Order


def sort_column(e: Expr, compile_: Compiler, order: Order, default: str = "lexical") -> Column:
    """The order's sort key; strings by code point, or by a Unicode collation where the order or its source says locale."""
    c = compile_(e)
    if isinstance(compile_.kind(e), T.StringType) and (order.string_sort or default) == "locale":
        return F.collate(c, f"{order.locale}" if order.locale else "UNICODE")
    return c


def _after(c: Column, value: Any, descending: bool, nulls: str) -> Column:
    """What comes strictly after ``value`` in one column's order."""
    if value is None:
        return c.isNotNull() if nulls == "first" else F.lit(False)
    beyond = c < F.lit(value) if descending else c > F.lit(value)
    return beyond if nulls == "first" else beyond | c.isNull()


def keyset_after(order: list[tuple[str, bool, str]], values: list[Any]) -> Column:
    """The rows after a cursor: ``order`` is (column, descending, nulls) and ``values`` the cursor row's values.

    Columns together must identify a row, or ties of the cursor row are passed
    over.  Nulls in the cursor and in the rows keep their place in the order.
    """
    if not order or len(order) != len(values):
        raise OrderError("a cursor has one value for each order column")
    options = []
    for k, (name, descending, nulls) in enumerate(order):
        same = [F.col(n).eqNullSafe(F.lit(v)) for (n, _, _), v in zip(order[:k], values[:k], strict=True)]
        options.append(reduce(Column.__and__, [*same, _after(F.col(name), values[k], descending, nulls)]))
    return reduce(Column.__or__, options)


def sort_columns(order: list[tuple[str, bool, str]]) -> list[Column]:
    pick = {(False, "first"): "asc_nulls_first", (False, "last"): "asc_nulls_last", (True, "first"): "desc_nulls_first", (True, "last"): "desc_nulls_last"}
    return [getattr(F.col(n), pick[d, nulls])() for n, d, nulls in order]


class Pages:
    """Pages of a frame by keyset: each page asks for one row more than it shows, to know whether another follows."""

    def __init__(self, df: DataFrame, order: list[tuple[str, bool, str]], page_size: int = 20):
        if page_size < 1:
            raise OrderError("a page has a row at least")
        self.df, self.order, self.page_size = df, order, page_size
        self.reset()

    def reset(self) -> None:
        self.cursor: list[Any] | None = None
        self.has_next = True

    def fetch_next(self) -> list:
        """The next page's rows; at most ``page_size`` of them reach the driver."""
        if not self.has_next:
            return []
        df = self.df if self.cursor is None else self.df.where(keyset_after(self.order, self.cursor))
        rows = df.orderBy(*sort_columns(self.order)).limit(self.page_size + 1).collect()
        self.has_next = len(rows) > self.page_size
        rows = rows[: self.page_size]
        if rows:
            self.cursor = [rows[-1][n] for n, _, _ in self.order]
        return rows
