"""The immutable query builder.  Every call gives a new query; mistakes raise at the call that makes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace as changed
from typing import Any

from pyspark.sql import DataFrame

from tidewright.errors import DistinctError, GroupError, JoinError, OrderError, QueryError, SourceError, WhereError
from tidewright.plans.ir import SELECTED, UNION, Case, Expr, Func, Include, Join, Order, Plan, Ref, Rows, Table, aggregates, expr, walk

JOIN_KINDS = ("inner", "left", "right", "full")
RESERVED = (SELECTED,)


def _source(x: Any) -> Any:
    if isinstance(x, DataFrame):
        return Table(x)
    if isinstance(x, Table):
        return x
    if isinstance(x, Query):
        if not x.plan.sources and not x.plan.branches:
            raise SourceError("a nested query needs a FROM of its own")
        return x
    raise SourceError(f"{type(x).__name__} is not a table or a query")


def _alias(name: str) -> str:
    if name in RESERVED or name.startswith(("$", "__")):
        raise SourceError(f"{name!r} can't be an alias")
    return name


def _selected(x: Any) -> Any:
    """What a select callback gives, as an expression, an alias's row, or a dict of these."""
    if isinstance(x, Query):
        return Include(x, "collection")
    if isinstance(x, dict):
        for name in x:
            if not isinstance(name, str) or name.startswith("$"):
                raise QueryError(f"{name!r} can't be a field")
        return {k: _selected(v) for k, v in x.items()}
    return x if isinstance(x, Include) else expr(x)


class Query:
    """A query under construction.

    Callbacks get the rows in scope, ``r.alias.field``; after a select also its
    output, ``r.selected.field``.  In a select a dict key that starts with
    ``...`` spreads a row: ``{"...u": r.u, "n": ...}``; later fields win.
    """

    def __init__(self, plan: Plan | None = None):
        self.plan = plan or Plan()

    def _with(self, **fields: Any) -> Query:
        return Query(changed(self.plan, **fields))

    def _call(self, f: Callable[[Rows], Any]) -> Any:
        if not callable(f):
            raise QueryError("a callback of the rows in scope is asked for")
        names = self.plan.aliases
        return f(self._rows(names))

    def _rows(self, names: tuple[str, ...]) -> Rows:
        """The scope of a callback; behind a union of queries the branches' fields stand in it by their own names."""
        return Rows(names, UNION if self.plan.kind == "union_queries" else None)

    # sources

    def from_(self, *query: Any, **source: Any) -> Query:
        """from_(alias=table_or_query), one alias exactly."""
        if self.plan.sources or self.plan.branches:
            raise SourceError("a query has one FROM")
        if query or len(source) != 1:
            raise SourceError("from_ takes one source under one alias")
        return self._with(sources=tuple((_alias(a), _source(s)) for a, s in source.items()))

    def union_all(self, *queries: Query, **sources: Any) -> Query:
        """union_all(a=x, b=y): a row for each source's row under its own alias; union_all(q1, q2): the queries' result rows as one bag."""
        if self.plan.sources or self.plan.branches:
            raise SourceError("a query has one FROM")
        if bool(queries) == bool(sources):
            raise SourceError("union_all takes sources under aliases or queries")
        if sources:
            return self._with(kind="union_sources", sources=tuple((_alias(a), _source(s)) for a, s in sources.items()))
        seen: set[str] = set()
        for q in queries:
            if not isinstance(q, Query):
                raise SourceError("a branch of union_all is not a query")
            if twice := seen & set(q.plan.aliases):
                raise SourceError(f"branches share the alias {sorted(twice)[0]!r}")
            seen |= set(q.plan.aliases)
        return self._with(kind="union_queries", branches=tuple(map(_source, queries)))

    def join(self, source: dict[str, Any], on: Callable[[Rows], Any], how: str = "left", null_safe: bool = False) -> Query:
        """Joins one more source on one equality of an expression of the new source and one of those before it."""
        if how not in JOIN_KINDS:
            raise JoinError(f"a join can't be {how!r}")
        if len(source) != 1:
            raise SourceError("a join takes one source under one alias")
        ((alias, s),) = source.items()
        if alias in self.plan.aliases:
            raise SourceError(f"the alias {alias!r} is taken")
        if not self.plan.sources and not self.plan.branches:
            raise SourceError("a join needs a FROM before it")
        before = self.plan.aliases
        condition = on(self._rows((*before, _alias(alias))))
        if not (isinstance(condition, Func) and condition.name == "eq"):
            raise JoinError("a join's condition is one eq()")
        sides = []
        for e in condition.args:
            names = {x.alias for x in walk(e) if isinstance(x, Ref)}
            if aggregates(e):
                raise JoinError("a join's condition can't aggregate")
            if not names:
                raise JoinError("each side of a join's condition refers to a source")
            if alias in names and len(names) > 1:
                raise JoinError("a side of a join's condition mixes sources")
            sides.append(alias in names)
        if sides == [True, True] or sides == [False, False]:
            raise JoinError("a join's condition compares the new source with one before it")
        left, right = condition.args if sides == [False, True] else condition.args[::-1]
        return self._with(joins=(*self.plan.joins, Join(alias, _source(s), left, right, how, null_safe)))

    def left_join(self, source: dict[str, Any], on: Callable) -> Query:
        return self.join(source, on, "left")

    def right_join(self, source: dict[str, Any], on: Callable) -> Query:
        return self.join(source, on, "right")

    def inner_join(self, source: dict[str, Any], on: Callable) -> Query:
        return self.join(source, on, "inner")

    def full_join(self, source: dict[str, Any], on: Callable) -> Query:
        return self.join(source, on, "full")

    # rows

    def where(self, f: Callable[[Rows], Any]) -> Query:
        """Keeps rows for which the condition is true; further calls narrow."""
        e = self._call(f)
        if not isinstance(e, Expr) or isinstance(e, (Include, Case)):
            raise WhereError(f"{e!r} is not a condition; compare with eq() and the like")
        if aggregates(e):
            raise WhereError("where comes before grouping; filter aggregates with having")
        return self._with(where=(*self.plan.where, e))

    def select(self, f: Callable[[Rows], Any]) -> Query:
        return self._with(select=_selected(self._call(f)), fn_select=None)

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def group_by(self, f: Callable[[Rows], Any]) -> Query:
        keys = self._call(f)
        keys = keys if isinstance(keys, (list, tuple)) else [keys]
        if any(aggregates(k) for k in keys):
            raise GroupError("a group key can't aggregate")
        return self._with(group_by=(*self.plan.group_by, *map(expr, keys)))

    def having(self, f: Callable[[Rows], Any]) -> Query:
        e = self._call(f)
        if not isinstance(e, Expr):
            raise WhereError(f"{e!r} is not a condition")
        return self._with(having=(*self.plan.having, e))

    def order_by(self, f: Callable[[Rows], Any], direction: str = "asc", nulls: str = "first", string_sort: str | None = None, locale: str | None = None) -> Query:
        """Appends order keys.  Nulls come first in both directions unless said otherwise; ties fall to the rows' keys."""
        if direction not in ("asc", "desc") or nulls not in ("first", "last") or string_sort not in (None, "lexical", "locale"):
            raise OrderError("direction is asc or desc, nulls first or last, string_sort lexical or locale")
        keys = self._call(f)
        keys = keys if isinstance(keys, (list, tuple)) else [keys]
        return self._with(order_by=(*self.plan.order_by, *[Order(expr(k), direction == "desc", nulls, string_sort, locale) for k in keys]))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise OrderError("a limit is 0 or more")
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise OrderError("an offset is 0 or more")
        return self._with(offset=n)

    def find_one(self) -> Query:
        """The first row by the order, or by the key."""
        return self._with(single=True)

    # Python functions of rows

    def fn_select(self, f: Callable, schema: Any) -> Query:
        """Output rows from a Python function of a pandas frame of the rows in scope; ``schema`` is its result's."""
        return self._with(fn_select=(f, schema), select=None)

    def fn_where(self, f: Callable) -> Query:
        """Keeps rows for which a function of a pandas frame of the rows gives True itself."""
        return self._with(fn_where=(*self.plan.fn_where, f))

    def fn_having(self, f: Callable) -> Query:
        """Keeps output rows for which a function of a pandas frame of them gives True itself."""
        return self._with(fn_having=(*self.plan.fn_having, f))

    # results

    def to_df(self) -> DataFrame:
        from tidewright.plans.planner import to_df

        return to_df(self)

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    def set_window(self, offset: int | None = None, limit: int | None = None) -> Query:
        """The same query over other rows of its order."""
        if not self.plan.order_by:
            raise OrderError("a window needs an order")
        return self._with(offset=offset if offset is not None else self.plan.offset, limit=limit if limit is not None else self.plan.limit)

    def validate(self) -> None:
        """Checks that need the whole query."""
        p = self.plan
        if p.kind != "union_queries" and not p.sources:
            raise SourceError("a query needs a FROM")
        if (p.limit is not None or p.offset is not None) and not p.order_by:
            raise OrderError("limit and offset need an order_by")
        if p.distinct and p.select is None and p.fn_select is None and p.kind == "from":
            raise DistinctError("distinct needs a select")
        if p.fn_select and p.group_by:
            raise GroupError("fn_select can't stand with group_by")
        grouped = p.group_by or aggregates(p.select) if not isinstance(p.select, Include) else p.group_by
        if p.having and not grouped:
            raise GroupError("having needs group_by or aggregates")

        def scope(q: Plan, outer: frozenset[str]) -> None:
            for a, s in (*q.sources, *((j.alias, j.source) for j in q.joins)):
                if a in outer:
                    raise SourceError(f"a nested query has the alias {a!r} again")
                if isinstance(s, Query):
                    scope(s.plan, outer | {a})
            for s in q.branches:
                scope(s.plan, outer)

        scope(p, frozenset())


def query_once(build: Callable[[Query], Query]) -> list | Any:
    """Runs a query and gives its rows; for find_one() the first row or None."""
    q = build(Query())
    rows = q.to_df().collect()
    return (rows[0] if rows else None) if q.plan.single else rows

