"""The query representation: frozen nodes that the builder makes and the planner reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidewright.errors import FunctionError, WhereError

#: The alias under which a query's own output is referred to.
SELECTED = "selected"
#: The alias of the rows of a union of queries, whose fields callbacks name alone.
UNION = "__all"


@dataclass(frozen=True, eq=False)
class Table:
    """A keyed source: a DataFrame, its key columns and how its strings sort by default."""

    df: DataFrame
    key: tuple[str, ...] = ()
    name: str = ""
    string_sort: str = "lexical"

    @property
    def fields(self) -> list[str]:
        return self.df.columns


class Expr:
    """Any scalar expression."""


@dataclass(frozen=True)
class Ref(Expr):
    """A field of a source: an alias and the path below it; an empty path is the whole row."""

    alias: str
    path: tuple[str, ...] = ()

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        return Ref(self.alias, (*self.path, name))

    def __getitem__(self, name: str) -> Ref:
        return Ref(self.alias, (*self.path, name))

    def __bool__(self) -> bool:
        raise WhereError("an expression has no truth value; use and_, or_ and not_")


@dataclass(frozen=True)
class Value(Expr):
    value: Any


@dataclass(frozen=True)
class Func(Expr):
    name: str
    args: tuple[Expr, ...]

    def __bool__(self) -> bool:
        raise WhereError("an expression has no truth value; use and_, or_ and not_")


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    arg: Expr


@dataclass(frozen=True)
class Case(Expr):
    """Conditional projection: (condition, fields) branches and the fields otherwise."""

    branches: tuple[tuple[Expr, tuple[tuple[str, Any], ...]], ...]
    otherwise: tuple[tuple[str, Any], ...] | None = None


@dataclass(frozen=True)
class Include(Expr):
    """A correlated child query whose rows nest in the parent's: as array, single, concat or collection."""

    query: Any
    mode: str = "array"


@dataclass(frozen=True)
class Rows:
    """Namespace that callbacks get: one attribute an alias, and ``selected`` for the output."""

    aliases: tuple[str, ...]
    #: An alias whose fields go by their names alone.
    bare: str | None = None

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self.aliases and name != SELECTED:
            if self.bare:
                return Ref(self.bare, (name,))
            from tidewright.errors import UnknownNameError

            raise UnknownNameError(f"no source is called {name!r}; there are {', '.join(self.aliases)}")
        return Ref(name)

    def __getitem__(self, name: str) -> Ref:
        return getattr(self, name)


@dataclass(frozen=True)
class Join:
    alias: str
    source: Any
    left: Expr
    right: Expr
    how: str
    null_safe: bool = False


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False
    nulls: str = "first"
    string_sort: str | None = None
    locale: str | None = None


@dataclass(frozen=True)
class Plan:
    """A whole query.  ``kind`` is from, union_sources or union_queries."""

    kind: str = "from"
    sources: tuple[tuple[str, Any], ...] = ()
    branches: tuple[Any, ...] = ()
    joins: tuple[Join, ...] = ()
    where: tuple[Expr, ...] = ()
    fn_where: tuple[Callable, ...] = ()
    select: Any = None
    fn_select: tuple[Callable, Any] | None = None
    group_by: tuple[Expr, ...] = ()
    having: tuple[Expr, ...] = ()
    fn_having: tuple[Callable, ...] = ()
    distinct: bool = False
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    single: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def aliases(self) -> tuple[str, ...]:
        return (*(a for a, _ in self.sources), *(j.alias for j in self.joins))


def expr(x: Any) -> Expr:
    """A Python value or expression as an expression."""
    if isinstance(x, Expr):
        return x
    if callable(x) or isinstance(x, Rows):
        raise FunctionError(f"{x!r} is not an expression")
    return Value(tuple(x) if isinstance(x, list) else x)


def walk(e: Any) -> Iterator[Expr]:
    """The expression and all below it; nested queries aren't entered."""
    if isinstance(e, Expr):
        yield e
    if isinstance(e, Func):
        for a in e.args:
            yield from walk(a)
    elif isinstance(e, Agg):
        yield from walk(e.arg)
    elif isinstance(e, Case):
        for c, fields in (*e.branches, *(((None, e.otherwise),) if e.otherwise else ())):
            yield from walk(c)
            for _, x in fields:
                yield from walk(x)
    elif isinstance(e, dict):
        for x in e.values():
            yield from walk(x)


def replace(e: Any, swap: Callable[[Expr], Expr | None]) -> Any:
    """The expression with those that ``swap`` answers for replaced, from the top down."""
    if isinstance(e, dict):
        return {k: replace(x, swap) for k, x in e.items()}
    if not isinstance(e, Expr):
        return e
    if (new := swap(e)) is not None:
        return new
    if isinstance(e, Func):
        return Func(e.name, tuple(replace(a, swap) for a in e.args))
    if isinstance(e, Agg):
        return Agg(e.name, replace(e.arg, swap))
    if isinstance(e, Case):
        fields = lambda fs: tuple((k, replace(x, swap)) for k, x in fs)
        return Case(tuple((replace(c, swap), fields(fs)) for c, fs in e.branches), fields(e.otherwise) if e.otherwise else None)
    return e


def aggregates(e: Any) -> list[Agg]:
    return list(dict.fromkeys(x for x in walk(e) if isinstance(x, Agg)))


def conjuncts(e: Expr) -> list[Expr]:
    if isinstance(e, Func) and e.name == "and":
        return [y for x in e.args for y in conjuncts(x)]
    return [e]
