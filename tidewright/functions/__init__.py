"""Constructors of expressions.

Comparisons and logic are three-valued; arithmetic takes null as 0; division by
0 is null; concat takes null as the empty string.  columns.py has the meaning of
each as a Spark column.
"""

from __future__ import annotations

from typing import Any

from tidewright.errors import FunctionError
from tidewright.plans.ir import Agg, Case, Expr, Func, Include, Value, expr


def _func(name: str, *args: Any) -> Func:
    return Func(name, tuple(expr(a) for a in args))


def eq(a: Any, b: Any) -> Func:
    return _func("eq", a, b)


def gt(a: Any, b: Any) -> Func:
    return _func("gt", a, b)


def gte(a: Any, b: Any) -> Func:
    return _func("gte", a, b)


def lt(a: Any, b: Any) -> Func:
    return _func("lt", a, b)


def lte(a: Any, b: Any) -> Func:
    return _func("lte", a, b)


def and_(*args: Any) -> Func:
    return _func("and", *args)


def or_(*args: Any) -> Func:
    return _func("or", *args)


def not_(a: Any) -> Func:
    return _func("not", a)


def is_null(a: Any) -> Func:
    """The value is null in a row that is there; false for a field of an unmatched alias."""
    return _func("is_null", a)


def is_undefined(a: Any) -> Func:
    """The alias has no row here, as after an outer join or in another branch of a union."""
    return _func("is_undefined", a)


def in_array(a: Any, values: Any) -> Func:
    """Membership in a list or an array field; nulls in it never make the answer unknown."""
    return _func("in", a, values)


def like(a: Any, pattern: Any) -> Func:
    return _func("like", a, pattern)


def ilike(a: Any, pattern: Any) -> Func:
    return _func("ilike", a, pattern)


def upper(a: Any) -> Func:
    return _func("upper", a)


def lower(a: Any) -> Func:
    return _func("lower", a)


def length(a: Any) -> Func:
    """Characters of a string or items of an array; 0 for null and anything else."""
    return _func("length", a)


def concat(*args: Any) -> Expr:
    """Strings end to end; of a to_array() of scalars, the children's values end to end."""
    if len(args) == 1 and isinstance(args[0], Include):
        return Include(args[0].query, "concat")
    return _func("concat", *args)


def coalesce(*args: Any) -> Func:
    return _func("coalesce", *args)


def case_when(*args: Any) -> Expr:
    """case_when(condition, value, ..., [otherwise]) with scalar values, or with dicts as a conditional projection."""
    if len(args) < 2:
        raise FunctionError("case_when takes a condition and a value at least")
    pairs = [(expr(args[k]), args[k + 1]) for k in range(0, len(args) - 1, 2)]
    rest = args[-1] if len(args) % 2 else None
    if isinstance(pairs[0][1], dict):
        items = lambda d: tuple((k, x if isinstance(x, (dict, Include)) else expr(x)) for k, x in d.items())
        return Case(tuple((c, items(d)) for c, d in pairs), items(rest) if rest else None)
    return _func("case_when", *[x for p in pairs for x in p], *([rest] if len(args) % 2 else []))


def add(a: Any, b: Any) -> Func:
    return _func("add", a, b)


def subtract(a: Any, b: Any) -> Func:
    return _func("subtract", a, b)


def multiply(a: Any, b: Any) -> Func:
    return _func("multiply", a, b)


def divide(a: Any, b: Any) -> Func:
    return _func("divide", a, b)


def date(a: Any) -> Func:
    return _func("date", a)


def datetime(a: Any) -> Func:
    return _func("datetime", a)


def strftime(fmt: Any, a: Any) -> Func:
    return _func("strftime", fmt, a)


def count(a: Any) -> Agg:
    return Agg("count", expr(a))


def sum_(a: Any) -> Agg:
    return Agg("sum", expr(a))


def avg(a: Any) -> Agg:
    return Agg("avg", expr(a))


def min_(a: Any) -> Agg:
    return Agg("min", expr(a))


def max_(a: Any) -> Agg:
    return Agg("max", expr(a))


def median(a: Any) -> Agg:
    return Agg("median", expr(a))


def mode(a: Any) -> Agg:
    """The commonest value, the smallest of several."""
    return Agg("mode", expr(a))


def to_array(query: Any) -> Include:
    return Include(query, "array")


def materialize(query: Any) -> Include:
    """The children as an array, or the first one if the query asks for one."""
    return Include(query, "single" if query.plan.single else "array")


def literal(x: Any) -> Value:
    return Value(x)


OPERATORS = ["eq", "gt", "gte", "lt", "lte", "and", "or", "not", "is_null", "is_undefined", "in", "like", "ilike", "upper", "lower", "length", "concat", "coalesce", "case_when", "add", "subtract", "multiply", "divide", "date", "datetime", "strftime", "count", "sum", "avg", "min", "max", "median", "mode"]
