"""Expressions as Spark columns.  All scalar and aggregate semantics live here."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import FunctionError, UnknownNameError
from tidewright.plans.ir import SELECTED, Agg, Case, Expr, Func, Ref, Value

#: The field that tells a row that is there from an alias without one.
PRESENT = "__present"
#: No pattern has this character, so LIKE has no escape.
NO_ESCAPE = "\u0001"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

_NUMBER = (T.NumericType,)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(*path: str) -> Column:
    return F.col(".".join(f"`{x.replace('`', '``')}`" for x in path))


class Compiler:
    """Compiles expressions over a frame with one struct column an alias.

    ``swap`` may answer for an expression with a column, as grouped queries do
    for their keys and aggregates.
    """

    def __init__(self, frame: DataFrame, aliases: tuple[str, ...], swap: Callable[[Expr], Column | None] = lambda e: None, outer: frozenset[str] = frozenset()):
        self.frame, self.aliases, self.swap, self.outer = frame, aliases, swap, outer
        self._kinds: dict[Expr, T.DataType] = {}

    def kind(self, e: Expr) -> T.DataType:
        try:
            known = self._kinds.get(e)
        except TypeError:
            return self.frame.select(self(e).alias("x")).schema[0].dataType
        if known is None:
            known = self._kinds[e] = self.frame.select(self(e).alias("x")).schema[0].dataType
        return known

    def __call__(self, e: Expr) -> Column:
        if (c := self.swap(e)) is not None:
            return c
        if isinstance(e, Ref):
            return self.ref(e)
        if isinstance(e, Value):
            return self.value(e.value)
        if isinstance(e, Case):
            return self.case(e)
        if isinstance(e, Func):
            method = getattr(self, f"f_{e.name}", None)
            if method is None:
                raise FunctionError(f"there is no function {e.name!r}")
            try:
                return method(*e.args)
            except TypeError as x:
                if "positional argument" in str(x):
                    raise FunctionError(f"{e.name} doesn't take {len(e.args)} arguments") from None
                raise
        if isinstance(e, Agg):
            raise FunctionError(f"the aggregate {e.name} stands where rows aren't grouped")
        raise FunctionError(f"{e!r} is not an expression")

    # references and literals

    def ref(self, e: Ref) -> Column:
        if e.alias == SELECTED:
            if not e.path or e.path[0] not in self.frame.columns:
                raise UnknownNameError(f"the select has no {'.'.join(e.path)!r}")
            return quoted(*e.path)
        if e.alias not in self.aliases:
            raise UnknownNameError(f"no source is called {e.alias!r}")
        kind = self.frame.schema[e.alias].dataType
        for k, name in enumerate(e.path):
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                raise UnknownNameError(f"{'.'.join((e.alias, *e.path[: k + 1]))} doesn't exist")
            kind = kind[name].dataType
        if not e.path:
            return self.row(e.alias)
        return quoted(e.alias, *e.path)

    def row(self, alias: str) -> Column:
        """The alias's row as a struct without marks, null where it has none."""
        names = [f for f in self.frame.schema[alias].dataType.fieldNames() if not f.startswith("__")]
        return F.when(self.present(alias), F.struct(*[quoted(alias, n).alias(n) for n in names]))

    def present(self, alias: str) -> Column:
        return quoted(alias, PRESENT).isNotNull()

    @staticmethod
    def value(x: object) -> Column:
        if isinstance(x, (tuple, list)):
            return F.array(*[Compiler.value(y) for y in x])
        if isinstance(x, dt.datetime) and x.tzinfo is None:
            return F.lit(x.replace(tzinfo=dt.UTC).isoformat()).cast("timestamp")
        return F.lit(x)

    # comparison

    def _alike(self, a: Expr, b: Expr, name: str) -> None:
        group = lambda k: "number" if isinstance(k, _NUMBER) else "time" if isinstance(k, _TIME) else "null" if isinstance(k, T.NullType) else k.typeName()
        x, y = group(self.kind(a)), group(self.kind(b))
        if x != y and "null" not in (x, y):
            raise FunctionError(f"{name} compares {x} with {y}; nothing is converted")

    def _compare(self, a: Expr, b: Expr, name: str, op: Callable[[Column, Column], Column]) -> Column:
        self._alike(a, b, name)
        return op(self(a), self(b))

    def f_eq(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, "eq", lambda x, y: x == y)

    def f_gt(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, "gt", lambda x, y: x > y)

    def f_gte(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, "gte", lambda x, y: x >= y)

    def f_lt(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, "lt", lambda x, y: x < y)

    def f_lte(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, "lte", lambda x, y: x <= y)

    # logic

    def boolean(self, e: Expr) -> Column:
        kind = self.kind(e)
        if not isinstance(kind, (T.BooleanType, T.NullType)):
            raise FunctionError(f"a condition is {kind.simpleString()}, not boolean")
        return self(e).cast("boolean")

    def f_and(self, *args: Expr) -> Column:
        out = self.boolean(args[0])
        for a in args[1:]:
            out = out & self.boolean(a)
        return out

    def f_or(self, *args: Expr) -> Column:
        out = self.boolean(args[0])
        for a in args[1:]:
            out = out | self.boolean(a)
        return out

    def f_not(self, a: Expr) -> Column:
        return ~self.boolean(a)

    def f_is_null(self, a: Expr) -> Column:
        if isinstance(a, Ref) and a.alias in self.aliases:
            if not a.path:
                return F.lit(False)
            return self.present(a.alias) & self(a).isNull() if a.alias in self.outer else self(a).isNull()
        return self(a).isNull()

    def f_is_undefined(self, a: Expr) -> Column:
        if isinstance(a, Ref) and a.alias in self.aliases:
            return ~self.present(a.alias)
        return F.lit(False)

    def f_in(self, a: Expr, values: Expr) -> Column:
        if isinstance(values, Value):
            if not isinstance(values.value, (tuple, list, set, frozenset)):
                return F.when(self(a).isNotNull(), F.lit(False))
            known = [x for x in values.value if x is not None]
            return self(a).isin(*[self.value(x) for x in known]) if known else F.when(self(a).isNotNull(), F.lit(False))
        if not isinstance(self.kind(values), T.ArrayType):
            return F.when(self(a).isNotNull(), F.lit(False))
        return F.when(self(a).isNotNull(), F.coalesce(F.array_contains(self(values), self(a)), F.lit(False)))

    # strings and arrays

    def _text(self, e: Expr) -> bool:
        return isinstance(self.kind(e), (T.StringType, T.NullType))

    def f_like(self, a: Expr, p: Expr) -> Column:
        if not (self._text(a) and self._text(p)):
            return F.when(self(a).isNotNull() & self(p).isNotNull(), F.lit(False))
        return F.like(self(a).cast("string"), self(p).cast("string"), F.lit(NO_ESCAPE))

    def f_ilike(self, a: Expr, p: Expr) -> Column:
        if not (self._text(a) and self._text(p)):
            return F.when(self(a).isNotNull() & self(p).isNotNull(), F.lit(False))
        return F.like(F.lower(self(a).cast("string")), F.lower(self(p).cast("string")), F.lit(NO_ESCAPE))

    def f_upper(self, a: Expr) -> Column:
        return F.upper(self(a)) if self._text(a) else self(a)

    def f_lower(self, a: Expr) -> Column:
        return F.lower(self(a)) if self._text(a) else self(a)

    def f_length(self, a: Expr) -> Column:
        kind = self.kind(a)
        if isinstance(kind, T.StringType):
            return F.coalesce(F.length(self(a)), F.lit(0)).cast("long")
        if isinstance(kind, T.ArrayType):
            return F.when(self(a).isNull(), 0).otherwise(F.size(self(a))).cast("long")
        return F.lit(0).cast("long")

    def string(self, e: Expr) -> Column:
        """As text: whole numbers without a fraction, times in ISO form, null as nothing."""
        c, kind = self(e), self.kind(e)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
        elif isinstance(kind, T.TimestampType):
            c = F.date_format(c, ISO)
        return F.coalesce(c.cast("string"), F.lit(""))

    def f_concat(self, *args: Expr) -> Column:
        return F.concat(*[self.string(a) for a in args]) if args else F.lit("")

    def f_coalesce(self, *args: Expr) -> Column:
        return F.coalesce(*[self(a) for a in args])

    # conditions

    def truthy(self, e: Expr) -> Column:
        """A condition of any kind: false, null, 0, NaN and '' don't hold."""
        kind, c = self.kind(e), self(e)
        if isinstance(kind, T.BooleanType):
            holds = c
        elif isinstance(kind, _NUMBER):
            holds = (c != 0) & ~F.isnan(c.cast("double"))
        elif isinstance(kind, T.StringType):
            holds = c != ""
        else:
            holds = c.isNotNull()
        return F.coalesce(holds, F.lit(False))

    def f_case_when(self, *args: Expr) -> Column:
        if len(args) < 2:
            raise FunctionError("case_when takes a condition and a value at least")
        out = F
        for k in range(0, len(args) - 1, 2):
            out = out.when(self.truthy(args[k]), self(args[k + 1]))
        return out.otherwise(self(args[-1])) if len(args) % 2 else out

    def case(self, e: Case) -> Column:
        """Branches as one struct with the fields of all; a field that a branch lacks is null there; no branch is null."""
        options = [*e.branches, *(((None, e.otherwise),) if e.otherwise else ())]
        kinds: dict[str, str] = {}
        for _, fields in options:
            for name, x in fields:
                kind = self.kind(x)
                if not isinstance(kind, T.NullType) and kinds.setdefault(name, kind.simpleString()) != kind.simpleString():
                    if all(k in ("int", "bigint", "double", "smallint") for k in (kinds[name], kind.simpleString())):
                        kinds[name] = "double" if "double" in (kinds[name], kind.simpleString()) else "bigint"
                    else:
                        raise FunctionError(f"branches give {name!r} as {kinds[name]} and {kind.simpleString()}")
        names = list(dict.fromkeys(name for _, fields in options for name, _ in fields))
        struct = lambda fields: F.struct(*[(self(dict(fields)[n]) if n in dict(fields) else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])
        out = F
        for condition, fields in e.branches:
            out = out.when(self.truthy(condition), struct(fields))
        return out.otherwise(struct(e.otherwise)) if e.otherwise else out

    # arithmetic

    def _number(self, e: Expr) -> Column:
        kind = self.kind(e)
        if isinstance(kind, T.NullType):
            return F.lit(0).cast("long")
        if not isinstance(kind, _NUMBER):
            raise FunctionError(f"arithmetic on {kind.simpleString()}")
        wide = "double" if isinstance(kind, (T.DoubleType, T.FloatType)) else kind.simpleString() if isinstance(kind, T.DecimalType) else "long"
        return F.coalesce(self(e).cast(wide), F.lit(0).cast(wide))

    def f_add(self, a: Expr, b: Expr) -> Column:
        if self._text(a) and self._text(b) and not all(isinstance(self.kind(x), T.NullType) for x in (a, b)):
            return F.concat(self.string(a), self.string(b))
        return self._number(a) + self._number(b)

    def f_subtract(self, a: Expr, b: Expr) -> Column:
        return self._number(a) - self._number(b)

    def f_multiply(self, a: Expr, b: Expr) -> Column:
        return self._number(a) * self._number(b)

    def f_divide(self, a: Expr, b: Expr) -> Column:
        return F.try_divide(self._number(a).cast("double"), self._number(b).cast("double"))

    # dates

    def _instant(self, e: Expr) -> Column:
        kind = self.kind(e)
        if isinstance(kind, _NUMBER):
            return F.timestamp_millis(self(e).cast("long"))
        if isinstance(kind, T.StringType):
            return F.try_to_timestamp(self(e))
        return self(e).cast("timestamp")

    def f_date(self, a: Expr) -> Column:
        return F.date_format(self._instant(a), "yyyy-MM-dd")

    def f_datetime(self, a: Expr) -> Column:
        return F.date_format(self._instant(a), ISO)

    def f_strftime(self, fmt: Expr, a: Expr) -> Column:
        if not self._text(fmt):
            return F.lit(None).cast("string")
        return F.when(self(fmt) == "%Y-%m-%d", self.f_date(a)).when(self(fmt).isNotNull(), self.f_datetime(a))


def aggregate(e: Agg, c: Compiler) -> Column:
    """sum and avg take null as 0 and text as the number that it writes; count counts what isn't null."""
    kind = c.kind(e.arg)
    x = c(e.arg)
    if e.name == "count":
        return F.count(x)
    if e.name in ("sum", "avg"):
        if isinstance(kind, T.StringType):
            x = F.when(x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), x.try_cast("double"))
        elif isinstance(kind, T.BooleanType):
            x = x.cast("long")
        elif not isinstance(kind, (*_NUMBER, T.NullType)):
            raise FunctionError(f"{e.name} of {kind.simpleString()}")
        x = F.coalesce(x.cast("double" if isinstance(kind, (T.StringType, T.FloatType, T.NullType)) else "long" if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)) else kind.simpleString() if not isinstance(kind, T.BooleanType) else "long"), F.lit(0))
        return F.sum(x) if e.name == "sum" else F.avg(x)
    if e.name in ("min", "max"):
        return (F.min if e.name == "min" else F.max)(x)
    if e.name == "median":
        return F.median(x.cast("double"))
    if e.name == "mode":
        return F.mode(x, deterministic=True)
    raise FunctionError(f"there is no aggregate {e.name!r}")
