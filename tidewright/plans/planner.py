"""Queries to DataFrames.

Clauses take effect in the order FROM, JOIN, WHERE, SELECT, GROUP BY, HAVING,
DISTINCT, ORDER BY, OFFSET and LIMIT.  Each alias is one struct column, so that
a whole row can be selected and a row that isn't there told from a null field;
Catalyst prunes the structs' unused fields down to the scan.

A nested query in a select is decorrelated here: its rows are keyed by what its
parent compares, ranked, gathered by key and joined on.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import FunctionError, GroupError, IncludeError, QueryError, SourceError
from tidewright.functions.columns import PRESENT, Compiler, aggregate, quoted
from tidewright.operators.ordering import sort_column
from tidewright.plans.builder import Query
from tidewright.plans.ir import SELECTED, UNION, Agg, Case, Expr, Func, Include, Order, Plan, Ref, Table, aggregates, conjuncts, replace, walk


#: What has been planned for the query that a thread is planning, by the identity of its parts.
_PLANNING = threading.local()


@dataclass
class Scope:
    """Rows with one struct an alias, the columns that identify a row, and which aliases may be absent."""

    frame: DataFrame
    aliases: tuple[str, ...]
    keys: list[Column] = field(default_factory=list)
    outer: frozenset[str] = frozenset()
    #: Correlation columns of a nested query, to carry to its result.
    carried: tuple[str, ...] = ()

    def compiler(self, swap=lambda e: None) -> Compiler:
        return Compiler(self.frame, self.aliases, swap, self.outer)


def _struct(df: DataFrame, alias: str) -> DataFrame:
    return df.select(F.struct(*[quoted(c).alias(c) for c in df.columns], F.lit(True).alias(PRESENT)).alias(alias))


def _source(alias: str, source: Any) -> tuple[DataFrame, list[Column]]:
    if isinstance(source, Query):
        df = to_df(source)
        return _struct(df, alias), [quoted(alias, c) for c in df.columns if _orderable(df.schema[c].dataType)]
    keys = source.key or tuple(c for c in source.df.columns if _orderable(source.df.schema[c].dataType))
    return _struct(source.df, alias), [quoted(alias, c) for c in keys]


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _sources(p: Plan) -> Scope:
    if p.kind == "union_sources":
        parts, kinds = [], {}
        frames = [(a, *_source(a, s)) for a, s in p.sources]
        for a, df, _ in frames:
            kinds[a] = df.schema[a].dataType
        for n, (a, df, keys) in enumerate(frames):
            others = [F.lit(None).cast(kinds[b]).alias(b) if b != a else quoted(a) for b, *_ in frames]
            key = F.struct(*keys).cast("string") if keys else F.lit("")
            parts.append(df.select(*others, F.lit(n).alias("__source"), key.alias("__key")))
        frame = reduce(DataFrame.unionByName, parts)
        names = tuple(a for a, _ in p.sources)
        return Scope(frame, names, [F.col("__source"), F.col("__key")], frozenset(names))
    alias, source = p.sources[0]
    frame, keys = _source(alias, source)
    return Scope(frame, (alias,), keys)


def _branches(p: Plan) -> Scope:
    """The rows of a union of queries; a field that a branch lacks is null there."""
    frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [to_df(b) for b in p.branches])
    return Scope(_struct(frame, UNION), (UNION,), [quoted(UNION, c) for c in frame.columns if _orderable(frame.schema[c].dataType)])


def _joined(scope: Scope, p: Plan) -> Scope:
    for j in p.joins:
        other, keys = _source(j.alias, j.source)
        left = Compiler(scope.frame, scope.aliases, outer=scope.outer)
        right = Compiler(other, (j.alias,))
        a, b = left(j.left), right(j.right)
        if left.kind(j.left).typeName() != right.kind(j.right).typeName():
            both = [isinstance(c.kind(e), T.NumericType) for c, e in ((left, j.left), (right, j.right))]
            if both != [True, True] and not all(isinstance(c.kind(e), (T.DateType, T.TimestampType)) for c, e in ((left, j.left), (right, j.right))):
                raise FunctionError(f"a join compares {left.kind(j.left).simpleString()} with {right.kind(j.right).simpleString()}")
        condition = a.eqNullSafe(b) if j.null_safe else a == b
        outer = scope.outer
        if j.how in ("left", "full"):
            outer = outer | {j.alias}
        if j.how in ("right", "full"):
            outer = outer | set(scope.aliases)
        scope = Scope(scope.frame.join(other, condition, {"full": "full_outer"}.get(j.how, j.how)), (*scope.aliases, j.alias), [*scope.keys, *keys], outer, scope.carried)
    return scope


def _antijoin(p: Plan) -> Plan | None:
    """A query whose last left join only finds rows without a match, with that join taken out; its rows come from a left anti join."""
    if not p.joins or p.joins[-1].how != "left" or p.joins[-1].null_safe:
        return None
    alias = p.joins[-1].alias
    tests = [e for w in p.where for e in conjuncts(w)]
    lone = [e for e in tests if isinstance(e, Func) and e.name == "is_undefined" and e.args[0] == Ref(alias)]
    if not lone or p.select is None or p.fn_where or p.fn_having or p.fn_select:
        return None
    rest = [e for e in tests if e not in lone]
    used = [x for e in (*rest, *p.group_by, *p.having, *(o.expr for o in p.order_by)) for x in walk(e)]
    nodes = [*used, *walk(p.select)]
    if any(isinstance(x, Include) for x in nodes) or any(isinstance(x, Ref) and x.alias == alias for x in nodes):
        return None
    return Plan(**{**p.__dict__, "joins": p.joins[:-1], "where": tuple(rest), "extra": {"anti": p.joins[-1]}})


def to_df(query: Query) -> DataFrame:
    """The query's result, rows in the query's order.  A query that stands several times in another is planned once."""
    known, outermost = getattr(_PLANNING, "known", None), False
    if known is None:
        known, outermost = {}, True
        _PLANNING.known = known
    try:
        if id(query) not in known:
            query.validate()
            known[id(query)] = query, _planned(query.plan, ())
        return known[id(query)][1]
    finally:
        if outermost:
            _PLANNING.known = None


def _planned(p: Plan, correlated: tuple[Expr, ...], context: DataFrame | None = None, links: tuple = (), swap_parent: dict | None = None) -> DataFrame:
    """The result with the columns __p0... that ``correlated`` gives in front, and the rank __rank of each row in its order.

    Without ``correlated`` there are neither, and rows are in order.
    """
    if p.kind == "union_queries":
        scope = _joined(_branches(p), p)
    elif (anti := _antijoin(p)) is not None:
        j = anti.extra["anti"]
        scope = _joined(_sources(anti), anti)
        other, _ = _source(j.alias, j.source)
        a, b = Compiler(scope.frame, scope.aliases, outer=scope.outer)(j.left), Compiler(other, (j.alias,))(j.right)
        scope.frame = scope.frame.join(other, a == b, "left_anti")
        p = anti
    else:
        scope = _joined(_sources(p), p)
    if context is not None:
        # The child's rows for each set of the parent's values that its filters use.
        on = [scope.compiler()(e) == F.col(c) for e, c in links]
        scope.frame = scope.frame.join(context, reduce(Column.__and__, on))
        scope.carried = tuple(context.columns)
    compile_ = scope.compiler(lambda e: quoted(swap_parent[e]) if swap_parent and e in swap_parent else None)
    for e in p.where:
        scope.frame = scope.frame.filter(compile_.boolean(e))
    for f in p.fn_where:
        scope.frame = _python_filter(scope.frame, f)
    return _finish(scope, p, correlated, swap_parent)


def _python_filter(frame: DataFrame, f: Any) -> DataFrame:
    def run(parts):
        for pdf in parts:
            keep = f(pdf)
            yield pdf[[x is True or type(x).__name__ in ("bool_", "bool") and bool(x) for x in keep]] if len(pdf) else pdf

    return frame.mapInPandas(run, frame.schema)


def _fields(select: Any, scope: Scope) -> dict[str, Any]:
    """A select as output fields in order, later ones over earlier ones of a name; a lone row spreads, a lone value is ``value``."""
    def row(alias: str) -> dict[str, Any]:
        return {n: Ref(alias, (n,)) for n in scope.frame.schema[alias].dataType.fieldNames() if not n.startswith("__")}

    if select is None:
        if scope.aliases[0] == UNION:
            return row(UNION) | {a: Ref(a) for a in scope.aliases[1:]}
        return row(scope.aliases[0]) if len(scope.aliases) == 1 else {a: Ref(a) for a in scope.aliases}
    if isinstance(select, Ref) and not select.path and select.alias != SELECTED:
        return row(select.alias)
    if isinstance(select, Case):
        return {"value": select}
    if not isinstance(select, dict):
        return {"value": select}
    out: dict[str, Any] = {}
    for name, x in select.items():
        if name.startswith("..."):
            if not isinstance(x, Ref):
                raise QueryError("only rows spread")
            if x.path:
                kind = scope.compiler().kind(x)
                if not isinstance(kind, T.StructType):
                    raise QueryError("only rows spread")
                out.update({n: Ref(x.alias, (*x.path, n)) for n in kind.fieldNames()})
            else:
                out.update(row(x.alias))
        else:
            out[name] = x
    return out


def _column(x: Any, c: Compiler) -> Column:
    if isinstance(x, dict):
        return F.struct(*[_column(v, c).alias(k) for k, v in x.items()])
    return c(x)


def _finish(scope: Scope, p: Plan, correlated: tuple[Expr, ...], swap_parent: dict | None = None) -> DataFrame:
    fields = None if p.fn_select else _fields(p.select, scope)
    aggs = aggregates(fields) if fields else []
    outer_swap = lambda e: quoted(swap_parent[e]) if swap_parent and e in swap_parent else None
    ck = scope.compiler(outer_swap)
    carried = [quoted(c).alias(c) for c in scope.carried] or [ck(e).alias(f"__p{k}") for k, e in enumerate(correlated)]
    names = list(scope.carried) or [f"__p{k}" for k in range(len(correlated))]

    if p.fn_select:
        if names:
            raise IncludeError("fn_select can't stand in a nested query")
        frame = _python_select(scope.frame, *p.fn_select)
        for f in p.fn_having:
            frame = _python_filter(frame, f)
        if p.distinct:
            frame = frame.dropDuplicates()

        def output(e: Expr) -> Column | None:
            """What comes after fn_select sees its output only, under selected."""
            if isinstance(e, Ref):
                if e.alias != SELECTED or not e.path or e.path[0] not in frame.columns:
                    raise QueryError(f"{'.'.join((e.alias, *e.path))} is not in the output of fn_select")
                return quoted(*e.path)
            return None

        after = Compiler(frame, (), output)
        orders = [(sort_column(o.expr, after, o, _default_sort(p)), o) for o in p.order_by]
        return _ordered(frame, p, orders, [quoted(c) for c in frame.columns if _orderable(frame.schema[c].dataType)], frame.columns, ())
    if p.group_by or aggs:
        frame, orders, ties = _grouped(scope, p, fields, aggs, carried, names, ck)
    else:
        if p.select is not None or p.kind == "union_queries":
            includes = {k: x for k, x in fields.items() if _has_include(x)}
        else:
            includes = {}
        if includes:
            scope, fields = _included(scope, fields, includes)
            ck = scope.compiler(outer_swap)
        orders = [(sort_column(_order_expr(o, fields), ck, o, _default_sort(p)), o) for o in p.order_by]
        ties = [k for k in scope.keys]
        frame = scope.frame.select(
            *carried, *[_column(x, ck).alias(n) for n, x in fields.items()],
            *[c.alias(f"__o{k}") for k, (c, _) in enumerate(orders)], *[c.alias(f"__k{k}") for k, c in enumerate(ties)],
        )
        orders = [(F.col(f"__o{k}"), o) for k, (_, o) in enumerate(orders)]
        ties = [F.col(f"__k{k}") for k in range(len(ties))]
    for f in p.fn_having:
        frame = _python_filter(frame, f)
    out = list(fields)
    if p.distinct:
        shown = [x for x in fields.values() if isinstance(x, Expr)]
        if all(_order_expr(o, fields) in shown for _, o in orders):
            frame = frame.dropDuplicates([*names, *out])
        else:
            # Of equal rows the first in the order stays, so that an order by what isn't selected means something.
            rest = [c for c in frame.columns if c not in (*names, *out)]
            if all(not o.descending and o.nulls == "first" for _, o in orders) and all(_orderable(frame.schema[c].dataType) for c in (*rest, *out)):
                # The least struct combines before the shuffle; the columns of the order come first in it.
                least = frame.groupBy(*names, *map(quoted, out)).agg(F.min(F.struct(*rest)).alias("__first"))
                frame = least.select(*names, *map(quoted, out), *[F.col("__first")[c].alias(c) for c in rest])
            else:
                first = Window.partitionBy(*names, *map(quoted, out)).orderBy(*[_directed(c, o) for c, o in orders], *ties)
                frame = frame.withColumn("__n", F.row_number().over(first)).where("__n = 1")
        ties = [quoted(c) for c in out if _orderable(frame.schema[c].dataType)]
    return _ordered(frame, p, orders, ties, out, tuple(names))


def _order_expr(o: Order, fields: dict[str, Any]) -> Expr:
    """The order's expression with references to the output put back as what they select."""
    return replace(o.expr, lambda e: fields[e.path[0]] if isinstance(e, Ref) and e.alias == SELECTED and len(e.path) == 1 and e.path[0] in fields and isinstance(fields[e.path[0]], Expr) else None)


def _default_sort(p: Plan) -> str:
    s = p.sources[0][1] if p.sources else None
    return s.string_sort if isinstance(s, Table) else "lexical"


def _directed(c: Column, o: Order) -> Column:
    if o.descending:
        return c.desc_nulls_first() if o.nulls == "first" else c.desc_nulls_last()
    return c.asc_nulls_first() if o.nulls == "first" else c.asc_nulls_last()


def _ordered(frame: DataFrame, p: Plan, orders: list, ties: list[Column], out: list[str], names: tuple[str, ...]) -> DataFrame:
    sort = [*[_directed(c, o) for c, o in orders], *[t.asc_nulls_first() for t in ties]]
    limit = p.limit if not p.single or p.limit is not None and p.limit < 1 else 1
    if names and not p.offset and limit is None and all(not o.descending and o.nulls == "first" and _orderable(frame.select(c).schema[0].dataType) for c, o in orders):
        # Structs sort as their fields do, nulls first, so the sort key is the rank and nothing need be ordered before the rows are gathered.
        frame = frame.withColumn("__rank", F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*[c for c, _ in orders], *ties])]) if sort else F.lit(1))
        return frame.select(*map(quoted, names), "__rank", *map(quoted, out))
    if names:
        rank = F.row_number().over(Window.partitionBy(*map(quoted, names)).orderBy(*(sort or [F.lit(1)])))
        frame = frame.withColumn("__rank", rank)
        if p.offset:
            frame = frame.where(F.col("__rank") > p.offset)
        if limit is not None:
            frame = frame.where(F.col("__rank") <= (p.offset or 0) + limit)
        return frame.select(*map(quoted, names), "__rank", *map(quoted, out))
    if orders or p.single:
        frame = frame.orderBy(*sort) if sort else frame
        if p.offset:
            frame = frame.offset(p.offset)
        if limit is not None:
            frame = frame.limit(limit)
    return frame.select(*map(quoted, out)) if set(frame.columns) != set(out) or frame.columns != out else frame


def _python_select(frame: DataFrame, f: Any, schema: Any) -> DataFrame:
    def run(parts):
        for pdf in parts:
            yield f(pdf) if len(pdf) else pd.DataFrame(columns=names)

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()
    return frame.mapInPandas(run, schema)


def _grouped(scope: Scope, p: Plan, fields: dict[str, Any], aggs: list[Agg], carried: list[Column], names: list[str], ck: Compiler):
    if any(_has_include(x) for x in fields.values()):
        raise GroupError("a grouped select can't nest queries")
    keys = {e: f"__g{k}" for k, e in enumerate(dict.fromkeys(p.group_by))}
    # SELECT may name a key's output, which HAVING and ORDER BY then use.
    for a in (a for e in p.having for a in aggregates(e)):
        if a not in aggs:
            raise GroupError("an aggregate in having must be in the select too")
    order_aggs = [a for o in p.order_by for a in aggregates(o.expr)]
    known = {a: f"__a{k}" for k, a in enumerate(dict.fromkeys([*aggs, *order_aggs]))}
    if p.select is None:
        fields = {f"key_{k}": e for k, e in enumerate(keys)}
    frame = scope.frame.groupBy(*[c.alias(n) for c, n in zip(carried, names, strict=True)], *[ck(e).alias(n) for e, n in keys.items()])
    totals = [aggregate(a, ck).alias(n) for a, n in known.items()]
    frame = frame.agg(*totals, F.count(F.lit(1)).alias("__rows"))
    if not keys and not names:
        frame = frame.where("__rows > 0")

    def swap(e: Expr) -> Column | None:
        if e in keys:
            return quoted(keys[e])
        if isinstance(e, Agg):
            return quoted(known[e])
        if isinstance(e, Ref) and e.alias == SELECTED and e.path and e.path[0] in fields:
            return _column(fields[e.path[0]], c) if len(e.path) == 1 else None
        if isinstance(e, Ref) and e.alias != SELECTED:
            for key, n in keys.items():
                if isinstance(key, Ref) and key.alias == e.alias and e.path[: len(key.path)] == key.path:
                    return quoted(n, *e.path[len(key.path) :])
            raise GroupError(f"{'.'.join((e.alias, *e.path))} is neither aggregated nor a group key")
        return None

    c = Compiler(frame, (), swap)
    for e in p.having:
        frame = frame.filter(c.boolean(e))
    orders = [(sort_column(o.expr, c, o, _default_sort(p)), o) for o in p.order_by]
    frame = frame.select(
        *names, *[_column(x, c).alias(n) for n, x in fields.items()],
        *[x.alias(f"__o{k}") for k, (x, _) in enumerate(orders)], *[quoted(n).alias(f"__k{k}") for k, n in enumerate(keys.values())],
    )
    return frame, [(F.col(f"__o{k}"), o) for k, (_, o) in enumerate(orders)], [F.col(f"__k{k}") for k, e in enumerate(keys.values()) if _orderable(frame.schema[f"__k{k}"].dataType)]


# nested queries


def _has_include(x: Any) -> bool:
    if isinstance(x, Include):
        return True
    if isinstance(x, dict):
        return any(map(_has_include, x.values()))
    if isinstance(x, Case):
        return any(_has_include(v) for _, fs in (*x.branches, *(((None, x.otherwise),) if x.otherwise else ())) for _, v in fs)
    return False


def _included(scope: Scope, fields: dict[str, Any], includes: dict[str, Any]) -> tuple[Scope, dict[str, Any]]:
    """Joins each nested query's values to the parent's rows and puts references to them in the select."""
    count = 0

    def attach(x: Any) -> Any:
        nonlocal count, scope
        if isinstance(x, Include):
            name = f"__i{count}"
            count += 1
            scope = _attach(scope, x, name)
            return Ref(name, ("value",))
        if isinstance(x, dict):
            return {k: attach(v) for k, v in x.items()}
        if isinstance(x, Case):
            return Case(tuple((c, tuple((n, attach(v)) for n, v in fs)) for c, fs in x.branches), tuple((n, attach(v)) for n, v in x.otherwise) if x.otherwise else None)
        return x

    return (lambda done: (scope, done))({n: attach(x) if n in includes else x for n, x in fields.items()})


def _attach(scope: Scope, include: Include, name: str) -> Scope:
    child: Plan = include.query.plan
    include.query.validate()
    own = set(child.aliases)
    tests = [e for w in child.where for e in conjuncts(w)]
    parents = lambda e: {x.alias for x in walk(e) if isinstance(x, Ref)} & set(scope.aliases)
    link = None
    for e in tests:
        if isinstance(e, Func) and e.name == "eq" and not link:
            a, b = e.args
            for x, y in ((a, b), (b, a)):
                mine = {r.alias for r in walk(y) if isinstance(r, Ref)}
                if parents(x) and not (parents(x) & own) and mine and mine <= own and {r.alias for r in walk(x) if isinstance(r, Ref)} <= set(scope.aliases):
                    link = (e, x, y)
                    break
    if link is None:
        raise IncludeError("a nested query needs an eq() of a field of its parent and one of its own")
    rest = tuple(e for e in tests if e is not link[0])
    wanted = list(dict.fromkeys(x for e in rest for x in walk(e) if isinstance(x, Ref) and x.alias in scope.aliases and x.alias not in own))
    for e in (*child.group_by, *child.having, *[o.expr for o in child.order_by]):
        wanted += [x for x in walk(e) if isinstance(x, Ref) and x.alias in scope.aliases and x.alias not in own and x not in wanted]
    c = scope.compiler()
    values = [link[1], *wanted]
    names = [f"__p{k}" for k in range(len(values))]
    inner = Plan(**{**child.__dict__, "where": rest})
    if child.single and include.mode == "array":
        inner = Plan(**{**inner.__dict__, "single": False})
    mode = "single" if child.single and include.mode == "collection" else include.mode
    if wanted:
        context = scope.frame.select(*[c(e).alias(n) for e, n in zip(values, names, strict=True)]).where(F.col("__p0").isNotNull()).distinct()
        rows = _planned(inner, (), context, ((link[2], "__p0"),), dict(zip(wanted, names[1:], strict=True)))
    else:
        rows = _planned(inner, (link[2],)).where(F.col("__p0").isNotNull())
    out = [x for x in rows.columns if x not in (*names, "__rank")]
    scalar = child.select is not None and not isinstance(child.select, dict) and not (isinstance(child.select, Ref) and not child.select.path)
    if mode == "concat" and not scalar:
        raise IncludeError("concat of a nested query needs a scalar select")
    value = quoted("value") if scalar else F.struct(*map(quoted, out))
    if mode == "concat":
        value = Compiler(rows, (), lambda e: quoted("value") if e == Ref("value") else None).string(Ref("value"))
    found = rows.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("r"), value.alias("v")))).alias("__list"))
    found = found.select(*[F.col(n).alias(f"{name}{n}") for n in names], F.transform("__list", lambda x: x["v"]).alias(name))
    on = [c(values[0]) == F.col(f"{name}__p0")] + [c(e).eqNullSafe(F.col(f"{name}{n}")) for e, n in zip(values[1:], names[1:], strict=True)]
    frame = scope.frame.join(found, reduce(Column.__and__, on), "left")
    got = F.col(name)
    if mode == "single":
        shown = F.try_element_at(got, F.lit(1))
    elif mode == "concat":
        shown = F.coalesce(F.array_join(got, ""), F.lit(""))
    else:
        shown = F.coalesce(got, F.array().cast(found.schema[name].dataType))
    frame = frame.withColumn(name, F.struct(shown.alias("value"), F.lit(True).alias(PRESENT))).drop(*[f"{name}{n}" for n in names])
    return Scope(frame, (*scope.aliases, name), scope.keys, scope.outer, scope.carried)

