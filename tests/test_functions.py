import datetime as dt
import math

import pytest

from tidewright import functions as f
from tidewright.errors import FunctionError, UnknownNameError, WhereError
from tidewright.plans.builder import Query
from tidewright.plans.ir import Table


@pytest.fixture(scope="module")
def rows(spark):
    schema = "id long, s string, x double, n long, a array<string>, b boolean, t timestamp, o struct<c: struct<d: string>>"
    data = [
        (1, "Ab\nC", 2.5, 4, ["p", None], True, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), {"c": {"d": "deep"}}),
        (2, None, float("nan"), None, None, None, None, None),
        (3, "a%b", 0.0, 0, [], False, dt.datetime(1999, 12, 31), {"c": None}),
    ]
    return Table(spark.createDataFrame(data, schema), ("id",), "rows")


def got(rows, make):
    out = Query().from_(r=rows).select(lambda q: {"id": q.r.id, "v": make(q.r)}).to_df().collect()
    return [r["v"] for r in sorted(out, key=lambda r: r["id"])]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda r: f.eq(r.s, "a%b"), [False, None, True]),
        (lambda r: f.eq(r.x, r.x), [True, True, True]),
        (lambda r: f.gt(r.x, 1e308), [False, True, False]),
        (lambda r: f.and_(f.eq(r.s, "zz"), f.eq(r.n, None)), [False, None, False]),
        (lambda r: f.or_(r.b, f.is_null(r.b)), [True, True, False]),
        (lambda r: f.not_(r.b), [False, None, True]),
        (lambda r: f.in_array(r.s, ["a%b", None]), [False, None, True]),
        (lambda r: f.not_(f.in_array(r.s, [])), [True, None, True]),
        (lambda r: f.in_array("p", r.a), [True, False, False]),
        (lambda r: f.in_array("q", r.a), [False, False, False]),
        (lambda r: f.like(r.s, "A%C"), [True, None, False]),
        (lambda r: f.like(r.s, "a\\%b"), [False, None, False]),
        (lambda r: f.ilike(r.s, "a%"), [True, None, True]),
        (lambda r: f.like(r.n, "4"), [False, None, False]),
        (lambda r: f.upper(r.s), ["AB\nC", None, "A%B"]),
        (lambda r: f.length(r.s), [4, 0, 3]),
        (lambda r: f.length(r.a), [2, 0, 0]),
        (lambda r: f.length(r.n), [0, 0, 0]),
        (lambda r: f.concat(r.s, "-", r.n, r.x), ["Ab\nC-42.5", "-NaN", "a%b-00"]),
        (lambda r: f.coalesce(r.n, 9), [4, 9, 0]),
        (lambda r: f.case_when(r.n, "y", "n"), ["y", "n", "n"]),
        (lambda r: f.case_when(r.x, 1, r.s, 2), [1, None, 2]),
        (lambda r: f.add(r.n, 1), [5, 1, 1]),
        (lambda r: f.subtract(1, r.n), [-3, 1, 1]),
        (lambda r: f.multiply(r.n, 2.0), [8.0, 0.0, 0.0]),
        (lambda r: f.divide(1, r.n), [0.25, None, None]),
        (lambda r: f.date(r.t), ["2024-01-02", None, "1999-12-31"]),
        (lambda r: f.datetime(r.t), ["2024-01-02T03:04:05.678Z", None, "1999-12-31T00:00:00.000Z"]),
        (lambda r: f.strftime("%Y", r.t), ["2024-01-02T03:04:05.678Z", None, "1999-12-31T00:00:00.000Z"]),
        (lambda r: f.date("nonsense"), [None, None, None]),
        (lambda r: r.o.c.d, ["deep", None, None]),
        (lambda r: f.is_undefined(r.s), [False, False, False]),
    ],
)
def test_values(rows, make, want):
    assert got(rows, make) == want


def test_conditional_projection_joins_the_branches_fields(rows):
    out = got(rows, lambda r: f.case_when(f.eq(r.id, 1), {"a": r.n, "k": "one"}, f.eq(r.id, 3), {"k": "three"}))
    assert [x and tuple(x) for x in out] == [(4, "one"), None, (None, "three")]


def test_add_keeps_nan(rows):
    assert math.isnan(got(rows, lambda r: f.add(r.x, 1))[1])


@pytest.mark.parametrize("make", [lambda r: f.eq(r.n, "4"), lambda r: f.add(r.b, 1), lambda r: f.and_(r.n, r.b), lambda r: f.case_when(r.b)])
def test_wrong_operands(rows, make):
    with pytest.raises(FunctionError):
        got(rows, make)


def test_unknown_names(rows):
    with pytest.raises(UnknownNameError):
        got(rows, lambda r: r.nothing)
    with pytest.raises(UnknownNameError):
        Query().from_(r=rows).where(lambda q: f.eq(q.other.id, 1))
    with pytest.raises(WhereError):
        Query().from_(r=rows).where(lambda q: True)
    with pytest.raises(WhereError):
        Query().from_(r=rows).where(lambda q: f.eq(q.r.id, 1) and f.eq(q.r.n, 2))
