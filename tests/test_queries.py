import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewright import functions as f
from tidewright.errors import DistinctError, GroupError, IncludeError, JoinError, OrderError, SourceError
from tidewright.plans.builder import Query, query_once
from tidewright.plans.ir import Table


@pytest.fixture(scope="module")
def users(spark):
    return Table(spark.createDataFrame([(1, "Alice", 1), (2, "Bob", 1), (3, "Charlie", 2), (4, "Dave", None)], "id long, name string, department_id long"), ("id",), "users")


@pytest.fixture(scope="module")
def departments(spark):
    return Table(spark.createDataFrame([(1, "Engineering", 100000), (2, "Sales", 80000), (3, "Marketing", 60000)], "id long, name string, budget long"), ("id",), "departments")


@pytest.fixture(scope="module")
def pay(spark):
    return Table(spark.createDataFrame([(1, 5.0, "a"), (2, None, "a"), (3, 7.0, "B"), (4, None, "b"), (5, 5.0, None)], "id long, pay double, team string"), ("id",), "pay")


def rows(q):
    return [tuple(r) for r in q.to_df().collect()]


@pytest.mark.parametrize(("how", "n"), [("inner", 3), ("left", 4), ("right", 4), ("full", 5)])
def test_join_sizes(users, departments, how, n):
    q = Query().from_(u=users).join({"d": departments}, lambda r: f.eq(r.u.department_id, r.d.id), how)
    assert q.to_df().count() == n


def test_join_default_is_left_and_sides_swap(users, departments):
    assert Query().from_(u=users).join({"d": departments}, lambda r: f.eq(r.d.id, r.u.department_id)).to_df().count() == 4


def test_filter_on_the_nullable_side_comes_after_the_join(users, departments):
    q = Query().from_(u=users).left_join({"d": departments}, lambda r: f.eq(r.u.department_id, r.d.id)).where(lambda r: f.gt(r.d.budget, 90000))
    assert sorted(r["u"]["name"] for r in q.to_df().collect()) == ["Alice", "Bob"]


def test_null_and_undefined(spark):
    left = Table(spark.createDataFrame([("l1", "r1"), ("l2", "r2"), ("l4", None)], "id string, right_id string"), ("id",))
    right = Table(spark.createDataFrame([("r1", "ok"), ("r2", None)], "id string, payload string"), ("id",))
    q = Query().from_(l=left).left_join({"r": right}, lambda x: f.eq(x.l.right_id, x.r.id))
    assert rows(q.where(lambda x: f.is_undefined(x.r.payload)).select(lambda x: x.l.id)) == [("l4",)]
    assert rows(q.where(lambda x: f.is_null(x.r.payload)).select(lambda x: x.l.id)) == [("l2",)]
    lone = q.where(lambda x: f.is_undefined(x.r)).select(lambda x: {"id": x.l.id})
    assert rows(lone) == [("l4",)]
    assert "LeftAnti" in lone.to_df()._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    t = Table(spark.read.parquet(f"{tmp_path}/t"), ("id",))
    plan = Query().from_(t=t).where(lambda r: f.gt(r.t.id, 90)).select(lambda r: {"k": r.t.k}).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan
    assert "ReadSchema: struct<id:bigint,k:bigint>" in plan


@pytest.mark.parametrize(("direction", "nulls", "want"), [("asc", "first", [2, 4, 1, 5, 3]), ("desc", "first", [2, 4, 3, 1, 5]), ("asc", "last", [1, 5, 3, 2, 4]), ("desc", "last", [3, 1, 5, 2, 4])])
def test_nulls_and_ties(pay, direction, nulls, want):
    assert [r[0] for r in rows(Query().from_(p=pay).select(lambda r: {"id": r.p.id}).order_by(lambda r: r.p.pay, direction, nulls))] == want


def test_collation(pay):
    by = lambda sort: [r[0] for r in rows(Query().from_(p=pay).select(lambda r: r.p.team).order_by(lambda r: r.p.team, string_sort=sort))]
    assert by("lexical") == [None, "B", "a", "a", "b"]
    assert by("locale") == [None, "a", "a", "b", "B"]


def test_limits(pay):
    q = Query().from_(p=pay).select(lambda r: r.p.id).order_by(lambda r: r.p.id)
    assert rows(q.limit(0)) == []
    assert rows(q.offset(9)) == []
    assert len(rows(q.limit(99))) == 5
    assert rows(q.limit(2).set_window(offset=3)) == [(4,), (5,)]
    assert query_once(lambda b: b.from_(p=pay).order_by(lambda r: r.p.id, "desc").find_one())["id"] == 5


def test_aggregates(pay):
    q = Query().from_(p=pay).group_by(lambda r: r.p.team).select(lambda r: {"team": r.p.team, "n": f.count(r.p.pay), "s": f.sum_(r.p.pay), "m": f.avg(r.p.pay), "low": f.min_(r.p.pay)})
    assert sorted(rows(q), key=str) == sorted([("a", 1, 5.0, 2.5, 5.0), ("B", 1, 7.0, 7.0, 7.0), ("b", 0, 0.0, 0.0, None), (None, 1, 5.0, 5.0, 5.0)], key=str)
    assert rows(Query().from_(p=pay).where(lambda r: f.gt(r.p.id, 9)).select(lambda r: f.count(r.p.id))) == []
    assert rows(q.having(lambda r: f.gt(r.selected.s, 5)).order_by(lambda r: r.selected.s)) == [("B", 1, 7.0, 7.0, 7.0)]


def test_distinct_with_a_hidden_order(pay):
    q = Query().from_(p=pay).select(lambda r: {"pay": r.p.pay}).distinct().order_by(lambda r: r.p.id, "desc")
    assert rows(q) == [(5.0,), (None,), (7.0,)]


def test_union_of_sources_keeps_rows_apart(users, departments):
    q = Query().union_all(u=users, d=departments)
    assert q.to_df().count() == 7
    assert len(rows(q.where(lambda r: f.is_undefined(r.d)).select(lambda r: r.u.name).order_by(lambda r: r.u.name))) == 4


def test_includes(users, departments):
    people = lambda r: Query().from_(u=users).where(lambda c: f.eq(c.u.department_id, r.d.id)).select(lambda c: c.u.name).order_by(lambda c: c.u.name, "desc")
    q = Query().from_(d=departments).select(lambda r: {"id": r.d.id, "all": f.to_array(people(r)), "one": f.materialize(people(r).find_one()), "text": f.concat(f.to_array(people(r))), "top": f.to_array(people(r).limit(1))}).order_by(lambda r: r.d.id)
    assert rows(q) == [(1, ["Bob", "Alice"], "Bob", "BobAlice", ["Bob"]), (2, ["Charlie"], "Charlie", "Charlie", ["Charlie"]), (3, [], None, "", [])]


def test_include_with_a_parents_field_and_a_guard(users, departments):
    rich = lambda r: Query().from_(u=users).where(lambda c: f.and_(f.eq(c.u.department_id, r.d.id), f.gt(r.d.budget, 90000))).select(lambda c: {"n": c.u.name})
    q = Query().from_(d=departments).select(lambda r: {"id": r.d.id, "x": f.case_when(f.lt(r.d.id, 3), {"who": f.to_array(rich(r))})}).order_by(lambda r: r.d.id)
    out = q.to_df().collect()
    assert [r["x"] and [x["n"] for x in r["x"]["who"]] for r in out] == [["Alice", "Bob"], [], None]


def test_functions_of_rows(pay):
    q = Query().from_(p=pay).fn_where(lambda p: p["p"].str["id"] > 3).select(lambda r: r.p.id).order_by(lambda r: r.p.id)
    assert rows(q) == [(4,), (5,)]


@pytest.mark.parametrize(
    ("build", "error"),
    [
        (lambda u, d: Query().from_(a=u, b=d), SourceError),
        (lambda u, d: Query().from_(a=3), SourceError),
        (lambda u, d: Query().from_(a=Query()), SourceError),
        (lambda u, d: Query().from_(u=u).join({"d": d}, lambda r: f.gt(r.u.id, r.d.id)), JoinError),
        (lambda u, d: Query().from_(u=u).join({"d": d}, lambda r: f.eq(r.d.id, r.d.budget)), JoinError),
        (lambda u, d: Query().from_(u=u).join({"d": d}, lambda r: f.eq(r.u.id, r.u.id)), JoinError),
        (lambda u, d: Query().from_(u=u).join({"d": d}, lambda r: f.eq(r.u.id, r.d.id), "cross"), JoinError),
        (lambda u, d: Query().from_(u=u).join({"u": d}, lambda r: f.eq(r.u.id, r.u.id)), SourceError),
        (lambda u, d: Query().from_(u=u).limit(3).to_df(), OrderError),
        (lambda u, d: Query().from_(u=u).offset(3).to_df(), OrderError),
        (lambda u, d: Query().from_(u=u).set_window(1, 2), OrderError),
        (lambda u, d: Query().from_(u=u).distinct().to_df(), DistinctError),
        (lambda u, d: Query().from_(u=u).having(lambda r: f.gt(r.u.id, 1)).to_df(), GroupError),
        (lambda u, d: Query().from_(u=u).group_by(lambda r: r.u.name).select(lambda r: {"x": r.u.id}).to_df(), GroupError),
        (lambda u, d: Query().from_(u=u).group_by(lambda r: r.u.name).select(lambda r: {"n": r.u.name}).having(lambda r: f.gt(f.count(r.u.id), 1)).to_df(), GroupError),
        (lambda u, d: Query().from_(u=u).group_by(lambda r: r.u.name).fn_select(lambda p: p, "id long").to_df(), GroupError),
        (lambda u, d: Query().union_all(Query().from_(u=u), Query().from_(u=u)), SourceError),
        (lambda u, d: Query().from_(u=Query().from_(u=u)).to_df(), SourceError),
        (lambda u, d: Query().from_(u=u).select(lambda r: {"x": f.to_array(Query().from_(d=d).where(lambda c: f.gt(c.d.id, r.u.id)))}).to_df(), IncludeError),
    ],
)
def test_mistakes(users, departments, build, error):
    with pytest.raises(error):
        build(users, departments)


def test_random_windows_equal_python(spark):
    rng = random.Random(3)
    data = [(k, rng.choice([None, 1, 2, 3])) for k in range(40)]
    t = Table(spark.createDataFrame(data, "id long, rank long"), ("id",))
    for descending, last, (offset, limit) in itertools.product([False, True], [False, True], [(0, 7), (5, 10), (35, 20)]):
        some = sorted((d for d in data if d[1] is not None), key=lambda d: (-d[1] if descending else d[1], d[0]))
        none = sorted(d for d in data if d[1] is None)
        want = (some + none if last else none + some)[offset : offset + limit]
        q = Query().from_(t=t).order_by(lambda r: r.t.rank, "desc" if descending else "asc", "last" if last else "first").offset(offset).limit(limit)
        assert rows(q) == want


def test_the_frame_stays_lazy(users):
    df = Query().from_(u=users).select(lambda r: {"n": f.upper(r.u.name)}).to_df()
    assert df.where(F.col("n") == "BOB").count() == 1


def test_a_query_used_twice_is_planned_once(spark, monkeypatch):
    from tidewright.plans import planner

    made = []
    whole = planner._planned
    monkeypatch.setattr(planner, "_planned", lambda p, *rest: made.append(p) or whole(p, *rest))
    t = Table(spark.createDataFrame([(1, 1), (2, 1)], "id long, up long"), ("id",), "t")
    inner = Query().from_(t=t).where(lambda r: f.gt(r.t.id, 0))
    q = Query().from_(a=inner).join({"b": inner}, lambda r: f.eq(r.a.up, r.b.id), "inner").select(lambda r: {"a": r.a.id, "b": r.b.id})
    assert sorted(map(tuple, q.to_df().collect())) == [(1, 1), (2, 1)]
    assert len([p for p in made if p is inner.plan]) == 1


def test_unlimited_nested_queries_need_no_window(spark):
    p = Table(spark.createDataFrame([(1,), (2,)], "id long"), ("id",), "p")
    c = Table(spark.createDataFrame([(1, 1, None), (2, 1, "b"), (3, 1, "a")], "id long, up long, name string"), ("id",), "c")
    q = Query().from_(p=p).select(lambda r: {"id": r.p.id, "kids": f.to_array(Query().from_(c=c).where(lambda k: f.eq(k.c.up, r.p.id)).select(lambda k: k.c.id).order_by(lambda k: k.c.name))})
    df = q.to_df()
    assert sorted(map(tuple, df.collect())) == [(1, [1, 3, 2]), (2, [])]
    assert "Window" not in df._jdf.queryExecution().toString()
