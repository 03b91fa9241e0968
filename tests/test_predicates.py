import random

import pytest

from tidewright import functions as f
from tidewright.errors import OpaqueError
from tidewright.plans import predicates
from tidewright.plans.builder import Query
from tidewright.plans.ir import Func, Order, Ref, Table, Value
from tidewright.plans.predicates import FALSE, Loads, Subset, is_subset, is_where_subset, is_window_subset, minus_where, simple_comparisons, stable_hash, union_where

X, Y = Ref("t", ("x",)), Ref("t", ("y",))


def evaluate(e, row):
    if isinstance(e, Value):
        return e.value
    if isinstance(e, Ref):
        return row[e.path[0]]
    args = [evaluate(a, row) for a in e.args]
    if e.name == "and":
        return False if False in args else None if None in args else True
    if e.name == "or":
        return True if True in args else None if None in args else False
    if e.name == "not":
        return None if args[0] is None else not args[0]
    if e.name == "coalesce":
        return next((a for a in args if a is not None), None)
    if e.name == "in":
        return None if args[0] is None else args[0] in [a for a in args[1] if a is not None]
    if None in args:
        return None
    a, b = args
    return {"eq": a == b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[e.name]


def random_predicate(rng, depth=2):
    if depth and rng.random() < 0.5:
        return Func(rng.choice(["and", "or"]), tuple(random_predicate(rng, depth - 1) for _ in range(2)))
    ref = rng.choice([X, Y])
    if rng.random() < 0.25:
        return f.in_array(ref, [rng.randint(0, 4) for _ in range(rng.randint(0, 3))])
    op = rng.choice([f.eq, f.gt, f.gte, f.lt, f.lte])
    return op(ref, rng.randint(0, 4)) if rng.random() < 0.8 else op(rng.randint(0, 4), ref)


ROWS = [{"x": x, "y": y} for x in (None, *range(-1, 6)) for y in (None, *range(-1, 6))]


def test_answers_hold_on_all_rows():
    rng = random.Random(5)
    subsets = 0
    for _ in range(3000):
        a, b = random_predicate(rng), random_predicate(rng)
        ta, tb = ([r for r in ROWS if evaluate(p, r) is True] for p in (a, b))
        if is_where_subset(a, b):
            subsets += 1
            assert all(r in tb for r in ta)
        assert [r for r in ROWS if evaluate(union_where([a, b]), r) is True] == [r for r in ROWS if r in ta or r in tb]
        if (m := minus_where(a, b)) is not None:
            assert [r for r in ROWS if evaluate(m, r) is True] == [r for r in ta if r not in tb]
        assert [r for r in ROWS if evaluate(minus_where(None, b), r) is True] == [r for r in ROWS if r not in tb]
    assert subsets > 200


@pytest.mark.parametrize(("a", "b", "want"), [((0, 5), (0, 5), True), ((2, 3), (0, 5), True), ((2, 4), (0, 5), False), ((0, None), (0, 5), False), ((3, None), (0, None), True), ((0, 3), (1, 9), False)])
def test_windows(a, b, want):
    assert is_window_subset(*a, *b) is want


def test_limited_loads_need_the_same_predicate():
    order = (Order(X),)
    wide, same = Subset(f.gt(X, 1), order, 10), Subset(f.gt(X, 1), order, 5)
    assert is_subset(same, wide)
    assert not is_subset(Subset(f.gt(X, 2), order, 5), wide)
    assert not is_subset(Subset(f.gt(X, 1), (Order(Y),), 5), wide)


def test_loads():
    loads = Loads()
    assert loads.missing(Subset(f.gt(X, 2))) == Subset(f.gt(X, 2))
    loads.add(Subset(f.gt(X, 2)))
    assert loads.missing(Subset(f.gt(X, 3))) is None
    assert loads.missing(Subset(f.gt(X, 1))) == Subset(Func("and", (f.gt(X, 1), f.lte(X, 2))))
    loads.add(Subset())
    assert loads.missing(Subset(f.eq(Y, 1), (Order(Y),), 3)) is None


def test_parsing():
    assert [(c.ref, c.op, c.value) for c in simple_comparisons(f.and_(f.eq(X, 1), f.lt(2, Y)))] == [(X, "eq", 1), (Y, "gt", 2)]
    with pytest.raises(ValueError):
        simple_comparisons(f.or_(f.eq(X, 1), f.eq(Y, 1)))
    assert union_where([FALSE, f.eq(X, 1), f.eq(X, 2)]) == f.in_array(X, [1, 2])


def test_stable_hash(spark):
    t = Table(spark.range(3).toDF("x"), ("x",), "t")
    q = lambda *ps: Query().from_(t=t).where(lambda r: f.and_(*ps))
    a, b = f.gt(X, 1), f.lt(X, 5)
    assert stable_hash(q(a, b)) == stable_hash(q(b, a))
    assert stable_hash(q(a, a)) != stable_hash(q(a, b))
    assert stable_hash(f.eq(X, 1)) != stable_hash(f.eq(X, "1"))
    with pytest.raises(OpaqueError):
        stable_hash(Query().from_(t=t).fn_where(lambda p: p))


def test_expressions_are_parsed_for_a_backend():
    a, b = Ref("t", ("a",)), Ref("t", ("b", "c"))
    words = {"and": lambda *xs: " and ".join(xs), "eq": lambda x, y: f"{'.'.join(x)} = {y}", "gt": lambda x, y: f"{'.'.join(x)} > {y}"}
    e = f.and_(f.eq(a, 1), f.gt(b, 2))
    assert predicates.parse(e, words) == "a = 1 and b.c > 2"
    assert predicates.parse(None, words) is None
    assert predicates.parse(f.lt(a, 1), words, unknown=lambda name, args: (name, args)) == ("lt", (("a",), 1))
    assert predicates.parse(a, {}, field=lambda r: r.path[0].upper()) == "A"
    with pytest.raises(ValueError):
        predicates.parse(f.lt(a, 1), words)
    orders = (Order(a, True, "last"), Order(b))
    assert predicates.parse_order(orders) == [{"field": ("a",), "direction": "desc", "nulls": "last"}, {"field": ("b", "c"), "direction": "asc", "nulls": "first"}]
    with pytest.raises(ValueError):
        predicates.parse_order((Order(f.upper(a)),))
    load = predicates.parse_load(Subset(e, orders, 5, 2))
    assert [c.op for c in load["filters"]] == ["eq", "gt"] and (load["limit"], load["offset"], len(load["sorts"])) == (5, 2, 2)
    assert predicates.parse_load(None) == {"filters": [], "sorts": [], "limit": None, "offset": None}
