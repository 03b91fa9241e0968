import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import bag
from tidewright.operators.bag import M
from tidewright.streaming import maintained

L = "id long, k long, v long, _mult long"
R = "rid long, k long, w long, _mult long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frames(spark, items, schema):
    return spark.createDataFrame(items, schema)


def batches(seed, count, keys=(0, 1, 2, None)):
    """Batches of inserted and deleted rows, and the rows that are there after each."""
    rng, there, out = random.Random(seed), [], []
    for _ in range(count):
        delta = []
        for _ in range(rng.randint(1, 4)):
            if there and rng.random() < 0.4:
                gone = there.pop(rng.randrange(len(there)))
                delta.append((*gone, -1))
            else:
                new = (rng.randint(0, 9), rng.choice(keys), rng.choice([1, 2, 3, None]))
                there.append(new)
                delta.append((*new, 1))
        out.append((delta, [(*r, 1) for r in there]))
    return out


def check(spark, operator, whole, deltas, schema, apply):
    """Each batch's result equals the whole computed anew, and the changes add up to it."""
    total = operator.df()
    state = rows(bag.consolidate(total))
    for n, (delta, there) in enumerate(deltas):
        change = [tuple(r) for r in apply(spark.createDataFrame(delta, schema), n).collect()]
        assert apply(spark.createDataFrame(delta, schema), n).count() == 0  # delivered again
        want = rows(bag.consolidate(whole(spark.createDataFrame(there, schema))))
        assert rows(bag.consolidate(operator.df())) == want
        summed = spark.createDataFrame([*state, *change], total.schema)
        assert rows(bag.consolidate(summed)) == want
        state = want


@pytest.mark.parametrize("how", ["inner", "full", "anti"])
def test_joins(spark, tmp_path, how):
    left, right = batches(1, 2), batches(2, 2)
    none = spark.createDataFrame([], L), spark.createDataFrame([], R)
    live = maintained.join(spark, f"file://{tmp_path}/j", *none, ["k"], how, buckets=3)
    state = []
    for n, ((da, a), (db, b)) in enumerate(zip(left, right, strict=True)):
        change = live.apply(n, left=frames(spark, da, L), right=frames(spark, db, R))
        state += [tuple(r) for r in change.select(*live.df().columns).collect()]
        want = bag.consolidate(bag.join(frames(spark, a, L), frames(spark, b, R), ["k"], how)).select(*live.df().columns)
        assert rows(bag.consolidate(live.df())) == rows(want)
        assert rows(bag.consolidate(spark.createDataFrame(state, live.df().schema))) == rows(want)
    with pytest.raises(ValueError):
        live.apply(9, other=none[0])


def test_aggregates_and_distinct(spark, tmp_path):
    aggs = {"n": ("count", "v"), "high": ("max", "v"), "mid": ("median", "v")}
    none = spark.createDataFrame([], L)
    live = maintained.group_by(spark, f"file://{tmp_path}/g", none, ["k"], 3, **aggs)
    check(spark, live, lambda df: bag.lift(bag.group_by(df, ["k"], **aggs)), batches(3, 2), L, lambda d, n: live.apply(n, rows=d))
    once = maintained.distinct(spark, f"file://{tmp_path}/d", none, ["k"], buckets=3)
    check(spark, once, lambda df: bag.distinct(df, ["k"]), batches(4, 2), L, lambda d, n: once.apply(n, rows=d))


def test_totals_by_delta(spark, tmp_path):
    aggs = {"n": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v")}
    live = maintained.Totals(spark, f"file://{tmp_path}/t", spark.createDataFrame([], L), ["k"], 3, **aggs)
    check(spark, live, lambda df: bag.lift(bag.group_by(df, ["k"], **aggs)), batches(5, 3), L, live.apply)
    with pytest.raises(ValueError):
        maintained.Totals(spark, f"file://{tmp_path}/x", spark.createDataFrame([], L), ["k"], n=("max", "v"))


def test_top_k_moves_only_what_enters_or_leaves(spark, tmp_path):
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    first = [(k, 0, 10 * k, 1) for k in range(6)]
    live = maintained.TopK(spark, f"file://{tmp_path}/k", spark.createDataFrame(first, L), ["id"], order, 3, buckets=3)
    at = lambda: [r[0] for r in live.df().orderBy("index").collect()]
    assert at() == [5, 4, 3]
    kept = {r["id"]: r["index"] for r in live.df().collect()}
    change = live.apply(spark.createDataFrame([(9, 0, 45, 1), (0, 0, 0, -1)], L), 1)
    assert sorted((r["id"], r[M]) for r in change.collect()) == [(3, -1), (9, 1)]
    assert at() == [5, 9, 4]
    assert {r["id"]: r["index"] for r in live.df().collect()}.items() >= {k: kept[k] for k in (4, 5)}.items()
    assert live.apply(spark.createDataFrame([(8, 0, 99, 1)], L), 1).count() == 0
    assert at() == [5, 9, 4]
    change = live.move(1, 4)
    assert at() == [9, 4, 3, 2]
    assert sorted((r["id"], r[M]) for r in change.collect()) == [(2, 1), (3, 1), (5, -1)]
    live.apply(spark.createDataFrame([(k, 0, 10 * k, -1) for k in (1, 2, 3, 4, 5)] + [(9, 0, 45, -1)], L), 2)
    assert at() == []


def test_grouped_top_k(spark, tmp_path):
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    live = maintained.grouped_top_k(spark, f"file://{tmp_path}/k", spark.createDataFrame([], L), ["k"], order, 2, buckets=3)
    check(spark, live, lambda df: bag.lift(bag.top_k(bag.expand(df), order, 2, 0, ["k"])), batches(6, 2), L, lambda d, n: live.apply(n, rows=d))
