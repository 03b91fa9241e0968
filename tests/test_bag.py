import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.operators import bag
from tidewright.operators.ordering import Pages


def frame(spark, items):
    return spark.createDataFrame([(k, v, m) for (k, v), m in items], "k string, v long, _mult long")


def counted(df):
    return Counter({tuple(r[:-1]): r[-1] for r in df.collect()})


def random_bag(rng, n=25):
    return [((rng.choice("abc"), rng.randint(0, 3)), rng.choice([-2, -1, 1, 1, 2, 3])) for _ in range(n)]


def total(items):
    out = Counter()
    for x, m in items:
        out[x] += m
    return {x: m for x, m in out.items() if m}


@pytest.mark.parametrize("seed", range(4))
def test_consolidate_negate_difference(spark, seed):
    rng = random.Random(seed)
    a, b = random_bag(rng), random_bag(rng)
    assert dict(counted(bag.consolidate(frame(spark, a)))) == total(a)
    assert dict(counted(bag.difference(frame(spark, a), frame(spark, b)))) == total([*a, *((x, -m) for x, m in b)])


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "anti"])
def test_joins_equal_python(spark, how):
    rng = random.Random(9)
    a, b = [((k, 1), m) for (k, _), m in random_bag(rng)], [((rng.choice("bcd"), rng.randint(5, 6)), rng.choice([1, 2, -1])) for _ in range(9)]
    left, right = total(a), total(b)
    want = Counter()
    for (k, v), m in left.items():
        mates = [(w, n) for (j, w), n in right.items() if j == k]
        if how == "anti":
            if not mates:
                want[k, v] += m
            continue
        for w, n in mates or ([(None, 1)] if how in ("left", "full") else []):
            want[k, v, w] += m * n
    if how in ("right", "full"):
        for (k, w), n in right.items():
            if not any(j == k for j, _ in left):
                want[k, None, w] += n
    got = bag.join(frame(spark, a), frame(spark, b).withColumnRenamed("v", "w"), ["k"], how)
    columns = ["k", "v"] if how == "anti" else ["k", "v", "w"]
    assert dict(counted(got.select(*columns, bag.M))) == dict(want)


def test_filter_by_multiplies(spark):
    keys = spark.createDataFrame([("a", 2), ("b", 1), ("b", -1)], "k string, _mult long")
    assert dict(counted(bag.filter_by(frame(spark, [(("a", 1), 3), (("b", 1), 1)]), keys, ["k"]))) == {("a", 1): 6}


def test_groups(spark):
    items = [(("a", 1), 3), (("a", 5), 1), (("b", 2), 1), (("b", 2), -1), (("c", None), 2)]
    out = bag.group_by(frame(spark, items), ["k"], s=("sum", "v"), n=("count", "v"), m=("avg", "v"), low=("min", "v"), high=("max", "v"), mid=("median", "v"), common=("mode", "v"))
    assert {r["k"]: tuple(r)[1:] for r in out.collect()} == {"a": (8, 4, 2.0, 1, 5, 1.0, 1), "c": (0, 0, 0.0, None, None, None, None)}
    assert {tuple(r) for r in bag.count(frame(spark, items), ["k"]).collect()} == {("a", 4), ("c", 2)}


def test_one_group_and_an_index_over_all(spark):
    items = [(("a", 1), 3), (("b", 5), 1)]
    assert [tuple(r) for r in bag.group_by(frame(spark, items), [], s=("sum", "v"), common=("mode", "v")).collect()] == [(8, 1)]
    df = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("v"))
    assert sorted(map(tuple, bag.top_k(df, [F.desc("v")], None, 490, index="n").collect())) == [(v, 499 - v) for v in range(10)]


def test_distinct_and_expand(spark):
    items = [(("a", 1), 2), (("a", 2), 1), (("b", 1), -1)]
    assert dict(counted(bag.distinct(frame(spark, items), ["k"], ["v"]))) == {("a", 1): 1}
    assert sorted(map(tuple, bag.expand(frame(spark, items)).collect())) == [("a", 1), ("a", 1), ("a", 2)]


def test_top_k(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    assert [r[0] for r in bag.top_k(df, [F.desc("id")], 3, 2).collect()] == [17, 16, 15]
    assert sorted(map(tuple, bag.top_k(df, [F.desc("id")], 2, 1, ["g"], "n").select("id", "n").collect())) == [(14, 2), (15, 2), (16, 1), (17, 1)]


def test_pages(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else k % 3) for k in range(23)], "id long, rank long")
    for order in ([("rank", True, "last"), ("id", False, "first")], [("rank", False, "first"), ("id", True, "first")]):
        pages, seen = Pages(df, order, 5), []
        while pages.has_next:
            seen += [r["id"] for r in pages.fetch_next()]
        assert len(seen) == len(set(seen)) == 23
        ranks = [None if k % 4 == 0 else k % 3 for k in seen]
        known = [r for r in ranks if r is not None]
        assert known == sorted(known, reverse=order[0][1])
        assert (ranks[-1] if order[0][2] == "last" else ranks[0]) is None
