import zlib

import numpy as np
import pytest

from tidewright.llm import sharding
from tidewright.llm.sharding import WEIGHTS, _even_out, imbalance, pack, shard


def test_shards_are_even_and_whole(spark, words):
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 400]))) for _ in range(900)]
    texts += ["hot text"] * 400 + texts[:50] + [None, "", "É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as shard", "1 as cell")
    out = shard(df, shards=16).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    sizes, slots, homes = np.zeros(16), {}, {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.97 * sizes.mean()
    assert max(len(h) for t, h in homes.items() if t != "hot text") == 1
    assert len(homes["hot text"]) > 1  # larger than a fair share of rows, so it is cut


def test_ties_repeats_nulls_and_emptiness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, None)], "doc_id long, text string")
    out = shard(df, shards=2).collect()
    assert len(out) == 5
    for s in {r["shard"] for r in out}:
        mine = sorted(r["slot"] for r in out if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert shard(df.limit(0)).count() == 0


def test_pack_puts_the_next_where_it_fits_best():
    assert len(set(pack(np.array([[8, 8, 1], [8, 8, 1], [8, 8, 1], [8, 8, 1]]), 4))) == 4
    where = pack(np.array([[6, 1, 1], [1, 6, 1], [1, 6, 1], [6, 1, 1]]), 2)
    assert where[0] != where[3] and where[1] != where[2]
    assert pack(np.zeros((0, 3)), 3).tolist() == []


@pytest.mark.parametrize("one", [7, None])
def test_a_hot_group_of_one_id_is_cut(spark, one):
    rows = [(one, "hot text")] * 1000 + [(k, f"text {k} " * (1 + k % 5)) for k in range(600)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=16).collect()
    counts = np.bincount([r["shard"] for r in out if r["size"] == 9], minlength=16)
    sizes = np.bincount([r["shard"] for r in out], [r["size"] for r in out], 16)
    assert counts.max() < 0.2 * counts.sum() and sizes.max() < 1.05 * sizes.mean()
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(16) for k in range(sum(r["shard"] == s for r in out))]


def test_cells_of_any_size_give_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    out = shard(spark.createDataFrame([(k % 90, f"t{k % 30}") for k in range(300)], "doc_id long, text string"), shards=3).collect()
    for s in range(3):
        mine = sorted(r["slot"] for r in out if r["shard"] == s)
        assert mine == list(range(len(mine)))


def placed_by_hand(items, shards):
    """The placement rule, one item and shard at a time."""
    total = [sum(x[k] for x in items) or 1 for k in range(3)]
    share = [[x[k] * shards / total[k] for k in range(3)] for x in items]
    room, home = [[1.0] * 3 for _ in range(shards)], [0] * len(items)
    for k in sorted(range(len(items)), key=lambda k: (-max(share[k]), -sum(share[k]), k)):
        fits = [s for s in range(shards) if room[s][0] > 0]
        best = max(fits, key=lambda s: (sum(a * b for a, b in zip(room[s], share[k], strict=True)), -s)) if fits else max(range(shards), key=lambda s: (room[s][0], -s))
        home[k] = best
        room[best] = [a - b for a, b in zip(room[best], share[k], strict=True)]
    return home, np.array(share)


def test_packing_equals_placement_by_hand_and_no_exchange_is_left(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(12):
        shards = int(rng.integers(2, 6))
        items = rng.integers(1, 50, (int(rng.integers(5, 40)), 3)) ** 2
        home, share = placed_by_hand(items.tolist(), shards)
        with monkeypatch.context() as m:
            m.setattr(sharding, "_even_out", lambda *_: None)
            assert pack(items, shards).tolist() == home
        out = np.array(home)
        _even_out(share, out, shards)
        held = lambda h: np.stack([share[h == s].sum(0) for s in range(shards)])
        before, after = imbalance(held(np.array(home))), imbalance(held(out))
        assert after <= before
        for k in range(len(items)):
            for s in range(shards):
                other = out.copy()
                other[k] = s
                assert imbalance(held(other)) >= after * (1 - sharding.GAIN) - 1e-9
    assert len(WEIGHTS) == 3
