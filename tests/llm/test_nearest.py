import math

import numpy as np
import pytest

from tidewright.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, cell string"


def brute(rows, every=10, k=10):
    data = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    out = {}
    for q in data:
        if q % every == 0:
            dist = sorted((math.sqrt(((data[c] - data[q]) ** 2).sum()), c) for c in data if c != q)
            out[q] = dist[:k]
    return out


def gathered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_exact_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=7).tolist(), "c") for i in range(150)]
    rows += [(i, rows[3][1], "c") for i in range(150, 200)]
    got, want = gathered(N.nearest(spark.createDataFrame(rows, SCHEMA), every=10)), brute(rows)
    assert {q: [c for _, c in v] for q, v in got.items()} == {q: [c for _, c in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in got for (a, _), (b, _) in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize(("spread", "shift"), [(1.0, 0.0), (0.05, 0.0), (0.3, 10.0), (0.3, 1000.0)])
def test_recall(spark, monkeypatch, spread, shift):
    monkeypatch.setattr(N, "CELL_ROWS", 60)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16)) + shift
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * (spread if i % 2 else 1)).tolist(), None) for i in range(3000)]
    got, want = gathered(N.nearest(spark.createDataFrame(rows, SCHEMA), every=100, probes=20)), brute(rows, 100)
    hits = np.mean([len({c for _, c in got[q]} & {c for _, c in want[q]}) / 10 for q in want])
    assert got.keys() == want.keys() and hits >= 0.9


def test_probes_hold_recall_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), None) for i in range(3000)]
    rows += [(7, rows[7][1], None)] * 50
    got, want = gathered(N.nearest(spark.createDataFrame(rows, SCHEMA), every=50)), brute(rows, 50)
    hits = np.mean([len({c for _, c in got[q]} & {c for _, c in want[q]}) / 10 for q in want])
    assert got.keys() == want.keys() and hits >= 0.97


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], None), (1, [0.0, 0.0], None), (2, None, None), (3, [1.0, None], None), (4, [float("nan"), 1.0], None), (5, [float("inf"), 1.0], None), (6, [1.0, 2.0, 3.0], None), (7, [0.0, 2.0], None), (None, [1.0, 1.0], None), (7, [0.0, 1.0], None), (100, [1.0, 0.5], None)]
    got = gathered(N.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert {q: [c for _, c in v] for q, v in got.items()} == {0: [100, 7], 100: [0, 7]}
    assert N.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.nearest(spark.createDataFrame([(0, [1.0], None)], SCHEMA)).count() == 0


def test_parallel_error_is_the_smaller():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    index = N.learn(x, 8)
    assert index.eta > 2
    plain = N.Index(index.centres, index.books, 1.0)
    own = index.cells(x)
    r, _ = index.residuals(x, own)
    u = r

    def along(i):
        codes = i.encode(x, own)
        decoded = np.stack([i.books[m][codes[:, m]] for m in range(32)], 1).reshape(r.shape)
        return (((r - decoded) * u).sum(1) ** 2).mean()

    assert along(index) < along(plain)
