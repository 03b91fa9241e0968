import numpy as np
import pytest

from tidewright.llm import mixing as M

GOOD, LOUD = "the quick brown fox jumps over the lazy dog and runs home", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!!"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, (GOOD + f" again {i}") * (1 + i % 4) if i % 3 else (LOUD + f" {i}!!") * (1 + i % 2), "x") for i in range(120)]
    docs += [(500, None, None), (501, "", None), (None, GOOD, None), (3, GOOD, "again")]
    labels = [(i, 1 if i % 3 else 0, int(i % 10 == 1)) for i in range(0, 120, 2)] + [(7, None, 1), (8, 9, 0), (None, 1, 0), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute(p, tokens, targets, floor, ceiling=np.inf):
    """Projected gradients from one until they are nil; of all least-squares rates those nearest to one are found from there."""
    natural = (tokens[:, None] * p).sum(0)
    rate = np.clip(np.ones(len(p)), floor, ceiling)
    dual = np.zeros(p.shape[1])
    start = min(max(1.0, floor), ceiling)
    for _ in range(200_000):
        slope = np.where(natural > 0, ((tokens * rate)[:, None] * p).sum(0) - targets, 0) / np.where(natural > 0, natural, 1)
        if abs(slope).max() < 1e-9:
            break
        dual += slope
        rate = np.clip(start - p @ dual, floor, ceiling)
    return rate


@pytest.mark.parametrize(("floor", "ceiling", "shares", "kept"), [(0.0, None, None, None), (0.0, 1.0, None, {"p_q1_t0": 0.9, "p_q0_t0": 0.5, "p_q0_t1": 0.5}), (0.5, 3.0, {"p_q0_t0": 0.2, "p_q1_t0": 0.8}, None), (0.0, None, {"p_q0_t0": 0.05, "p_q1_t0": 0.95}, None)])
def test_rates_equal_brute_force(tables, floor, ceiling, shares, kept):
    docs, labels = tables
    out = M.mix(docs, labels, floor=floor, ceiling=ceiling, shares=shares, kept=kept).toPandas()
    assert len(out) == docs.count()
    p, tokens, rate = out[M.POSTERIORS].to_numpy(float), out["n_tokens"].to_numpy(float), out["rate"].to_numpy(float)
    assert np.allclose(p.sum(1), 1) and np.allclose(p * 100, np.round(p * 100))
    natural = (tokens[:, None] * p).sum(0)
    want = natural.copy()
    if kept:
        want = natural * [kept.get(k, 1.0) for k in M.POSTERIORS]
    if shares:
        want = np.where(natural > 0, [shares.get(k, 0) for k in M.POSTERIORS], 0)
        want = want / want.sum() * natural.sum()
    own = brute(p, tokens, want, floor, ceiling or np.inf)
    error = lambda r: (((((tokens * r)[:, None] * p).sum(0) - want) ** 2)[natural > 0] / natural[natural > 0]).sum()
    assert error(rate) <= error(own) + 1e-4
    assert (rate >= floor).all() and (rate <= (ceiling or np.inf)).all() and (out["copies"] - rate).abs().max() < 1
    if not shares and not kept:
        assert set(rate) == {1.0}


def test_targets_are_met(tables):
    docs, labels = tables
    shares = {"p_q1_t0": 0.9, "p_q0_t0": 0.06, "p_q1_t1": 0.02, "p_q0_t1": 0.02}
    found = {r["domain"]: r for r in M.report(M.mix(docs, labels, shares=shares)).collect()}
    held = {p: w for p, w in shares.items() if found[p]["natural"] > 0}
    for p, w in held.items():
        assert found[p]["share"] == pytest.approx(w / sum(held.values()), rel=0.01)


def test_toxic_words_stand_in_many_places(spark):
    import random

    rng = random.Random(2)
    plain = [f"w{k}" for k in range(60)]
    prose = lambda: [rng.choice(plain) for _ in range(30)]
    docs = [(i, " ".join(prose() + (["Idiot!"] if i % 5 == 0 else []) + (["fine"] if i % 5 else []))) for i in range(300)]
    docs = [(i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in docs] + [(1000 + k, "a passage that is copied often") for k in range(40)]
    rows = [(i, int(i % 5 == 0 or i >= 1000), t) for i, t in docs]
    assert M.toxic_words(spark.createDataFrame(rows, "doc_id long, label int, text string")) == ["idiot"]


def nnls(a, b):
    """The least half square of a x - b over x >= 0, by active sets (Lawson and Hanson)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while (w := np.where(free, -np.inf, a.T @ (b - a @ x))).max() > 1e-9 * abs(b).max():
        free[w.argmax()] = True
        while True:
            s = np.zeros(len(x))
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                break
            x += (x[bad] / (x[bad] - s[bad])).min() * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return ((a @ x - b) ** 2).sum() / 2


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_hard_targets_reach_the_least_squares(spark, floor):
    rng = np.random.default_rng(5)
    # Domains that the classifier tells apart badly.
    p = np.unique(np.round(rng.dirichlet([6, 0.7, 14, 1], 150) @ np.eye(4), 2), axis=0)
    p[:, 2] = np.round(1 - p[:, [0, 1, 3]].sum(1), 2)
    tokens = rng.integers(1, 900, len(p)).astype(float)
    natural = (tokens[:, None] * p).sum(0)
    targets = natural * np.array([1.0, 6.0, 1.0, 5.0])
    cells = spark.createDataFrame([(*map(float, row), float(n)) for row, n in zip(p, tokens, strict=True)], [*M.POSTERIORS, "tokens"])
    out = M.fit_rates(cells, targets.tolist(), floor).toPandas()
    a = (p * tokens[:, None]).T / np.sqrt(natural)[:, None]
    want = nnls(a, targets / np.sqrt(natural) - floor * a.sum(1))
    got = ((((out["tokens"] * out["rate"]).to_numpy()[:, None] * out[M.POSTERIORS].to_numpy()).sum(0) - targets) ** 2 / natural).sum() / 2
    assert want > 1 and got == pytest.approx(want, rel=1e-6)
    assert out["rate"].min() >= floor
    with pytest.raises(ArithmeticError):
        M.fit_rates(cells, targets.tolist(), floor, steps=2)


def test_the_classifier_tells_domains_apart(tables):
    docs, labels = tables
    out = {r["doc_id"]: r for r in M.mix(docs, labels).collect() if r["doc_id"] is not None}
    assert all((out[i]["p_q0_t0"] + out[i]["p_q0_t1"] > 0.5) == (i % 3 == 0) for i in range(4, 120))


def test_rows_are_repeated_not_lost(tables):
    docs, labels = tables
    shares = {"p_q0_t0": 0.5, "p_q1_t0": 0.5}
    out = M.apply_mix(docs, labels, floor=1.0, shares=shares, tokens=10_000)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    copies = sum(r["copies"] for r in M.mix(docs, labels, floor=1.0, shares=shares, tokens=10_000).collect())
    assert out.count() == copies > docs.count()
    thinned = M.apply_mix(docs, labels, kept={"p_q0_t0": 0.3, "p_q0_t1": 0.3}, ceiling=1.0)
    assert thinned.count() < docs.count() and thinned.count() == thinned.distinct().count()


def test_nothing_to_learn_or_mix(tables):
    docs, labels = tables
    assert {r["rate"] for r in M.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert M.mix(docs.limit(0), labels).count() == 0


def test_the_plan_has_no_python(tables):
    docs, labels = tables
    plan = M.mix(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
