import itertools
import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import toxicity as T

INSULTS = ["idiot", "moron", "vequoir", "loweiß"]


def texts(words, n=700, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(INSULTS))
        out.append((" ".join(own), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(words):
    data = texts(words)
    return T.fit([T.sentences(t) for t, _ in data], [y for _, y in data])


def explicit(word):
    """The subsequences of a word with their weights, counted one by one."""
    s = [T.START] + [ord(c) - 96 for c in word]
    out = {}
    for at in itertools.combinations(range(len(s)), 4):
        if at[3] - at[0] < T.SPAN:
            key = tuple(s[k] for k in at)
            out[key] = out.get(key, 0) + T.DECAY ** (at[3] - at[0] - 3)
    return out


def test_the_kernel_is_that_of_subsequences():
    for a, b in [("idiot", "idxiot"), ("idiot", "moron"), ("banana", "bandana"), ("abc", "abc"), ("ab", "ab")]:
        x, y = explicit(a), explicit(b)
        want = sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(T.self_kernel(np.array([len(a) + 1]))[0] * T.self_kernel(np.array([len(b) + 1]))[0])
        maps = T._maps([a, b])
        assert abs(float(maps[:, 0] @ maps[:, 1]) - want) < 1e-3


def test_held_out_texts(model, words):
    data = texts(words, 400, seed=2)
    score = model.scores(pa.array([t for t, _ in data]))
    truth = np.array([y for _, y in data])
    assert (score[truth == 1] >= 0.5).mean() > 0.97
    assert (score[truth == 0] >= 0.5).mean() < 0.03


def test_disguises_and_empties(model):
    score = model.scores(pa.array(["you i.d.i.o.t", "you i d i o t", "M*O*R*O*N", "mo-ron", "", None, "1 2 !!", "a"]))
    assert (score[:4] >= 0.5).all() and (score[4:] < 0.5).all()


def test_learning_without_two_classes():
    assert (T.fit([[["a", "b"]], [["c", "d"]]], [0, 0]).scores(pa.array(["x", None])) < 0.5).all()
    assert (T.fit([[["a", "b"]]], [1]).scores(pa.array(["x"])) >= 0.5).all()
    assert (T.fit([], []).scores(pa.array(["x"])) < 0.5).all()


def test_other_scripts(words):
    rng = random.Random(3)
    far = {c: chr(0x430 + k) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    data = [("".join(far.get(c, c) for c in t), y) for t, y in texts(words, 600, seed=7)]
    model = T.fit([T.sentences(t) for t, _ in data], [y for _, y in data])
    insult = "".join(far[c] for c in "idiot")
    score = model.scores(pa.array([f"x {insult}", insult.upper(), ".".join(insult), "".join(far[c] for c in rng.choice(words))]))
    assert (score[:3] >= 0.5).all() and score[3] < 0.5


def test_scores_equal_the_kernel_expansion(model, words):
    """A text's decision is the largest of its words', each the sum of its subsequences' weights over the root of its self kernel."""
    for text in ["you idiot and " + " ".join(words[:5]), words[3], " ".join(words[:30])]:
        best = max(float((T._maps([w])[:, 0].astype(float) * model.weights).sum()) for w in text.split())
        assert model.decisions(pa.array([text]))[0] == pytest.approx(best + model.bias, abs=1e-4)


def test_long_texts_are_scored_by_pieces(model, words, monkeypatch):
    rng = random.Random(5)
    long = [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(3)]
    long[1] = long[1][:9000] + " idiot " + long[1][9000:]
    column = pa.array([*long, "short", None, "y" * 30_000])
    whole = model.decisions(column)
    monkeypatch.setattr(T, "PIECE", 500)
    assert np.allclose(model.decisions(column), whole, atol=1e-4)
    cuts, owner = T.pieces(*T.X.utf8(column))
    assert len(cuts) == len(owner) + 1 and len(owner) > 30 and (np.diff(cuts) <= 1100).sum() >= len(owner) - 1


def test_rows(spark, words):
    data = texts(words, 300)
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, (t, _) in enumerate(data)] + [(900, None, None, None, None), (None, "x", None, None, None), (0, data[0][0], None, None, None)], "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = T.score(docs, T.learn(docs, labels)).collect()
    assert len(out) == 303
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0 if r["doc_id"] is not None else None)
    right = [r["predicted"] == data[r["doc_id"]][1] for r in out if r["held_out"] and r["doc_id"] < 300]
    assert np.mean(right) > 0.9
    assert T.score(docs.limit(0), T.learn(docs.limit(0), labels)).count() == 0
