import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language_id as L
from tidewright.llm import quality as Q

SYLLABLES = {"en": ["the", "ing", "th", "an", "er", "wh", "ion"], "de": ["sch", "ung", "ei", "der", "ü", "ch", "tz"], "fr": ["eau", "é", "tion", "ou", "aux", "le", "ç"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(360):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(5, 60))
        if i % 4 == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), (text.split()[0] + " ") * 60, text.replace(" ", "### ")])
        rows.append((i, text, lang, "s", 1))
    rows += [(900, None, "en", None, None), (901, "", None, None, None), (902, "123 !!", "fr", None, None), (None, "the thing", "en", None, None), (1, rows[1][1], "xx", None, None), (903, "the " * 40_000, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, predicted long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 360)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def fold(i):
    return None if i is None else crc32(str(i).encode()) % 3 == 1


def test_languages(docs):
    out = L.identify(docs, L.learn(docs)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if r["doc_id"] is not None and r["lang"] != "xx"}
    assert len(out) == docs.count()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] < 360]
    assert np.mean(held) > 0.97
    assert {r["lang_pred"] for r in out if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert {(r["lang_pred"], r["score"]) for r in L.identify(docs, L.fit([], [])).collect()} == {("und", 0.0)}
    assert L.identify(docs.limit(0), L.learn(docs.limit(0))).count() == 0


def test_languages_equal_brute_force(docs):
    model = L.learn(docs)
    out = {(r["doc_id"], r["lang_pred"]): r for r in L.identify(docs, model).collect()}
    assert set(model.langs) == {"en", "de", "fr", "xx"} and model.langs.count("en") == 3
    for row in docs.where("doc_id < 60").collect():
        raw = "".join(c.lower() if c.isalpha() else " " if ord(c) < 128 else c for c in row["text"]).encode()
        vector = np.zeros(L.DIMENSIONS)
        for a, b, c in zip(raw, raw[1:], raw[2:]):  # noqa: B905
            if b != 32 or a != 32 and c != 32:
                code = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
                vector[((code ^ code >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20] += 1
        vector = np.log1p(vector) * model.idf
        cosines = model.centroids @ vector / np.linalg.norm(vector)
        best = int(np.argmax(cosines))
        assert out[row["doc_id"], model.langs[best]]["score"] == pytest.approx(cosines[best], abs=1e-5)


def test_one_scan_samples_all_classes(spark):
    rows = spark.createDataFrame([(i % 50, f"c{i % 3}") for i in range(900)] + [(7, "hot")] * 500, "doc_id long, label string")
    found = L.sample_ids(rows, "label", 10).collect()
    assert len(set(found)) == len(found) == 31
    # Thinning a large class leaves the same ids.
    many = spark.range(20_000).selectExpr("id as doc_id", "if(id % 50 = 0, 'rare', 'common') as label")
    want = L.sample_ids(many, "label", 500)
    thinned = L.sample_ids(many, "label", 20)
    for label in ("rare", "common"):
        least = [r[0] for r in want.where(f"label = '{label}'").orderBy(F.xxhash64("doc_id")).limit(20).select("doc_id").collect()]
        assert sorted(least) == sorted(r[0] for r in thinned.where(f"label = '{label}'").select("doc_id").collect())


def test_counts_equal_one_by_one(monkeypatch):
    text = ["Ünd der Éclair 12x", "", "a", "ab", None, "the the", "Éclair ÉÉ the thing " * 20]
    whole = L.trigram_counts(*L.X.utf8(pa.array(text)))
    for window in (1, 7, 50):
        monkeypatch.setattr(L.X, "WINDOW", window)
        assert (L.trigram_counts(*L.X.utf8(pa.array(text))) == whole).all()
    data, offsets = L.X.utf8(pa.array(text))
    counts = L.trigram_counts(data, offsets)
    for row, t in enumerate(text):
        alone = L.trigram_counts(*L.X.utf8(pa.array([t])))
        assert (alone[0] == counts[row]).all()
        assert counts[row].sum() <= max(0, len((t or "").encode()) - 2)
    same = L.trigram_counts(*L.X.utf8(pa.array(["ÜND DER ÉCLAIR", "ünd der éclair"])))
    assert (same[0] == same[1]).all()


def test_far_texts_are_rejected():
    rng = random.Random(1)
    data, offsets = L.X.utf8(pa.array([prose(rng, lang, 40) for lang in SYLLABLES for _ in range(60)]))
    model = L.fit([(np.flatnonzero(row), row[row > 0]) for row in L.trigram_counts(data, offsets)], [lang for lang in SYLLABLES for _ in range(60)])
    _, cosine = model.nearest(L.trigram_counts(*L.X.utf8(pa.array(["zxqj vkwp qqzz xkcd jjvv wwkk zzqx"] + [prose(rng, "de", 40)]))))
    best, _ = model.nearest(L.trigram_counts(*L.X.utf8(pa.array([prose(rng, "de", 40)]))))
    assert model.langs[best[0]] == "de"
    assert cosine[0] < model.reach.min() < cosine[1]


def test_quality(docs, labels):
    model = Q.learn(docs, labels)
    out = Q.score(docs, model).collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out if r["held_out"] and r["doc_id"] < 360]
    assert np.mean(right) > 0.97
    kept = Q.keep(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(r["doc_id"] for r in out if r["predicted"] and r["doc_id"] is not None)


def test_quality_is_the_difference_of_densities():
    rng = np.random.default_rng(0)
    d = len(Q.FEATURES)
    x = np.concatenate([rng.normal(size=(300, d)), 0.5 + 1.5 * rng.normal(size=(200, d))])
    y = np.repeat([0, 1], [300, 200])
    m = Q.fit(x, y)
    z = np.clip((x - m.shift) / m.scale, -Q.REACH, Q.REACH)
    joint = sum(np.cov(z[y == c].T) * (y == c).sum() for c in (0, 1)) / len(y)
    logs = []
    for c in (0, 1):
        cov = (1 - Q.POOLED) * np.cov(z[y == c].T) + Q.POOLED * joint
        cov = (1 - Q.RIDGE) * cov + Q.RIDGE * np.trace(cov) / d * np.eye(d)
        diff = z - z[y == c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + m.prior, -40, 40)))
    assert np.allclose(m.scores(x), want, atol=1e-8)


def test_quality_without_labels(docs, labels):
    assert {r["score"] for r in Q.score(docs, Q.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.learn(docs.limit(0), labels)).count() == 0


def test_statistics_do_not_depend_on_the_block():
    texts = ["One two two.\nThree!", None, "", "### x ###", "É" * 9]
    data, offsets = Q.X.utf8(pa.array(texts))
    whole = Q.statistics(data, offsets)
    for row, t in enumerate(texts):
        assert np.allclose(Q.statistics(*Q.X.utf8(pa.array([t])))[0], whole[row])
