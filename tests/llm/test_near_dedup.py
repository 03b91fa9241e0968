import random

import numpy as np
import pytest

from tidewright.llm import near_dedup
from tidewright.llm._text import shingle_sets, utf8

SPACE = b" \t\n\r\x0b\x0c"


def brute(docs, k, percent=80):
    """Components by comparing the sets of all pairs of documents."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {d: (len(sets[i]), min(groups[find(i)]), min(groups[find(i)]) == d) for i, (d, _) in enumerate(docs)}


def corpus(words, rng, bases=12, copies=14):
    docs = [None, "", " \t\n", "one", "ONE", "one two", "two one", "x" * 40_000, "É é É", "a b a b c"]
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 8))):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(rng.choice([" ", "\n", "\t "]).join(own).title() if rng.random() < 0.3 else " ".join(own))
    docs += docs[10:14]
    rng.shuffle(docs)
    return list(enumerate(docs, 1000))


@pytest.mark.parametrize(("k", "paired"), [(2, 48), (2, 2), (5, 48)])
def test_components_equal_brute_force(spark, words, monkeypatch, k, paired):
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    docs = corpus(words, random.Random(k + paired))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = near_dedup.near_duplicates(df, shingle_words=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute(docs, k)


def test_a_chain_is_one_component(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[i : i + 40])) for i in range(0, 20, 2)]
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2).collect()
    assert {r["component_id"] for r in out} == {0}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (None, "a b c d", "z", 3), (2, "a b c d", None, 4), (3, None, "q", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n long")
    out = near_dedup.near_duplicates(df, shingle_words=2).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)] * 2
    kept = near_dedup.drop_near_duplicates(df, shingle_words=2)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect() if r["doc_id"]) == [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (3, None, "q", None)]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    for size in (1, 2, 7, 800):
        a, b = pool[:size], pool[size // 5 : size // 5 + size]
        s = near_dedup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 288)
        assert (s != 2**64 - 1).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.12


def test_shingles_are_those_of_the_bytes():
    import pyarrow as pa

    data, offsets = utf8(pa.array(["A b\x0bB  a b", None, "", "solo", "É b", "é b"]))
    _, bounds = shingle_sets(data, offsets, 2)
    assert np.diff(bounds).tolist() == [3, 0, 0, 1, 1, 1]


def test_words_that_collide_in_polynomials_are_apart(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [x[:n] for n in (64, 128, 256, 512, 1024, 2048) for x in (a, a.translate(str.maketrans("ab", "ba")))]
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle_words=2).collect()
    assert all(r["kept"] for r in out)


def test_word_hashes_tell_words_apart_in_any_window(monkeypatch):
    from tidewright.llm import _text as X

    rng = random.Random(1)
    texts = ["".join(rng.choice("aB c\n\tdé") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["x" * 1000 + " y" * 3, "", "A" * 256, "a" * 257, "A" * 257, "a" * 8, "a" * 16]
    data, offsets = utf8(__import__("pyarrow").array(texts))
    found = []
    for window in (1 << 22, 64, 1):
        monkeypatch.setattr(X, "WINDOW", window)
        hashes, first = X.word_hashes(data, offsets)
        seen = {}
        for k, text in enumerate(texts):
            words = text.encode().lower().split()
            assert len(words) == first[k + 1] - first[k]
            for word, h in zip(words, hashes[first[k] : first[k + 1]].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
        found.append(seen)
    assert found[0] == found[1] == found[2]


def test_letters_of_all_scripts(monkeypatch):
    from tidewright.llm import _text as X

    texts = ["\u201cQuoted\u201d em\u2014dash\u00a0ПРИВЕТ мир don\u2019t cafe\u0301 你好", "quoted em dash привет МИР don t CAFÉ 你 好", ""]
    for window in (1 << 22, 3):
        monkeypatch.setattr(X, "WINDOW", window)
        hashes, first = X.letter_hashes(*utf8(__import__("pyarrow").array(texts)))
        assert first.tolist() == [0, 10, 20, 20] and hashes[:10].tolist() == hashes[10:].tolist()


def test_repeated_rows_and_null_ids_leave_one(spark):
    text, other = "a passage of some eight or nine words here", "quite another passage that has nothing to do with it"
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "x"), (None, other, "y"), (None, other, "y"), (None, text + " again and again", "z"), (3, other + " at all, is there one", "w")]
    out = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, gone string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted({rows[0], rows[3], rows[5], rows[6]}, key=str)
