import random
import re

import pytest

from tidewright.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, bad long"
ITEMS = "item_id long, text string"


def tokens(s):
    return re.findall(r"[^\W_]+", s.lower())


def brute(docs, items):
    """All items along all documents at all shifts."""
    out = set()
    for d, text in docs:
        w = tokens(text or "")
        for i, item in items:
            own = tokens(item or "")
            for shift in range(-len(own) + 1, len(w)) if own else ():
                a, b = max(shift, 0), min(shift + len(own), len(w))
                equal = [x == y for x, y in zip(w[a:b], own[a - shift : b - shift], strict=True)]
                best = max(((sum(1 if e else -2 for e in equal[p:q]), p, q) for p in range(len(equal)) for q in range(p + 1, len(equal) + 1)), default=(0, 0, 0))
                count = sum(equal[best[1] : best[2]])
                enough = count == len(own) if len(own) < D.LEAST else count >= min(D.LEAK_WORDS, D.LEAK_ITEM * len(own)) and count >= D.LEAK_EQUAL * (best[2] - best[1])
                if enough:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 40])
def test_equals_brute_force(spark, words, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([2, 4, 6, 9, 15, 22, 30])]
    docs = []
    for d in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        if d % 2:
            i, item = rng.choice(items)
            leak = item.split()
            if len(leak) > 12 and rng.random() < 0.6:
                for k in range(rng.randint(3, 6), len(leak), 7):
                    leak[k] = "swapped"
            if len(leak) > 20 and rng.random() < 0.3:
                leak = leak[:16]
            own += [x.upper() + "," if rng.random() < 0.2 else x for x in leak]
        docs.append((d, " ".join(own + [rng.choice(words) for _ in range(rng.randint(0, 12))])))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()}
    assert got == brute(docs, items)
    assert len(got) >= 15
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_give_the_same(spark, words, monkeypatch):
    items = [(i, " ".join(words[i * 20 : i * 20 + 18])) for i in range(8)]
    df = spark.createDataFrame([(k, "zzz " + t, None, None) for k, t in items], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    whole = sorted(D.leaks(df, bench).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    assert sorted(D.leaks(df, bench).collect()) == whole
    assert [(r["doc_id"], r["item_id"], r["first_word"], r["n_words"], r["equal_words"], r["item_words"]) for r in whole] == [(k, k, 1, 18, 18, 18) for k in range(8)]


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 0])
def test_nulls_empties_and_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    text = "alpha beta gamma delta epsilon zeta eta theta"
    df = spark.createDataFrame([(1, text, None, None), (1, text, None, None), (None, text, None, None), (2, None, None, None), (3, "", None, None), (4, "unrelated " * 9000, None, None)], DOCS)
    bench = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (None, text)], ITEMS)
    got = [(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 7), (1, 7), (None, 7), (1, None), (1, None), (None, None)], key=str)
    assert sorted(r["doc_id"] for r in D.drop_leaks(df, bench).collect() if r["doc_id"]) == [2, 3, 4]
    assert D.drop_leaks(df, bench.limit(0)).count() == 6
    assert D.leaks(df.limit(0), bench).count() == 0


def test_any_script_case_and_punctuation(spark):
    items = [(1, "It isn't \u201cthe\u201d best of times\u2014nor the worst of all times, said one"), (2, "Съешь же ещё этих мягких французских булок да выпей чаю"), (3, "天地玄黄宇宙洪荒日月盈昃辰宿列张")]
    docs = [(1, "so it isn\u2019t the best of times nor the worst of all times said one more"), (2, "СЪЕШЬ ЖЕ ЕЩЁ\u00a0ЭТИХ \u2014 МЯГКИХ, ФРАНЦУЗСКИХ БУЛОК ДА ВЫПЕЙ ЧАЮ!"), (3, "前言：天地玄黄，宇宙洪荒。日月盈昃，辰宿列张。"), (4, "nothing of it")]
    got = D.leaks(spark.createDataFrame([(*d, None, None) for d in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (3, 3)}


def test_recall_of_replaced_words(words):
    """Of overlaps of 15 to 40 words, a tenth to three in ten of them replaced at random, that meet the rule."""
    import numpy as np
    import pyarrow as pa

    from tidewright.llm import _text as X

    rng = random.Random(9)
    seen = found = 0
    for _ in range(1500):
        n = rng.randint(15, 40)
        item = [rng.choice(words) for _ in range(n)]
        equal = np.array([rng.random() > rng.uniform(0.1, 0.3) for _ in range(n)])
        start, end = D._longest_leak(equal)
        if equal[start:end].sum() >= min(13, 0.8 * n):
            seen += 1
            text = " ".join(w if e else "swapped" for w, e in zip(item, equal, strict=True))
            found += bool(D.overlaps(D.plant([1], [" ".join(item)]), *X.utf8(pa.array([text]))))
    assert seen > 900 and found >= 0.997 * seen


@pytest.mark.parametrize(("equal", "want"), [([], (0, 0)), ([False], (0, 0)), ([True, False, True, True, True, False], (2, 5)), ([True] * 5 + [False] + [True] * 5, (0, 11))])
def test_best_stretch(equal, want):
    import numpy as np

    assert D._best_stretch(np.array(equal, bool)) == want


def test_any_stretch_that_meets_the_rule_leaks(words):
    import numpy as np
    import pyarrow as pa

    from tidewright.llm import _text as X

    def leaks_somewhere(equal, need):
        return any(sum(equal[p:q]) >= need and 10 * sum(equal[p:q]) >= 7 * (q - p) for p in range(len(equal)) for q in range(p + 1, len(equal) + 1))

    rng = random.Random(6)
    want, got = [], []
    for _ in range(300):
        n, k = rng.choice([(15, 3), (18, 4), (20, 4), (20, 5), (30, 9), (30, 12), (15, 2)])
        item = [rng.choice(words) for _ in range(n)]
        equal = [True] * n
        for j in rng.sample(range(n), k):
            equal[j] = False
        text = " ".join(w if e else "swapped" for w, e in zip(item, equal, strict=True))
        want.append(leaks_somewhere(equal, min(13, 0.8 * n)))
        start, end = D._longest_leak(np.array(equal))
        assert (sum(equal[start:end]) >= min(13, 0.8 * n)) == want[-1] and 10 * sum(equal[start:end]) >= 7 * (end - start)
        got.append(bool(D.overlaps(D.plant([1], [" ".join(item)]), *X.utf8(pa.array([text])))))
    assert sum(want) > 200 and got == want
