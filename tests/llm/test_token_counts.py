from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm.token_counts import count_tokens, counter, tokenizer_path

PIECES = st.one_of(st.text(max_size=6), st.sampled_from([" ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "hello", "É", "é", "İ", "Σ", " ", "\x1c", "日本", "😀", "½", "don't", "!?'s"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=10).map("".join))
def test_counts_equal_the_library(text):
    c = counter(tokenizer_path("word_bpe_49k.json"))
    assert c.counts([text]) == [len(c.library.encode(text, add_special_tokens=False).ids)]


def test_whole_tokens_are_proven():
    c = counter(tokenizer_path("word_bpe_49k.json"))
    assert "hello" in c.whole and len(c.whole) > 10_000
    assert all(len(c.library.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(c.whole)[::500])


def test_the_table_of_words_is_bounded(monkeypatch):
    from tidewright.llm import token_counts

    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    c = token_counts.Counter(tokenizer_path("word_bpe_49k.json"))
    for k in range(30):
        assert c.counts([f"word{k} alpha beta gamma{k}"]) == [len(c.library.encode(f"word{k} alpha beta gamma{k}", add_special_tokens=False).ids)]
    assert len(c.words) < 60


def test_rows(spark):
    texts = ["Hello, world's 123", None, "", "x" * 50_000, "a b " * 3000, "<|endoftext|> once"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, texts[0], 7), (None, "a", None)], "doc_id long, text string, n_tokens long")
    out = {r["doc_id"]: r for r in count_tokens(df, limit=2048).collect()}
    c = counter(tokenizer_path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        n = len(c.library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert count_tokens(df).count() == 8
    assert count_tokens(df.limit(0)).count() == 0
