"""Exact token counts with a whole-token shortcut.

Offline, each string of the vocabulary is encoded alone; those that come out as
one token are proven whole.  A text is cut at white space, each word into the
tokenizer's pre-tokens; a pre-token proven whole counts one and only the rest
goes through the library's merges.  Counts of words are remembered in a bounded
table, as most words of a corpus repeat.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _text as X
from tidewright.llm._spark import map_batches

#: Words remembered by one Python worker; the table starts afresh beyond it.
REMEMBERED = 300_000
#: Only words of up to so many characters are remembered.
LONGEST = 64

#: The normaliser and pre-tokenizer for which cutting at ASCII white space is exact.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: How byte-level vocabularies write bytes: printable ones as themselves, the others in order from U+0100.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - _PRINTED))}


def tokenizer_path(name: str) -> str:
    """A file as it is, or the name of a public tokenizer."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and the rest of the characters below U+0250 that lower-case to one character, as regex classes."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "-": []}
    for code in (*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)):
        kind = unicodedata.category(chr(code))[0]
        if kind not in "CZ":
            kinds[kind if kind in "LN" else "-"].append(re.escape(chr(code)))
    return tuple("".join(kinds[k]) for k in ("L", "N", "-"))


class Counter:
    """Counts tokens as the library does, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == NORMALIZERS and splits[:1] == [SPLIT] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        letters, numbers, rest = _classes()
        self.safe = re.compile(f"[{letters}{numbers}{rest}]*")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{rest}]+")
        self.words: dict[str, int] = {}
        self.whole = self._whole() if self.by_word else frozenset()

    def _whole(self) -> frozenset[str]:
        """Strings that the library encodes as one token each when they stand alone."""
        plain = [x[: -len("</w>")] for x in self.library.get_vocab(with_added_tokens=False) if x.endswith("</w>")]
        plain = [x for x in plain if x.isascii() and self.pieces.fullmatch(x)]
        return frozenset(x for x, e in zip(plain, self.library.encode_batch(plain, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of words not met before."""
        merged: dict[str, int] = {}
        out: dict[str, int] = {}
        merge, whole = self.library.model.tokenize, self.whole
        for word in words:
            if self.safe.fullmatch(word) and (word.isascii() or unicodedata.is_normalized("NFC", word)) and not any(x in word for x in self.special):
                n = 0
                for piece in self.pieces.findall(word.lower()):
                    if piece in whole:
                        n += 1
                    else:
                        if piece not in merged:
                            merged[piece] = len(merge(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)))
                        n += merged[piece]
                out[word] = n
            else:
                out[word] = len(self.library.encode(word, add_special_tokens=False).ids)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.by_word:
            return [len(e.ids) for e in self.library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        split = [(x or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") for x in texts]
        known = self.words
        known[""] = 0
        new = set().union(*split).difference(known)
        fresh = self._learn(new)
        if len(known) + len(fresh) > REMEMBERED:
            kept = {x: known[x] for x in set().union(*split) if x in known}
            known.clear()
            known.update(kept)
        known.update(fresh)
        out = [sum(map(known.__getitem__, words)) for words in split]
        for x in fresh:
            if len(x) > LONGEST:
                del known[x]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the library's on the whole text, special strings inside texts
    handled as it does by default.  A null text counts as empty: no bytes and
    no tokens.  Null and repeated ids are passed on; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        data, offsets = X.utf8(batch.column(1))
        found = counter(tokenizer_path(tokenizer))
        texts, n = batch.column(1), np.empty(batch.num_rows, np.int64)
        for a, b in X.blocks(offsets):
            n[a:b] = found.counts(texts.slice(a, b - a).to_pylist())
        return pa.table([batch.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
