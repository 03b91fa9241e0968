"""Language identification by the nearest of several centroids per language.

A text becomes the TF-IDF vector of its hashed byte trigrams, lower-cased and
with digits and ASCII punctuation blanked, of length one.  Each language's
training vectors are clustered on the sphere; a text takes the language of the
centroid nearest by cosine, and is marked as rejected where it is farther from
that centroid than almost all that the centroid was learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _text as X
from tidewright.llm._learn import fold, labelled_texts, sample_ids
from tidewright.llm._spark import map_batches

#: Hashed trigrams; training rows a language at most; centroids a language; the share of training rows within a centroid's reach.
DIMENSIONS, QUOTA, CENTROIDS, REACH = 4096, 800, 3, 0.999
#: Languages at most; a table with more labels has something else in that column, and is an error.
LANGUAGES = 1000
#: Texts whose vectors are made together.
ROWS = 256
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts x DIMENSIONS) of hashed trigrams of a block, a window at a time."""
    rows = len(offsets) - 1
    out = np.zeros(rows * DIMENSIONS, np.int64)
    for low in range(0, max(len(data) - 2, 0), X.WINDOW):
        high = min(low + X.WINDOW + 2, len(data))
        before = max(low - 1, 0)
        x = _FOLD[data[before:high]]
        # Upper-case letters of U+00C0 to U+00DE.
        accented = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
        x[accented] += 0x20
        x = x[low - before :]
        owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(np.clip(offsets, low, high)))
        a, b, c = x[:-2].astype(np.uint32), x[1:-1].astype(np.uint32), x[2:].astype(np.uint32)
        keep = (owner[:-2] == owner[2:]) & ((b != 32) | (a != 32) & (c != 32))
        code = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
        at = owner[:-2].astype(np.int64) * DIMENSIONS + code
        out += np.bincount(at[keep], minlength=len(out))
    return out.reshape(rows, DIMENSIONS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    reach: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        return best, cosine[np.arange(len(best)), best]


def _cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart seeds: centroids and the cosine that REACH of their members have at least."""
    seeds = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        seeds.append(v[np.argmin(np.max(v @ np.array(seeds).T, axis=1))])
    centres = np.array(seeds)
    for _ in range(8):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = (v @ centres.T).argmax(1)
        centres = np.array([v[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    cosine = v @ centres.T
    own = cosine.argmax(1)
    return centres, np.array([np.quantile(cosine[own == j, j], 1 - REACH) if (own == j).any() else 1.0 for j in range(len(centres))])


def _rows(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Texts' places and counts as rows of a matrix."""
    out = np.zeros((len(counts), DIMENSIONS), np.float32)
    for row, (places, n) in enumerate(counts):
        out[row, places] = n
    return out


def fit(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], centroids: int = CENTROIDS) -> Model:
    """A model of texts given by their trigrams' places and counts; of none, one that knows no language.

    One language's vectors are made at a time.
    """
    names = sorted(set(langs))
    if not names:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    held = sum(np.bincount(places, minlength=DIMENSIONS) for places, _ in counts)
    idf = np.log((1 + len(counts)) / (1 + held)).astype(np.float32) + 1
    model = Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    found = [(name, *_cluster(model.vectors(_rows([c for c, x in zip(counts, langs, strict=True) if x == name])), centroids)) for name in names]
    model.centroids = np.concatenate([c for _, c, _ in found]).astype(np.float32)
    model.reach = np.concatenate([r for *_, r in found])
    model.langs = [name for name, c, _ in found for _ in c]
    return model


def _matrices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """The counts of a column's texts, some rows at a time."""
    data, offsets = X.utf8(column)
    for a, b in X.blocks(offsets, rows=ROWS):
        yield a, b, trigram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sparse(batch: pa.RecordBatch) -> pa.Table:
    labels, places, counts, ends = [], [], [], [0]
    for a, b, found in _matrices(batch.column(1)):
        for row, text, label in zip(found, batch.column(1).slice(a, b - a).to_pylist(), batch.column(0).slice(a, b - a).to_pylist(), strict=True):
            if has_letter(text):
                at = np.flatnonzero(row)
                labels.append(label)
                places.append(at)
                counts.append(row[at])
                ends.append(ends[-1] + len(at))
    bounds = pa.array(ends, pa.int32())
    values = lambda x: pa.array(np.concatenate(x or [np.empty(0, int)]), pa.int64())
    return pa.table([pa.array(labels, pa.string()), pa.ListArray.from_arrays(bounds, values(places)), pa.ListArray.from_arrays(bounds, values(counts))], names=["label", "places", "counts"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, quota: int = QUOTA) -> Model:
    """Learns from up to ``quota`` ids a language outside the held-out fold, of which LANGUAGES at most may be.

    What reaches the driver is at most DIMENSIONS numbers a text, however long it is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("label")).where(F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    if len(names := rows.select("label").distinct().limit(LANGUAGES + 1).collect()) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    if not names:
        return fit([], [])
    texts = labelled_texts(docs, sample_ids(rows, "label", quota), id_col, text_col, lang_col).select("label", "text")
    found = map_batches(texts, _sparse, "label string, places array<long>, counts array<long>").toArrow()
    found = sorted(zip(found["label"].to_pylist(), found["places"].to_pylist(), found["counts"].to_pylist(), strict=True))
    return fit([(np.array(p, np.int64), np.array(n, np.int64)) for _, p, n in found], [x for x, *_ in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is the language of the nearest centroid and score its cosine, in
    0 to 1.  A text that is null or has no letter gets ``und`` and 0, as does
    every text if nothing was learned.  rejected says that the text lies beyond
    the centroid's reach (true for ``und``).  Ties go to the language first in
    order.  held_out is null for a null id; repeated rows give repeated results;
    other columns are not read.
    """
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batch: pa.RecordBatch) -> pa.Table:
        n = batch.num_rows
        best, score = np.full(n, len(model.langs)), np.zeros(n)
        for a, b, counts in _matrices(batch.column(1)):
            if model.langs:
                best[a:b], score[a:b] = model.nearest(counts)
            for k, text in enumerate(batch.column(1).slice(a, b - a).to_pylist(), a):
                if not has_letter(text):
                    best[k], score[k] = len(model.langs), 0
        reach = np.concatenate([model.reach, [2.0]])
        return pa.table([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(score < reach[best])], names=["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(source, run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "rejected")
