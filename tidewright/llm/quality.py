"""Document quality by a regularised quadratic discriminant.

A text becomes a short vector of transformed statistics of its bytes, words and
lines.  Each class has a Gaussian whose covariance is shrunk to the pooled one
and to a multiple of the identity; the score is the logistic of the difference
of log densities, from Mahalanobis distances by triangular solves with cached
Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _text as X
from tidewright.llm._learn import fold, labelled_texts, sample_ids
from tidewright.llm._spark import map_batches

#: Training rows a class at most; shares of the pooled covariance and of the identity.
QUOTA, POOLED, RIDGE = 5000, 0.2, 0.02

_KIND = np.zeros((256, 7), bool)
_KIND[65:91, 0] = True  # upper case
_KIND[97:123, 1] = True  # lower case
_KIND[48:58, 2] = True  # digits
_KIND[[35, 36, 37, 38, 42, 60, 61, 62, 64, 94, 95, 96, 123, 125, 126, 124, 92, 43], 3] = True  # symbols
_KIND[[33, 63], 4] = True  # exclamation and question marks
_KIND[[44, 46, 58, 59], 5] = True  # other stops
_KIND[128:, 6] = True  # beyond ASCII
_KIND = _KIND.T.copy()

#: Short texts are drawn to these shares of the byte kinds above, as if so many bytes and words of usual text stood before them.
USUAL = (0.03, 0.75, 0.002, 0.002, 0.002, 0.03, 0.04)
USUAL_BYTES, USUAL_WORDS = 60, 20
#: Standardised statistics beyond so many deviations count as that many.
REACH = 5.0

FEATURES = ["upper", "lower", "digits", "symbols", "marks", "stops", "wide", "word_length", "word_spread", "distinct", "pairs", "commonest", "line_words", "short_words"]


def _distinct(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each text has, and how often its commonest stands in it."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, owner))
    value, own = values[order], owner[order]
    opens = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])]))
    most = np.zeros(rows)
    np.maximum.at(most, own[opens], np.diff(np.append(opens, len(value))))
    return np.bincount(own[opens], minlength=rows), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics (texts x FEATURES) of a block."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, len(FEATURES)))
    total, full = np.maximum(size, 1), np.flatnonzero(size)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(rows, np.int64)
        if len(full):
            sums[full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
        return sums

    for k, kind in enumerate(_KIND):
        out[:, k] = np.log((per_text(kind[data]) + USUAL_BYTES * USUAL[k]) / (total + USUAL_BYTES))
    starts, ends = X.word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    words = X.span_hashes(X.fold(data), starts, ends)
    n = np.diff(first)
    count = np.maximum(n, 1)
    owner = np.repeat(np.arange(rows), n)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, rows) / count
    spread = np.sqrt(np.maximum(np.bincount(owner, length * length, rows) / count - mean * mean, 0))
    few = USUAL_WORDS / (n + USUAL_WORDS)
    out[:, 7], out[:, 8] = np.log1p(mean) * (1 - few) + np.log(6) * few, np.log1p(spread) * (1 - few) + np.log(4) * few
    pairs = X.mix64(words[:-1] * np.uint64(3) + words[1:])
    inner = owner[:-1] == owner[1:] if len(owner) else np.empty(0, bool)
    kinds, most = _distinct(words, owner, rows)
    two, _ = _distinct(pairs[inner], owner[:-1][inner], rows)
    out[:, 9] = np.log((kinds + USUAL_WORDS) / (n + USUAL_WORDS))
    out[:, 10] = np.log((two + USUAL_WORDS) / (np.maximum(n - 1, 0) + USUAL_WORDS))
    out[:, 11] = np.log((most + 0.06 * USUAL_WORDS) / (n + USUAL_WORDS))
    breaks = per_text(data == 10)
    out[:, 12] = np.log((n + USUAL_WORDS) / (breaks + 1 + USUAL_WORDS / 15))
    out[:, 13] = np.log((np.bincount(owner[length <= 4], minlength=rows) + 0.4 * USUAL_WORDS) / (n + USUAL_WORDS))
    return out


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of the two classes over standardised statistics, and the log prior odds."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    logdet: list[float]
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(features), 1 / (1 + np.exp(-self.prior)))
        x = np.clip((features - self.shift) / self.scale, -REACH, REACH)
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.logdet, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -40, 40)))


def fit(features: np.ndarray, labels: np.ndarray, prior: float | None = None, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Of fewer than two rows of a class only the prior is learned."""
    counts = [int((labels == c).sum()) for c in (0, 1)]
    odds = float(np.log((counts[1] + 1) / (counts[0] + 1))) if prior is None else prior
    if min(counts) < 2:
        return Model(np.zeros(0), np.ones(0), [], [], [], odds)
    shift, scale = features.mean(0), features.std(0) + 1e-6
    x = np.clip((features - shift) / scale, -REACH, REACH)
    means = [x[labels == c].mean(0) for c in (0, 1)]
    own = [np.cov(x[labels == c].T) for c in (0, 1)]
    joint = (own[0] * counts[0] + own[1] * counts[1]) / sum(counts)
    whiten, logdet = [], []
    for c in (0, 1):
        cov = (1 - pooled) * own[c] + pooled * joint
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * float(np.log(np.diag(factor)).sum()))
    return Model(shift, scale, means, whiten, logdet, odds)


def _featured(column: pa.Array) -> np.ndarray:
    data, offsets = X.utf8(column)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in X.blocks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, quota: int = QUOTA) -> Model:
    """Learns from up to ``quota`` labelled rows a class outside the held-out fold; the prior comes from all of them."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    counts = dict(rows.groupBy("label").count().collect())
    texts = labelled_texts(docs, sample_ids(rows, "label", quota), id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.Table:
        x = _featured(batch.column(1))
        return pa.table([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))], names=["label", "x"])

    found = sorted(map(tuple, map_batches(texts.select("label", "text"), run, "label int, x array<double>").collect()))
    odds = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    return fit(np.array([r[1] for r in found]).reshape(-1, len(FEATURES)), np.array([r[0] for r in found], int), odds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5, else 0).

    Null texts score as empty ones do.  held_out is null for a null id; repeated
    rows give repeated results; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table([batch.column(0), pa.array(model.scores(_featured(batch.column(1))))], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(source, run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model predicts 1 for; all columns stay as they are.

    Rows pass through the scorer whole, so that no join is needed to apply its decisions.
    """
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(names.index(text_col)).cast(pa.string())
        return batch.filter(pa.array(model.scores(_featured(text)) >= 0.5))

    return map_batches(docs, run, docs.schema)
