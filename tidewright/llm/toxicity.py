"""Toxicity by a gap-weighted subsequence kernel, Nystrom landmarks and a linear support vector machine.

The kernel of two words is the dot product of their subsequences of four
letters (a word's start counts as one) within a span of SPAN, each weighed
DECAY to the power of its gaps and counted in one of 2 ** BITS hashed places,
so that a word with letters inserted still resembles the word that it hides.
Marks within a word are skipped.  Landmark words give the Nystrom features in
which a squared-hinge machine is trained on labelled sentences.

A sentence is known by its most toxic word, a text by its most toxic sentence.
Labels are of texts, so training is of multiple instances: a clean text labels
all its sentences, a toxic one only that which the machine of the round before
finds the most toxic.  The first round's choice goes by words that stand in many
different places of toxic texts and in almost none of clean ones.  Copies of the
toxic sentences' words with a mark or letter inserted stand beside them.

Landmarks, projection and weights fold into one table of weights of letter
subsequences: a text is scored by looking its own up and adding them by word,
which is the same number as the kernel expansion gives.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _text as X
from tidewright.llm._learn import fold, labelled_texts, sample_ids
from tidewright.llm._spark import map_batches

#: Training texts a class at most, sentences of a text at most, words of a sentence at most, landmarks at most, rounds of training,
#: and sentences of clean texts at most that a round is trained on, the ones most like toxic ones and the commonest.
QUOTA, SENTENCES, WORDS, LANDMARKS, ROUNDS, CLEAN = 2500, 64, 40, 240, 4, 10_000
#: Longer words teach nothing.
LONGEST = 40
#: The largest span of a subsequence, the weight of a gap, and the machine's cost of an error.
SPAN, DECAY, COST = 6, 0.6, 3.0
#: Hashed places of subsequences, as a power of two.
BITS = 17
#: How much worse it is to accuse a clean text than to miss a toxic one.
CAUTION = 4.0
#: Bytes of a text scored at a time.
PIECE = 1 << 20

#: Symbols: 0 between words, 1-26 letters, 27 anything else, 28 the start of a word, 29 on the accented letters below, a symbol each group, FAR on letters of other scripts.
ACCENTED = ("àáâãå", "ä", "ç", "è", "é", "êë", "ìíîï", "ñ", "òóôõø", "ö", "ùúû", "ü", "ß", "æ", "ýÿ")
OTHER, START, FAR, SYMBOLS = 27, 28, 64, 512
#: Offsets of a subsequence's second, third and fourth letter, and its weight.
PATTERNS = [(i, j, k, DECAY ** (k - 3)) for k in range(3, SPAN) for i in range(1, k) for j in range(i + 1, k)]
_ENDS = re.compile(r"[.!?;:|\n]+(?:\s|$)|\n")
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@cache
def symbol_table() -> np.ndarray:
    """The symbol of each code point; letters of other scripts share FAR to SYMBOLS - 1 by a hash."""
    low = X.letter_table() & ~X.ALONE
    known = np.full(0x110000, OTHER, np.uint16)
    far = low >= 128
    known[far] = FAR + (low[far] * _ODD[0] >> np.uint32(16)) % (SYMBOLS - FAR)
    known[(low >= 97) & (low <= 122)] = low[(low >= 97) & (low <= 122)] - 96
    for k, group in enumerate(ACCENTED):
        for c in group:
            known[low == ord(c)] = 29 + k
    known[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return known


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, first words of texts): a block's texts as symbols, each word after a START and SPAN - 1 zeros or more, and the words' bounds with their START.

    White space between two single letters doesn't part words, so that a word
    set letter by letter is one.
    """
    codes, places = X.code_points(data, offsets)
    s = symbol_table()[codes]
    edge = np.zeros(len(s) + 1, bool)
    edge[places] = True
    letter = (s > 0) & (s != OTHER)
    if len(s) > 4:
        gap = np.flatnonzero((s[1:-1] == 0) & letter[:-2] & letter[2:]) + 1
        alone_before = (gap < 2) | (s[np.maximum(gap - 2, 0)] == 0) | edge[gap - 1]
        alone_after = (gap + 2 >= len(s)) | (s[np.minimum(gap + 2, len(s) - 1)] == 0) | edge[np.minimum(gap + 2, len(s))]
        joined = gap[alone_before & alone_after & ~edge[gap] & ~edge[gap + 1]]
        s[joined] = OTHER
    solid = s > 0
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    word = np.cumsum(start)
    kept = np.flatnonzero(solid & (s != OTHER))
    if not len(kept):
        return np.zeros(SPAN, np.uint16), np.zeros((2, 0), np.int64), np.zeros(len(offsets), np.int64)
    opens = np.flatnonzero(np.diff(word[kept], prepend=0))
    order = np.zeros(len(kept), np.int64)
    order[opens] = 1
    at = np.arange(len(kept)) + SPAN * (np.cumsum(order) - 1) + 1
    out = np.zeros(at[-1] + SPAN, np.uint16)
    out[at] = s[kept]
    starts = at[opens] - 1
    out[starts] = START
    ends = np.append(at[opens[1:] - 1], at[-1]) + 1
    owner = np.searchsorted(places, kept[opens], "right") - 1
    return out, np.stack([starts, ends]), np.searchsorted(owner, np.arange(len(offsets)))


def self_kernel(length: np.ndarray) -> np.ndarray:
    """What a word of so many symbols has as its kernel with itself when no subsequence repeats; the normaliser."""
    return sum(np.maximum(length - k, 0) * w * w for _, _, k, w in PATTERNS) + 1e-9


def _places(s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each kind of subsequence, the hashed place of the one that begins at each symbol, whether it is one, and its weight."""
    wide, n = [s * odd for odd in _ODD], len(s) - SPAN + 1
    solid, found = s > 0, []
    # Words stand SPAN apart, so a subsequence with its first and last symbol solid lies in one word.
    inside = {k: solid[:n] & solid[k : n + k] for k in range(3, SPAN)}
    for i, j, k, w in PATTERNS:
        code = wide[0][:n] + wide[1][i : n + i] + wide[2][j : n + j] + wide[3][k : n + k]
        code = (code ^ (code >> np.uint32(15))) * _ODD[0]
        found.append((code >> np.uint32(32 - BITS), inside[k], w))
    return found


def word_sums(s: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the sum of its subsequences' weights over the root of its self kernel."""
    starts, ends = bounds
    if not len(starts):
        return np.empty(0)
    total = np.zeros(len(s) - SPAN + 1, np.float32)
    for code, counts, w in _places(s):
        total += weights[code] * (counts * np.float32(w))
    sums = np.concatenate([[0], np.cumsum(total, dtype=np.float64)])
    last = len(total)
    return (sums[np.minimum(ends, last)] - sums[np.minimum(starts, last)]) / np.sqrt(self_kernel(ends - starts))


def _codes(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], np.ndarray, int]:
    """Places of the words' subsequences, the words' bounds, and the number of symbols where one can begin."""
    data, offsets = X.utf8(pa.array(words, pa.large_string()))
    s, bounds, _ = symbols(data, offsets)
    if len(bounds[0]) != len(words):
        raise ValueError("a training word is white space, has it within or has no letter")
    return _places(s), bounds, len(s) - SPAN + 1


def _maps(words: list[str]) -> np.ndarray:
    """Normalised maps of the words, one a column (places x words)."""
    found, (starts, ends), n = _codes(words)
    out = np.zeros((1 << BITS, len(words)), np.float32)
    row = np.zeros(n, int)
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        row[a:b] = k
    for code, counts, w in found:
        np.add.at(out, (code[counts], row[counts]), np.float32(w))
    out /= np.sqrt(self_kernel(ends - starts)).astype(np.float32)
    return out


def _kernel(words: list[str], marks: np.ndarray) -> np.ndarray:
    """Kernel of the words with the landmarks, whose maps are the columns of ``marks``."""
    out = []
    for k in range(0, len(words), 500):
        found, (starts, ends), n = _codes(words[k : k + 500])
        total = np.zeros((n, marks.shape[1]), np.float32)
        for code, counts, w in found:
            total[counts] += marks[code[counts]] * np.float32(w)
        sums = np.add.reduceat(total, np.minimum(starts, n - 1), axis=0)
        out.append(sums / np.sqrt(self_kernel(ends - starts))[:, None])
    return np.concatenate(out)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pieces of about PIECE bytes of long texts, cut at white space after a word of two bytes or more, and each piece's text."""
    cuts, owner = [0], []
    long = np.diff(offsets) > 2 * PIECE
    if not long.any():
        return offsets, np.arange(len(offsets) - 1)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while long[row] and b - a > 2 * PIECE:
            for width in (4096, b - a - PIECE):
                window = data[a + PIECE : a + PIECE + width]
                space = (window == 32) | (window == 10)
                fit = np.flatnonzero(space[2:] & ~space[1:-1] & ~space[:-2])
                if len(fit):
                    break
            else:
                break
            a += PIECE + int(fit[0]) + 2
            cuts.append(a)
            owner.append(row)
        cuts.append(b)
        owner.append(row)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


@dataclass
class Model:
    """Weights of places, the machine's bias, and the slope and offset that turn its decisions into probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decisions(self, column: pa.Array) -> np.ndarray:
        """The largest decision of each text's words; the bias for a text without words."""
        data, offsets = X.utf8(column)
        cuts, owner = pieces(data, offsets)
        parts = []
        for a, b in X.blocks(cuts, PIECE):
            s, bounds, first = symbols(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            sums = np.concatenate([word_sums(s, bounds, self.weights), [0.0]])
            best = np.maximum.reduceat(sums, np.minimum(first[:-1], len(sums) - 1))
            parts.append(np.where(np.diff(first) > 0, best, -np.inf))
        out = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(out, owner, np.concatenate(parts) if parts else np.empty(0))
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(column) + self.offset, -40, 40)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """A squared-hinge linear machine by Newton steps on the rows within the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        own = x[inside] * weight[inside, None]
        step = np.linalg.solve(ridge + cost * own.T @ x[inside], cost * own.T @ y[inside])
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w[:-1], float(w[-1])


def disguises(word: str) -> list[str]:
    """The word with a mark between all letters, and with a mark or a letter inserted at each place."""
    inner = range(1, len(word))
    return [".".join(word), *(f"{word[:k]}.{word[k:]}" for k in inner), *(f"{word[:k]}{'xqzk'[k % 4]}{word[k:]}" for k in inner)]


def sentences(text: str) -> list[list[str]]:
    """The words of each of a text's sentences in lower case, WORDS at most together; longer words than LONGEST are left out."""
    out = []
    for line in _ENDS.split(text.lower()):
        words = [w for w in line.split() if len(w) <= LONGEST]
        out += [words[k : k + WORDS] for k in range(0, len(words), WORDS)]
    return out


def _taught(word: str) -> bool:
    return sum(c.isalpha() for c in word) >= 3


def _contexts(bags: list[list[list[str]]]) -> tuple[Counter, Counter]:
    """For each word of three letters or more, the different pairs of neighbours that it has and the texts that it stands in.

    Neighbours tell words that stand in many places from those of one passage
    that many texts copy.
    """
    held, seen = Counter(), set()
    for bag in bags:
        for s in bag:
            padded = ["", *s, ""]
            seen.update(x for x in zip(padded, padded[1:], padded[2:]) if _taught(x[1]))  # noqa: B905
        held.update({w for s in bag for w in s if _taught(w)})
    return Counter(w for _, w, _ in seen), held


def _witnesses(bags: list[list[list[str]]], score: dict[str, float]) -> list[list[tuple[float, str]]]:
    """For each text the most toxic word of each sentence, with its score."""
    return [[max((score[w], w) for w in s if w in score) for s in bag if any(w in score for w in s)] for bag in bags]


def fit(texts: list[list[list[str]]], labels: list[int]) -> Model:
    """A model of texts as sentences of words; of texts of one class only, one that gives that class to all."""
    flat = np.zeros(1 << BITS, np.float32)
    if len(set(labels)) < 2:
        return Model(flat, 0.0, 0.0, 4.0 if set(labels) == {1} else -4.0)
    joined = [" ".join(w for s in bag for w in s) for bag in texts]
    # Every third text of a class is kept back to set the threshold.
    order = np.argsort([crc32(t.encode()) for t in joined], kind="stable")
    place = np.empty(len(texts), int)
    for c in (0, 1):
        mine = [k for k in order if labels[k] == c]
        place[mine] = np.arange(len(mine))
    back = place % 3 == 2
    if any((back & (np.array(labels) == c)).sum() < 2 for c in (0, 1)):
        back[:] = True
        taught = np.ones(len(texts), bool)
    else:
        taught = ~back
    # Texts that repeat are one.
    bags = [[texts[k] for k in {joined[k]: k for k in np.flatnonzero(taught & (np.array(labels) == c)).tolist()}.values()] for c in (0, 1)]
    in_toxic, held = _contexts(bags[1])
    in_clean, _ = _contexts(bags[0])
    least = max(3, sum(k and y for k, y in zip(taught, labels, strict=True)) // 200)
    seeds = {w: n for w, n in in_toxic.items() if n >= least and 2 * n >= held[w] and in_clean[w] <= n // 50}
    if not seeds:
        return Model(flat, 0.0, 0.0, -4.0)
    words = sorted({*in_toxic, *in_clean})
    score = {w: 1.0 if w in seeds else -2.0 for w in words}
    model = Model(flat, 0.0, 1.0, 0.0)
    for _ in range(ROUNDS):
        # The most toxic sentence of each toxic text, unless none comes near the margin, and the sentences of clean texts.
        best = Counter(max(found)[1] for found in _witnesses(bags[1], score) if found and max(found)[0] > -1)
        if not best:
            break
        rest = Counter(w for found in _witnesses(bags[0], score) for _, w in found)
        wrong = sorted((w for w in rest if score[w] > -1), key=lambda w: (-score[w], w))[: CLEAN // 2]
        common = sorted(rest, key=lambda w: (-rest[w], w))
        plain = list(dict.fromkeys([*wrong, *sorted(in_clean, key=lambda w: (-in_clean[w], w))[: CLEAN // 4], *common]))[:CLEAN]
        positive = sorted(best, key=lambda w: (-best[w], w))
        clear = [w for w in positive if rest[w] * 10 < best[w]]
        marks = clear[: LANDMARKS // 2] + [w for w in plain if w not in best][: LANDMARKS // 2]
        columns = _maps(marks)
        value, vector = np.linalg.eigh((columns.T @ columns).astype(np.float64))
        good = value > 1e-6 * value.max()
        project = vector[:, good] / np.sqrt(value[good])
        hidden = [x for w in clear[: LANDMARKS // 2] for x in disguises(w)]
        sample = positive + hidden + plain
        n = len(positive) + len(hidden)
        y = np.where(np.arange(len(sample)) < n, 1.0, -1.0)
        # A witness counts as often as it stands for a sentence, damped; sentences of clean texts outvote those of toxic ones that hold the same word.
        weight = np.concatenate([[20.0 * min(1.0, best[w] / (1 + rest[w])) for w in positive], np.full(len(hidden), 4.0), [1.0 + np.log1p(rest[w]) for w in plain]])
        w, bias = _machine(_kernel(sample, columns) @ project, y, weight, COST)
        model = Model((columns @ (project @ w)).astype(np.float32), bias, 1.0, 0.0)
        score = dict(zip(words, model.decisions(pa.array(words, pa.large_string())).tolist(), strict=True))
    column, truth = pa.array([t for t, k in zip(joined, back, strict=True) if k], pa.large_string()), np.array(labels)[back]
    best = model.decisions(column)
    # The score is one half where clean texts that pass, each counted CAUTION times, and toxic texts that don't are fewest.
    order = np.argsort(best, kind="stable")
    ranked, flags = best[order], truth[order]
    missed = np.concatenate([[0], np.cumsum(flags)]) / flags.sum()
    passed = CAUTION * (1 - np.concatenate([[0], np.cumsum(1 - flags)]) / (1 - flags).sum())
    edges = np.concatenate([[ranked[0] - 1], (ranked[1:] + ranked[:-1]) / 2, [ranked[-1] + 1]])
    loss = missed + passed
    least_loss = np.flatnonzero(loss <= loss.min() + 1e-12)
    middle = (edges[least_loss[0]] + edges[least_loss[-1]]) / 2
    away = max(float(np.median(ranked[flags == 1]) - middle), 0.1)
    model.slope, model.offset = 3 / away, -3 / away * middle
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0, quota: int = QUOTA) -> Model:
    """Learns from up to ``quota`` labelled ids a class outside the held-out fold, of each text SENTENCES sentences at most, those with the least checksums.

    Null texts, null ids and labels other than 0 and 1 teach nothing; an id with
    several labels teaches all of them.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    texts = labelled_texts(docs, sample_ids(rows, "label", quota), id_col, text_col).where("text is not null")

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for text in batch.column(1):
            own = list(dict.fromkeys(" ".join(s) for s in sentences(text.as_py())))
            out.append(sorted(sorted(own, key=lambda s: (crc32(s.encode()), s))[:SENTENCES]) if len(own) > SENTENCES else own)
        return pa.table([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["label", "sentences"])

    # At most SENTENCES sentences of WORDS words of LONGEST characters of each text.
    found = sorted((r[0], list(r[1])) for r in map_batches(texts.select("label", "text"), run, "label int, sentences array<string>").collect())
    return fit([[s.split() for s in own] for _, own in found], [y for y, _ in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5, else 0).

    Null, empty and wordless texts score as a text whose words the kernel finds
    unlike every landmark; very long texts are scored a piece at a time.  held_out is null for a null id; repeated rows give
    repeated results; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table([batch.column(0), pa.array(model.scores(batch.column(1)))], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(source, run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
