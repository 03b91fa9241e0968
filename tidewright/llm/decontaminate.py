"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of words: it hashes the positions that it
keeps and ignores the others, so a run with words replaced at ignored positions
still hits.  The hashes of the benchmark's runs are joined to those of the
documents' runs; around each hit the benchmark item is laid along the document
and the best stretch is scored, equal words for it and replaced words against
it; where that is no leak, the stretch with the most equal words that has the
share of equal ones decides.  Words are runs of letters and digits of any
script, whatever their case, and characters of scripts without spaces, so
punctuation and layout don't hide a passage.

A benchmark of up to BLOCK_WORDS words is broadcast and probed as documents are
scanned, so that nothing is shuffled.  A larger one is a table: documents give
the hashes that pass a broadcast filter of fixed size, those are joined to the
benchmark's by Spark, and texts with hits meet their items by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _text as X
from tidewright.llm._spark import Scratch, fresh, hot_join, map_batches

#: Masks over runs of words: 1 keeps a position.  Fixed spaced seeds of weight 6 (and of weight 4 for short items).
SEEDS = ("110100110101", "111010010011", "10101001101", "1101100101", "1100111001", "110001111", "1111011", "111111")
SHORT_SEEDS = ("11011", "1111")
#: Items of fewer words than this are compared as wholes only.
LEAST = 5
#: A stretch leaks if it has this many equal words, or this share of a shorter item's, and this share of its own words equal.
LEAK_WORDS, LEAK_ITEM, LEAK_EQUAL = 13, 0.8, 0.7
#: Words of a benchmark that is broadcast at most; bits of the filter that hashes pass first, for it and for a larger one, as powers of two.
BLOCK_WORDS, FILTER_BITS, WIDE_BITS = 200_000, 20, 26
#: Hits of one mask in a block of texts laid out at a time.
HITS = 1 << 18

def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash of the run that begins at each word; runs that don't fit are missing."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = X.mix64(np.arange(1, len(mask) + 2, dtype=np.uint64)) | np.uint64(1)
    total = np.full(n, X.mix64(np.array([int(mask, 2) * 64 + len(mask)], np.uint64))[0])
    for k, keep in enumerate(mask):
        if keep == "1":
            total += words[k : n + k] * odd[k]
    return X.mix64(total)


@dataclass
class Seeds:
    """A block of the benchmark: its items' words, and for each mask its hashes in order with the item and place of each."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    masks: list[str]
    hashes: list[np.ndarray]
    items: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]


def plant(ids: list[int], texts: list[str]) -> Seeds:
    data, offsets = X.utf8(pa.array(texts, pa.large_string()))
    words, first = X.letter_hashes(data, offsets)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(ids)), sizes)
    longest = max(map(len, SEEDS))
    out = Seeds(np.array(ids, np.int64), words, first, [], [], [], [], [])

    def add(mask: str, keep: np.ndarray) -> None:
        h = seed_hashes(words, mask)
        n = len(h)
        keep = keep[owner[:n]] & (owner[:n] == owner[len(mask) - 1 : n + len(mask) - 1])
        h, item, place = h[keep], owner[:n][keep], (np.arange(n) - first[owner[:n]])[keep]
        if len(h):
            order = np.argsort(h, kind="stable")
            passes = np.zeros(1 << FILTER_BITS, bool)
            passes[h >> np.uint64(64 - FILTER_BITS)] = True
            for field, value in ((out.masks, mask), (out.hashes, h[order]), (out.items, item[order]), (out.places, place[order]), (out.filters, passes)):
                field.append(value)

    if len(words):
        for mask in SEEDS:
            add(mask, sizes >= longest)
        for mask in SHORT_SEEDS:
            add(mask, (sizes >= LEAST) & (sizes < longest))
        for n in range(1, LEAST):
            add("1" * n, sizes == n)
    return out


def _best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The stretch with the most equal words less twice the others, the longest of several; it begins and ends with equal ones."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    least = np.minimum.accumulate(sums)
    gain = sums - least
    end = len(gain) - 1 - int(np.argmax(gain[::-1])) if gain.max() > 0 else 0
    start = int(np.argmax(sums[: end + 1] == least[end])) if end else 0
    return start, end


def _longest_leak(equal: np.ndarray) -> tuple[int, int]:
    """The stretch with the most equal words of those that LEAK_EQUAL of are equal, the first of several; it begins and ends with equal ones."""
    count = np.concatenate([[0], np.cumsum(equal)])
    # A stretch from p to q has the share if the surplus at q is not below that at p; the first such p has the most equal words.
    surplus = 100 * count - round(100 * LEAK_EQUAL) * np.arange(len(count))
    first = np.searchsorted(-np.minimum.accumulate(surplus), -surplus, "left")
    end = int(np.argmax(count - count[first]))
    start, inside = int(first[end]), np.flatnonzero(equal[first[end] : end])
    return (start + int(inside[0]), start + int(inside[-1]) + 1) if len(inside) else (0, 0)


def _stretch(own: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal words, first word, words) of the leak of an item laid along a text at ``shift``, if it is one."""
    a, b = max(shift, 0), min(shift + len(own), len(words))
    equal = words[a:b] == own[a - shift : b - shift]
    for find in (_best_stretch, _longest_leak):
        start, end = find(equal)
        count = int(equal[start:end].sum())
        if count >= min(LEAK_WORDS, LEAK_ITEM * len(own)) and count >= LEAK_EQUAL * (end - start) and (len(own) >= LEAST or count == len(own)):
            return count, a + start, end - start
    return None


def _better(new: tuple[int, int, int] | None, old: tuple[int, int, int] | None) -> tuple[int, int, int] | None:
    """Of two leaks of an item in a text the one with more equal words, the earlier one, the longer one."""
    key = lambda x: (x[0], -x[1], x[2])
    return new if old is None or new is not None and key(new) > key(old) else old


def overlaps(seeds: Seeds, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, first word, words, equal words, item's words) of each leak of a block of texts: the best of an item in a text."""
    words, first = X.letter_hashes(data, offsets)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    lined = [np.empty((0, 3), np.int64)]
    for mask, hashes, items, places, passes in zip(seeds.masks, seeds.hashes, seeds.items, seeds.places, seeds.filters, strict=True):
        h = seed_hashes(words, mask)
        at = np.flatnonzero(passes[h >> np.uint64(64 - FILTER_BITS)])
        if not len(at):
            continue
        low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        text = np.searchsorted(first, at, "right") - 1
        good = (high > low) & (at + len(mask) <= first[text + 1])
        at, low, n, text = at[good], low[good], (high - low)[good], text[good]
        ends = np.cumsum(n)
        for k in range(0, len(at), HITS):
            part = slice(k, k + HITS)
            which = np.repeat(low[part], n[part]) + np.arange(n[part].sum()) - np.repeat(ends[part] - n[part] - (ends[k] - n[k]), n[part])
            found = np.stack([np.repeat(text[part], n[part]), items[which], np.repeat(at[part] - first[text[part]], n[part]) - places[which]], 1)
            lined.append(np.unique(found, axis=0))
    for text, item, shift in np.unique(np.concatenate(lined), axis=0).tolist():
        own = seeds.words[seeds.first[item] : seeds.first[item + 1]]
        if (found := _better(_stretch(own, words[first[text] : first[text + 1]], shift), best.get((text, item)))) is not None:
            best[text, item] = found
    return [(text, item, start, length, count, int(seeds.first[item + 1] - seeds.first[item])) for (text, item), (count, start, length) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, equal_words long, item_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, first_word and n_words of the best stretch, equal_words in it, item_words.

    A stretch leaks if at least LEAK_WORDS of its words - or LEAK_ITEM of the
    item's, if that is fewer - equal the item's, and LEAK_EQUAL of all its
    words.  Items shorter than LEAST words leak only as wholes.

    Null and wordless texts and items hold nothing.  Repeated rows of documents
    repeat their leaks; repeated items are one item, and an id with several
    texts is as many items.  Rows with a null id on either side have their
    leaks with a null.  Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items, total = _items(benchmark, item_col, item_text_col)
    if total > BLOCK_WORDS:
        found = _joined(source, items)
        return source.select("doc_id", F.xxhash64("text").alias("text_hash")).join(found, ["text_hash"]).select("doc_id", *found.columns[1:])
    shared = _planted(items)

    def run(batch: pa.RecordBatch) -> pa.Table:
        names, seeds = shared.value
        ids = batch.column(0).to_pylist()
        rows = [(ids[text], names[item], *rest) for text, item, *rest in _found(seeds, batch.column(1))]
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(source, run, SCHEMA)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """The distinct items with a text, and an upper bound of their words."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    # A word and what parts it from the next take two bytes at least, but for characters of unspaced scripts, which take three.
    return items, (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 1


def _planted(items: DataFrame):
    """The ids and seeds of at most BLOCK_WORDS words, broadcast."""
    rows = sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r))
    names = [r[0] for r in rows]
    return items.sparkSession.sparkContext.broadcast((names, plant([n or 0 for n in names], [r[1] for r in rows])))


def _found(seeds: Seeds, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The leaks of a column's texts, with the text's place in it."""
    data, offsets = X.utf8(column)
    for a, b in X.blocks(offsets):
        for text, *rest in overlaps(seeds, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            yield a + text, *rest


def _joined(source: DataFrame, items: DataFrame) -> DataFrame:
    """(text_hash, item_id, ...) of the leaks of the distinct texts of ``source`` for a benchmark of any size."""
    spark = source.sparkSession
    scratch = Scratch(spark)
    items = scratch.write(items.withColumn("item", F.xxhash64("item_id", "text")), "items")

    def hashed(batch: pa.RecordBatch) -> pa.Table:
        keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        seeds = plant(keys.tolist(), texts)
        sizes = [len(h) for h in seeds.hashes]
        none = [np.empty(0, np.int64)]
        code, owner, place = (np.concatenate([*x, *none]) for x in ([h.view(np.int64) for h in seeds.hashes], seeds.items, seeds.places))
        assert sum(sizes) == len(code)
        return pa.table([pa.array(code.astype(np.int64)), pa.array(keys[owner.astype(np.int64)]), pa.array(place.astype(np.int64))], names=["code", "item", "place"])

    planted = scratch.write(map_batches(items.select("item", "text"), hashed, "code long, item long, place long"), "planted")
    # One row for each 64 bits of a filter of fixed size.
    slot = F.shiftrightunsigned("code", 64 - WIDE_BITS + 6)
    bits = planted.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - WIDE_BITS}) & 63 as int))")).alias("bits")).toArrow()
    passes = np.zeros(1 << (WIDE_BITS - 6), np.uint64)
    passes[bits["slot"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(passes)
    masks = (*SEEDS, *SHORT_SEEDS, *("1" * n for n in range(1, LEAST)))

    def probe(batch: pa.RecordBatch) -> pa.Table:
        passes, keys = shared.value, batch.column(0).to_numpy()
        data, offsets = X.utf8(batch.column(1))
        out: list[np.ndarray] = [np.empty((0, 3), np.int64)]
        for a, b in X.blocks(offsets):
            words, first = X.letter_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for mask in masks:
                h = seed_hashes(words, mask)
                slot = (h >> np.uint64(64 - WIDE_BITS + 6)).astype(np.int64)
                at = np.flatnonzero((passes[slot] >> ((h >> np.uint64(64 - WIDE_BITS)) & np.uint64(63))) & np.uint64(1))
                text = np.searchsorted(first, at, "right") - 1
                fits = at + len(mask) <= first[text + 1]
                at, text = at[fits], text[fits]
                out.append(np.stack([keys[a + text], h[at].view(np.int64), at - first[text]], 1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(found[:, k]) for k in range(3)], names=["text_hash", "code", "at"])

    texts = source.where("text is not null").select(F.xxhash64("text").alias("text_hash"), "text")
    hits = map_batches(texts, probe, "text_hash long, code long, at long").distinct()
    lined = hits.join(planted, "code").groupBy("text_hash", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    lined = scratch.write(hot_join(scratch.write(lined, "lined"), items.withColumnRenamed("text", "item_text"), ["item"]), "hits")
    wanted = texts.join(lined.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            words = X.letter_hashes(*X.utf8(right["text"]))[0]
            for item, text, shifts in zip(left["item_id"].to_pylist(), left["item_text"].to_pylist(), left["shifts"].to_pylist(), strict=True):
                own = X.letter_hashes(*X.utf8(pa.array([text], pa.large_string())))[0]
                best = None
                for shift in shifts:
                    best = _better(_stretch(own, words, shift), best)
                if best is not None:
                    rows.append((right["text_hash"][0].as_py(), item, best[1], best[2], best[0], len(own)))
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["text_hash", "item_id", "first_word", "n_words", "equal_words", "item_words"])

    found = lined.groupBy("text_hash").cogroup(wanted.groupBy("text_hash")).applyInArrow(verify, SCHEMA.replace("doc_id", "text_hash"))
    return scratch.write(found, "found")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no leak; all columns stay as they are.

    Rows pass through the scan whole, so that no join shuffles them, unless the
    benchmark is too large to broadcast.  Null and wordless texts have no leak;
    repeated rows go or stay together.
    """
    items, total = _items(benchmark, item_col, item_text_col)
    if total > BLOCK_WORDS:
        mark = fresh(docs, "text_hash")
        found = _joined(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), items).select(F.col("text_hash").alias(mark)).distinct()
        return docs.join(found, F.xxhash64(F.col(text_col).cast("string")) == F.col(mark), "left_anti")
    names, shared = docs.columns, _planted(items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = np.ones(batch.num_rows, bool)
        for text, *_ in _found(shared.value[1], batch.column(names.index(text_col)).cast(pa.string())):
            clean[text] = False
        return batch.filter(pa.array(clean))

    return map_batches(docs, run, docs.schema)
