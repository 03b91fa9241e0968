"""Near-duplicate detection by fast similarity sketches, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles.  The
sketch throws the set's elements into its bins in rounds: each round places
every element in one hashed bin, a bin keeps the least value of the first round
that reaches it, and later rounds send all elements to one fixed bin each, so
every bin fills whatever the set's size.  Equal coordinates come with
probability equal to the Jaccard similarity, concentrated as for independent
samples.  Runs of coordinates form bands; documents that share a band are
compared on their whole sets.

Scale.  Documents with equal sets are one node.  A bucket (documents with one
band in common) never emits its pairs: its members are first compared with its
least member, which makes a component of nearly every group in one linear
round; then with their other buckets' least members; and only then are members
of one bucket compared that lie in different components still.  A small bucket
does so pair by pair, after the triangle inequality of the Jaccard distance to
its least member has ruled out most; a crowded one in blocks that count common
shingles by postings and return only links that join two components.  All
rounds verify on the full sets.  Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _text as X
from tidewright.llm._spark import Scratch, components, fresh, map_batches

#: Coordinates in a band and bands: at a similarity of 0.8 a pair shares no band with probability 5e-7.
BAND_ROWS, BANDS = 6, 48
_NONE = np.uint64(2**64 - 1)
#: Buckets of up to so many documents compare what is still apart pair by pair; larger ones in blocks of about so many.
PAIRED, BLOCK = 48, 512


def sketch(shingles: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches (rows x bins) of sets given one after the other; empty sets get none of their bins filled."""
    sizes = np.diff(bounds)
    out = np.full(len(sizes) * bins, _NONE)
    live = np.flatnonzero(sizes)
    pool = shingles
    owner = np.repeat(np.arange(len(sizes)) * bins, sizes)
    for turn in range(2 * bins):
        if not len(live):
            break
        if turn:
            filled = (out.reshape(-1, bins)[live] != _NONE).all(1)
            if filled.any():
                gone = np.zeros(len(sizes), bool)
                gone[live[filled]] = True
                stay = ~gone[owner // bins]
                pool, owner, live = pool[stay], owner[stay], live[~filled]
                if not len(live):
                    break
        value = X.mix64(pool ^ X.mix64(np.array([turn + 1], np.uint64))[0])
        if turn < bins:
            place = owner + (((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        else:
            place = owner + (turn - bins)
        free = out[place] == _NONE
        np.minimum.at(out, place[free], X.mix64(value[free]) >> np.uint64(1))
    return out.reshape(-1, bins)


def band_hashes(sketches: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sketches.shape
    odd = X.mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    mixed = (sketches.reshape(n, bins // rows, rows) * odd).sum(2, dtype=np.uint64)
    return X.mix64(mixed ^ X.mix64(np.arange(7_000_001, 7_000_001 + bins // rows, dtype=np.uint64)))


def _long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(k: int, rows: int, bands: int):
    def run(batch: pa.RecordBatch) -> pa.Table:
        data, offsets = X.utf8(batch.column(1))
        parts = []
        for a, b in X.blocks(offsets):
            base = offsets[a]
            shingles, bounds = X.shingle_sets(data[base : offsets[b]], offsets[a : b + 1] - base, k)
            n = np.diff(bounds)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(X.mix64(shingles ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x5BD1E995, 0x1B873593)]
            keys = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            hashes = band_hashes(sketch(shingles, bounds, rows * bands), rows)
            hashes = hashes[n > 0].ravel()
            lists = _long_lists(hashes, np.concatenate([[0], np.cumsum((n > 0) * bands)]))
            parts.append(pa.table([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), lists], names=["doc_id", "n", "k1", "k2", "bands"]))
        return pa.concat_tables(parts)

    return run


def _sets(k: int):
    def run(batch: pa.RecordBatch) -> pa.Table:
        data, offsets = X.utf8(batch.column(1))
        parts = []
        for a, b in X.blocks(offsets):
            base = offsets[a]
            shingles, bounds = X.shingle_sets(data[base : offsets[b]], offsets[a : b + 1] - base, k)
            parts.append(pa.table([batch.column(0).slice(a, b - a).cast(pa.int64()), _long_lists(shingles, bounds)], names=["doc", "items"]))
        return pa.concat_tables(parts)

    return run


def _cross_links(percent: int):
    """Of one block of a crowded bucket: for each two components, a link between them if there is one."""

    def run(block: pa.Table) -> pa.Table:
        doc, own = block["doc"].to_numpy(), block["own"].to_numpy()
        lists = block["items"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        sizes = np.diff(lists.offsets.to_numpy())
        _, item = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        holder = np.repeat(np.arange(len(doc)), sizes)
        by_item = np.argsort(item, kind="stable")
        posting, first = holder[by_item], np.concatenate([[0], np.cumsum(np.bincount(item))])
        ends = np.cumsum(sizes)
        names, sets_of = np.unique(own, return_inverse=True)
        main = np.bincount(sets_of).argmax()
        found = {}
        for row in np.flatnonzero(sets_of != main):
            mine = item[ends[row] - sizes[row] : ends[row]]
            at, length = first[mine], first[mine + 1] - first[mine]
            steps = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(at, length)
            common = np.bincount(posting[steps], minlength=len(doc))
            for other in np.flatnonzero((common * 100 >= (sizes + sizes[row] - common) * percent) & (sets_of != sets_of[row])):
                pair = (min(own[row], own[other]), max(own[row], own[other]))
                found.setdefault(pair, (max(doc[row], doc[other]), min(doc[row], doc[other])))
        a, b = zip(*found.values(), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, band_rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z and split at ASCII white space; a text with
    fewer words than a shingle has its whole sequence as its one shingle.  Two
    documents link if 100 * |intersection| >= percent * |union|, confirmed on
    their whole sets; component_id is the smallest id reachable over links and
    kept says that it is the row's own.

    Null and empty texts and texts of white space have no shingles and link
    with nothing.  Repeated rows and rows that repeat an id count as one
    document, which links if one of its texts does.  A row with a null id has
    a null component and is kept.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drawn = scratch.write(map_batches(source, _sketches(shingle_words, band_rows, bands), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "sketches")
    classes = scratch.write(drawn.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = scratch.write(drawn.where("n > 0").select("doc_id", "n", "bands").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "heads")
    bucket = heads.select(F.col("doc_id").alias("doc"), "n", F.explode("bands").alias("band"))
    shared = bucket.groupBy("band").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head <> last").select("band", "head")
    members = scratch.write(bucket.join(shared, "band").select("band", "head", "doc"), "members")
    scratch.drop(heads)
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = scratch.write(map_batches(source.join(wanted, "doc_id", "left_semi"), _sets(shingle_words), "doc long, items array<long>").distinct(), "sets")
    mine = sets.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    theirs = sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Pairs (a, b) with the size of their sets' intersection and union; those whose sizes alone rule a link out have a bound."""
        both = pairs.join(mine, "a").join(theirs, "b")
        small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
        common = F.when(small * 100 >= large * percent, F.size(F.array_intersect("x", "y")))
        found = both.select("a", "b", common.cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))
        return scratch.write(found, label)

    def links(pairs: DataFrame) -> DataFrame:
        return pairs.where((F.col("common") * 100) >= (F.col("sizes") - F.col("common")) * percent).select("a", "b")

    stars = members.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    first = verified(stars.groupBy("a").agg(F.min("b").alias("b")), "first")
    edges = links(first)
    found = components(scratch, edges)

    def labelled(pairs: DataFrame, on: str, name: str) -> DataFrame:
        joined = pairs.join(found.select(F.col("node").alias(on), F.col("component").alias(name)), on, "left")
        return joined.withColumn(name, F.coalesce(name, F.col(on)))

    apart = labelled(labelled(stars.distinct(), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    second = verified(apart.join(first.select("a", "b"), ["a", "b"], "left_anti"), "second")
    edges = scratch.write(edges.union(links(second)).distinct(), "links")
    found = components(scratch, edges)

    known = first.union(second).where("common is not null").select(F.col("a").alias("doc"), F.col("b").alias("head"), (1 - F.col("common") / (F.col("sizes") - F.col("common"))).alias("far"))
    placed = labelled(members, "doc", "own")
    mixed = placed.groupBy("band").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("band")
    placed = placed.join(mixed, "band").join(known.groupBy("doc", "head").agg(F.min("far").alias("far")), ["doc", "head"], "left").withColumn("far", F.when(F.col("doc") == F.col("head"), 0.0).otherwise(F.col("far")))
    placed = scratch.write(placed.select("band", "doc", "own", "far"), "mixed")
    crowds = placed.groupBy("band").agg(F.count("*").alias("m"))
    few = placed.join(crowds.where(F.col("m") <= PAIRED), "band", "left_semi")
    left, right = few.alias("l"), few.alias("r")
    reach = (1 - percent / 100) + 1e-9
    near = F.coalesce(F.abs(F.col("l.far") - F.col("r.far")) <= reach, F.lit(True))
    rest = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.doc") > F.col("r.doc")) & (F.col("l.own") != F.col("r.own")) & near)
    rest = rest.select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).distinct()
    third = verified(rest.join(first.union(second).select("a", "b"), ["a", "b"], "left_anti"), "third")
    many = placed.join(crowds.where(F.col("m") > PAIRED).withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")), "band").withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    blocks = many.select("band", "doc", "own", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("band", "doc", "own", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    blocks = blocks.join(sets, "doc").select("band", "i", "j", "doc", "own", "items")
    crossed = scratch.write(blocks.groupBy("band", "i", "j").applyInArrow(_cross_links(percent), "a long, b long"), "crossed")
    found = components(scratch, edges.union(links(third)).union(crossed))

    lead = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").where("copies > 1 or component is not null")
    lead = lead.select("k1", "k2", "n", F.coalesce("component", "rep").alias("lead"))
    out = drawn.select("doc_id", "n", "k1", "k2").join(lead, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("lead", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that near_duplicates() does not keep; all columns stay as they are.

    Of rows that repeat an id and a text one stays, null ids among them; an id
    with several texts keeps one row of each if it is kept.
    """
    mark, key = fresh(docs, "gone"), F.col(id_col).cast("long")
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias(mark))
    out = docs.join(gone.distinct(), key == F.col(mark), "left_anti")
    scratch = Scratch(docs.sparkSession)
    twice = scratch.write(docs.groupBy(key.alias(mark)).count().where("count > 1").select(mark), "twice")
    if twice.isEmpty():
        return out
    same = key.eqNullSafe(F.col(mark))
    return out.join(twice, same, "left_anti").union(out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
