"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows are grouped by equal text.  Groups that hold more than a small part of the
table are items of their own, the others share a fixed number of hashed items;
groups larger than a shard's fair share are cut first, by the number that each
row got when it was written, so that repeated ids part as well.  Only the items'
totals - a bounded number, whatever the table's size - reach the driver, which
places them from the largest down, each in the shard whose residual capacity
has the highest dot product with it, and then moves and swaps items while that
brings the shards' bytes, tokens and rows nearer to equal.  Slots come from
running counts of cells of bounded size, so that no task orders a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm._spark import Scratch

#: Parts of the table: a group above one of them in bytes, tokens or rows is an item of its own.
PARTS = 2048
#: Rows that a cell is meant to have; a task orders one cell at a time.
CELL_ROWS = 250_000
#: What unequal bytes, tokens and rows count, as the law is of bytes.
WEIGHTS = np.array([4.0, 1.0, 1.0])
#: An exchange must lessen the imbalance by this share of it.
GAIN = 1e-3


def imbalance(held: np.ndarray) -> float:
    """The weighed squares of the shards' deviations from a fair share; ``held`` has them as shares (shards x 3)."""
    return float((WEIGHTS * (held - 1) ** 2).sum())


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item.  ``items``: rows of (bytes, tokens, rows).

    Equal items are placed in order; of equally good shards the first is taken.
    Items without bytes, tokens and rows are of no weight anywhere.
    """
    items = np.asarray(items, float).reshape(-1, 3)
    total = items.sum(0)
    share = items / np.where(total > 0, total / shards, 1)
    residual = np.ones((shards, 3))
    out = np.zeros(len(items), int)
    for k in np.lexsort((np.arange(len(items)), -share.sum(1), -share.max(1))):
        room = residual @ share[k]
        # A shard already past its bytes takes nothing more while another has room.
        open_ = residual[:, 0] > 0
        out[k] = at = int(np.argmax(np.where(open_, room, -np.inf))) if open_.any() else int(np.argmax(residual[:, 0]))
        residual[at] -= share[k]
    _even_out(share, out, shards)
    return out


def _even_out(share: np.ndarray, home: np.ndarray, shards: int) -> None:
    """Moves the item, or swaps the two of the most unequal shards, that lessens the imbalance most, until neither does by GAIN."""
    if not len(share):
        return
    held = np.zeros((shards, 3))
    np.add.at(held, home, share)
    own = (share * share) @ WEIGHTS
    while (now := imbalance(held)) > 1e-12:
        # What each move of an item to each shard would change.
        change = 2 * ((share * WEIGHTS) @ held.T - ((share * WEIGHTS) * held[home]).sum(1)[:, None]) + 2 * own[:, None]
        change[np.arange(len(share)), home] = 0
        item, to = np.unravel_index(change.argmin(), change.shape)
        best, pair = change[item, to], None
        if best > -GAIN * now:
            order = np.argsort((WEIGHTS * (held - 1) ** 2).sum(1))[::-1]
            for a, b in [(order[0], x) for x in order[1:]] + [(order[1], x) for x in order[2:]]:
                mine, theirs = np.flatnonzero(home == a), np.flatnonzero(home == b)
                if not len(mine) or not len(theirs):
                    continue
                # A swap moves the difference d: |a - d|^2 + |b + d|^2 less |a|^2 + |b|^2, weighed.
                gap = WEIGHTS * (held[b] - held[a])
                line = 2 * (share[mine] @ gap)[:, None] - 2 * (share[theirs] @ gap)[None]
                both = own[mine][:, None] + own[theirs][None] - 2 * (share[mine] * WEIGHTS) @ share[theirs].T
                swap = line + 2 * both
                x, y = np.unravel_index(swap.argmin(), swap.shape)
                if swap[x, y] < best:
                    best, pair = swap[x, y], (mine[x], theirs[y])
        if best > -GAIN * now:
            return
        for k, place in ((item, to),) if pair is None else ((pair[0], home[pair[1]]), (pair[1], home[pair[0]])):
            held[home[k]] -= share[k]
            held[place] += share[k]
            home[k] = place


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, n_words, item.

    The law is ``bytes``: sizes (UTF-8 bytes plus 1) are near equal between
    shards, with words and rows as near as that allows.  Slots are gapless from
    0 in each shard; grown_shard is null, as growth moves rows under this law.

    A null text has size 1, checksum 0 and no words, and is a group apart from
    the empty text only in name: both have the same size and checksum.  Rows
    with equal or null ids are rows like others.  An empty table gives an empty
    result.  Rows of one text share a shard unless their group is larger than a
    shard's fair share; then its rows part evenly, whatever their ids.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col(text_col).cast("string")
    blank = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(blank) + 1).cast("long").alias("size"),
        F.crc32(blank.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.regexp_count(blank, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.write(rows, "rows")
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    group = ["key", "text_crc32", "size"]
    large = rows.groupBy(*group).agg(*sums).where(" or ".join(f"{k} * {PARTS}D > {total[k]}D" for k in ("bytes", "words", "rows")))
    # At most three times PARTS groups can be above one part.
    large = sorted(large.collect(), key=lambda r: tuple(r))
    cuts = [max(1, math.ceil(8 * shards * part)) if (part := max(r[k] / max(total[k], 1) for k in ("bytes", "words", "rows"))) > 1 / shards else 1 for r in large]
    own = spark.createDataFrame([(r.key, r.text_crc32, r.size, n, c) for n, (r, c) in enumerate(zip(large, cuts, strict=True))], "key long, text_crc32 long, size long, own int, cuts int")
    placed = rows.join(F.broadcast(own), group, "left")
    piece = F.pmod(F.xxhash64(F.lit(1), "row"), F.coalesce("cuts", F.lit(1)))
    item = F.when(F.col("own").isNull(), -1 - F.pmod("key", F.lit(PARTS))).otherwise(F.col("own").cast("long") * (1 << 32) + piece)
    placed = placed.withColumn("item", item).drop("own", "cuts")
    # At most PARTS shared items, three times PARTS of their own, and the pieces of those cut.
    items = sorted((tuple(r) for r in placed.groupBy("item").agg(*sums).collect()), key=lambda r: r[0])
    where = pack(np.array([r[1:] for r in items]), shards)
    homes = [(r[0], int(s), max(1, math.ceil(r[3] / CELL_ROWS))) for r, s in zip(items, where, strict=True)]
    placed = placed.join(F.broadcast(spark.createDataFrame(homes, "item long, shard int, parts int")), "item")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(F.lit(2), "row"), "parts"))
    before = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("shard", "item", "cell").agg(F.count("*").alias("n"))
    starts = cells.select("item", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32", "row")
    out = placed.withColumn("at", F.row_number().over(order) - 1).join(starts, ["item", "cell"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "n_words", "item",
    )
