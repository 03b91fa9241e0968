"""Bounded training samples drawn from labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % folds


#: Of a class with more rows than SPARE quotas, ids are first thinned to about SPARE / 4 quotas of rows.
SPARE = 64


def sample_ids(rows: DataFrame, class_col: str, quota: int) -> DataFrame:
    """(doc_id, class) of up to ``quota`` ids of each class, those with the least hashes; an id that stands in several classes is one of each.

    Classes are few: their counts are broadcast.  By those, ids whose hash is too
    large to be among the least are left out in the scan, so that a class brings
    some SPARE quotas of rows to its task, whatever the table's size.
    """
    counts = rows.groupBy(class_col).agg(F.count("*").alias("_n"))
    place = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    near = rows.select("doc_id", class_col).join(F.broadcast(counts), class_col)
    near = near.where((F.col("_n") <= SPARE * quota) | (place * F.col("_n") < SPARE / 4 * quota)).select("doc_id", class_col)
    rank = F.row_number().over(Window.partitionBy(class_col).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.distinct().withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def labelled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, label_col: str | None = None) -> DataFrame:
    """(doc_id, label, text) of the sampled ids, which are few enough to broadcast by their quota.

    With ``label_col``, a column of ``docs``, only rows that have the sampled label themselves.
    """
    own = [F.col(label_col).cast("string").alias("label")] if label_col else []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)
    return source.join(F.broadcast(ids), ["doc_id", "label"] if label_col else "doc_id")
