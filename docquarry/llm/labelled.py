"""The bounded sample of labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_ids(labels: DataFrame, label: str, most_of_each: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most_of_each[c]`` training rows (doc_id, y) of class c, the first by hash of the id, and
    how many there are of each class. An id with several labels counts once, by its highest."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    parts = [rows.where(F.col("y") == c).orderBy(order, "doc_id").limit(n) for c, n in most_of_each.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, total
