"""Joins that survive a key with a large share of the rows.

Keys of over a thousandth of the left rows, of which there can be at most a thousand, are joined by
broadcast, so that their rows stay where they are; all others meet by shuffle. A table of up to fifty
thousand rows is joined plainly: one task holds all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, FEW = 1000, 50_000


def hot_keys(left: DataFrame, key: str) -> DataFrame | None:
    """The keys of over a thousandth of the rows, as a table of at most a thousand rows; None if there are none."""
    total = left.count()
    if total <= FEW:
        return None
    counts = left.groupBy(key).agg(F.count("*").alias("rows"))
    found = [r[0] for r in counts.where((F.col("rows") * SHARE > total) & F.col(key).isNotNull()).select(key).collect()]
    return left.sparkSession.createDataFrame([(k,) for k in found], left.select(key).schema) if found else None


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, on the column ``key`` (how: inner, left,
    left_semi). ``left`` is read three times, so it should be a saved table."""
    hot = hot_keys(left, key)
    if hot is None:
        return left.join(right, key, how)
    if how == "left":
        few = hot.join(right, key, "left")
    else:
        few = right.join(F.broadcast(hot), key, "left_semi")
    spread = left.join(F.broadcast(few), key, "left_semi" if how == "left_semi" else "inner")
    return spread.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))
