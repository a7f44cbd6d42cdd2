"""Exact dedup over a persistent digest index, with DataFrame and SQL functions only.

The index is a Parquet table bucketed and sorted by digest. A table is fed to it in bands of falling length: a
band is reduced to one winner per digest (partial aggregation, so that a hot text costs one row a task),
anti-joined against the index by sort-merge on the buckets, and the new digests are appended. Of equal texts the
longest original comes in the first band that has any of them, so what the index has then is what stays.

Two texts are equal when identical after deleting space and the characters U+0009 to U+000D. In one table the
row with the most code points of original text, then the smallest doc_id, stays; across tables, what the index
has stays. A null text counts as empty; empty texts are equal to each other; of rows repeating doc_id and text,
all count and all have the same winner; a row without doc_id stays only where all its equals have none. An empty
table gives no rows. Only the id and the text are read, so other columns may have any names. An index has one
writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.skewed import joined
from docquarry.llm.textkeys import quoted
from docquarry.session import new_path, saved, table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digested(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key as doc_id, code points of the original text, and the SHA-256 of the normalised text."""
    return docs.select(
        F.col(quoted([key])[0]).alias("doc_id"),
        F.length(F.coalesce(F.col(quoted([text])[0]), F.lit(""))).cast("long").alias("n_points"),
        F.unhex(F.sha2(normalised(F.col(quoted([text])[0])), 256)).alias("digest"),
    )


def winners(digests: DataFrame) -> DataFrame:
    """digest, keep_id: one row per distinct digest."""
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    return digests.groupBy("digest").agg(best["c"].alias("keep_id"))


class DigestIndex:
    """A table (digest, keep_id) bucketed and sorted by digest, at ``path`` of a shared folder.

    ``open`` on an existing path registers the bucketing again, so that an index outlives a session.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's winners whose digest the index lacks: sort-merge anti-join, no shuffle of the index."""
        return batch.hint("merge").join(self.table().select("digest"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        rows = fresh.select("digest", F.col("keep_id").cast("long").alias("keep_id")).repartition(self.buckets, "digest")
        rows.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")


def buckets_for(rows: int) -> int:
    """One bucket for two million digests, between 16 and 8192."""
    return max(16, min(8192, rows // 2_000_000))


def length_bands(digests: DataFrame, bands: int) -> list[Column]:
    """Conditions on n_points that cut the rows into about equal parts, the longest texts first."""
    cuts = digests.agg(F.percentile_approx("n_points", [i / bands for i in range(1, bands)])).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    n = F.col("n_points")
    return [*(((n > low) if high is None else (n > low) & (n <= high)) for high, low in zip([None, *cuts], cuts, strict=False)), (n <= cuts[-1]) if cuts else F.lit(True)]


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", key: str = "doc_id", bands: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size (rows of this table), kept, text_sha256 of every row; new digests join the
    index. Without an index one is made for this table, and dropped from the catalog in the end."""
    spark = docs.sparkSession
    digests = saved(digested(docs, text, key), "digests")
    own = index or DigestIndex(spark, new_path(spark, "digest-index"), buckets_for(digests.count()))
    for band in length_bands(digests, bands):
        own.append(saved(own.unseen(winners(digests.where(band))), "unseen"))
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    final = saved(sizes.hint("merge").join(own.table(), "digest"), "kept")
    if index is None:
        own.close()
    return joined(digests, final, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = {
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256
FROM d"""
}
