"""Sharding by sampled splitters (law ``bytes``: sizes of shards near equal).

Records are ordered by (hash of the text, id). A size-weighted sample of these keys gives quantile
splitters; records are dealt by range, ranges that turn out overfull are split again, and exact
prefix sums over the ranges' totals turn the position of a record into its shard. Equal texts have
equal hashes, so they are neighbours, and no splitter falls between them unless they are a hot group, that is,
weigh more than ``slack`` of a shard; only a hot group can lie in more than one shard.

Large tables get splitters on two levels: up to ``coarse`` ranges from a sample that the driver sorts, and inside
each of these the quantiles of a sample taken by the tasks, so that a range stays near 64 MB. The driver holds
the splitters, 32 bytes for each 64 MB of data.

Defined results: a null text has size 1 and the checksum of no bytes (0); an empty table gives no
rows; rows with equal id and text are ordered arbitrarily but get distinct slots; a null id sorts as an empty one;
input columns named like an output column, in any case, are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docquarry.llm.textkeys import quoted
from docquarry.session import saved, table

OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: A splitter: hash and id. One with an empty id lies before all rows of its hash.
Splitter = tuple[int, str]


def _measured(df: DataFrame, text: str, key: str) -> DataFrame:
    """rec (the columns that stay), size, crc, hash and key of each row."""
    t, k = F.col(quoted([text])[0]), F.col(quoted([key])[0])
    stay = [c for c in df.columns if c.lower() not in OUTPUT]
    return df.select(
        F.struct(*quoted(stay)).alias("rec"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(t).alias("hash"),
        F.coalesce(k.cast("string"), F.lit("")).alias("key"),
    )


def _range_of(splitters: list[Splitter]) -> Column:
    """The number of splitters at or before (hash, key): a binary search over a batch of rows."""
    cuts = np.array([h for h, _ in splitters], np.int64)
    inside = [(i, x) for i, x in enumerate(splitters) if x[1]]  # those inside hot groups: few
    hot = {h for _, (h, _) in inside}
    some = {h: [(i, x) for i, x in inside if x[0] == h] for h in hot}

    @F.pandas_udf(IntegerType())
    def place(h: pd.Series, k: pd.Series) -> pd.Series:
        own = h.to_numpy(np.int64)
        out = np.searchsorted(cuts, own, "right")
        for i in np.flatnonzero(np.isin(own, list(hot))) if hot else ():
            mine = some[int(own[i])]
            out[i] = mine[0][0] + bisect.bisect_right([x for _, x in mine], (int(own[i]), k.iat[i]))
        return pd.Series(out.astype(np.int32))

    return place(F.col("hash"), F.col("key"))


def _quantiles(sample: list[Splitter], parts: int) -> list[Splitter]:
    sample = sorted(sample)
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def _totals(placed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range, bytes and rows of each range that has rows, by range."""
    t = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").toPandas()
    return tuple(t[c].to_numpy(np.int64) for c in ("range", "bytes", "rows"))


def splitters(narrow: DataFrame, total: int, ranges: int, hot: set[int], coarse: int = 4096, per_range: int = 40, rounds: int = 3) -> list[Splitter]:
    """Splitters for about ``ranges`` ranges of rows (hash, key, size); only those of a ``hot`` hash have an id.

    The sample that the driver sorts is bounded by ``coarse * per_range`` keys in expectation; a range over
    twice its share is sampled and split again.
    """
    first = min(ranges, coarse)

    def whole(xs: list[Splitter]) -> set[Splitter]:
        return {x if x[0] in hot else (x[0], "") for x in xs}

    def draw(df: DataFrame, weight: int, n: int, salt: int) -> DataFrame:
        u = F.pmod(F.xxhash64("hash", "key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
        return df.where(u < F.col("size") * (n / max(weight, 1)))

    def drawn(df: DataFrame, weight: int, n: int, salt: int) -> list[Splitter]:
        return [(r[0], r[1]) for r in draw(df, weight, n, salt).select("hash", "key").collect()]

    cuts = sorted(whole(_quantiles(drawn(narrow, total, first * per_range, 0), first)))
    for turn in range(1, rounds):
        placed = narrow.withColumn("range", _range_of(cuts))
        over = {int(r): int(b) for r, b, n in zip(*_totals(placed), strict=True) if b > 2 * total / first and n > 1}
        if not over:
            break
        parts = {r: -(-b * first // total) for r, b in over.items()}
        by_range: dict[int, list[Splitter]] = {}
        for x in drawn(placed.where(F.col("range").isin(list(over))), sum(over.values()), sum(parts.values()) * per_range, turn):
            by_range.setdefault(bisect.bisect_right(cuts, x), []).append(x)
        new = whole([x for r, xs in by_range.items() for x in _quantiles(xs, parts.get(r, 1))])
        if new <= set(cuts):
            break
        cuts = sorted(set(cuts) | new)
    if ranges > first:  # the second level: quantiles of each range, found by the tasks
        each = -(-ranges // first)
        sample = draw(narrow, total, ranges * per_range, rounds).withColumn("range", _range_of(cuts))
        found = sample.groupBy("range").agg(F.percentile_approx("hash", [i / each for i in range(1, each)], 100 * each).alias("q")).select(F.explode("q").alias("hash")).distinct()
        cuts = sorted({*cuts, *((int(h), "") for h in found.toPandas()["hash"])})
    return cuts


def shard(df: DataFrame, n_shards: int = 16, text: str = "text", key: str = "doc_id", ranges_per_shard: int = 8, slack: float = 1 / 64, range_bytes: int = 1 << 26, coarse: int = 4096) -> DataFrame:
    """All rows of ``df`` with size, text_crc32, law, shard, slot and grown_shard.

    ``ranges_per_shard`` sets the number of ranges for small inputs; larger inputs get as many as keep
    a range near ``range_bytes``.
    """
    measured = _measured(df, text, key)
    narrow = saved(measured.select("hash", "key", "size"), "shard-keys")
    total, rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(total, 1) / n_shards
    # Fewer than n_shards / slack.
    hot = {r[0] for r in narrow.groupBy("hash").agg(F.sum("size").alias("b")).where(F.col("b") > slack * share).select("hash").collect()}
    cuts = splitters(narrow, total, max(n_shards * ranges_per_shard, total // range_bytes), hot, coarse) if rows else []
    place, size, count = _totals(narrow.withColumn("range", _range_of(cuts)))
    spark = df.sparkSession
    starts = spark.createDataFrame(pa.table({"range": place.astype(np.int32), "bytes_before": np.cumsum(size) - size, "rows_before": np.cumsum(count) - count}))

    def positioned(x: DataFrame) -> DataFrame:
        in_order = Window.partitionBy("range").orderBy("hash", "key")
        group = Window.partitionBy("range", "hash")
        before = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        x = x.withColumn("range", _range_of(cuts)).repartition("range").join(F.broadcast(starts), "range")
        x = x.withColumns({"at": F.col("bytes_before") + before, "n": F.col("rows_before") + F.row_number().over(in_order) - 1})
        x = x.withColumns({"group_at": F.min("at").over(group), "group_size": F.sum("size").over(group)})
        whole = F.col("group_size") <= slack * share
        middle = F.when(whole, F.col("group_at") + F.col("group_size") / 2).otherwise(F.col("at") + F.col("size") / 2)
        return x.withColumn("shard", F.least(F.floor(middle / share), F.lit(n_shards - 1)).cast("int"))

    placed = positioned(narrow).groupBy("shard").agg(F.min("n").alias("first")).collect()  # at most n_shards rows
    first = spark.createDataFrame([(r[0], r[1]) for r in placed], "shard int, first long")
    out = positioned(measured).join(F.broadcast(first), "shard")
    return out.select(
        "rec.*",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("n") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", *OUTPUT)
