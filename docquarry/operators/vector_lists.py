"""Exact vector search that skips most of the index, by lists around centroids and the triangle inequality.

Vectors are brought to length one, where cosine distance is half the squared Euclidean one. Each row lies in the list
of its nearest centroid, and a list's radius is its farthest row's distance from the centroid. No row of a list is
nearer to a query than the centroid's distance less the radius, so lists are read in the order of that bound until no
list that is left can hold a nearer row than the k-th found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.search import _unit, distances

#: Rounding of distances between vectors of length one.
SLACK = 1e-7


def centroids(index: DataFrame, n_lists: int, vector: str = "embedding", most_rows: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of at most ``n_lists`` groups, fitted on the first ``most_rows`` rows by hash (a bounded sample: it
    decides how much is skipped, never what is found)."""
    rows = index.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("v", F.lit(seed))).limit(most_rows).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = _unit(rows.column("v").combine_chunks())
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n_lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), c)
    return c


@dataclass
class Found:
    rows: DataFrame
    lists_read: int
    lists: int


class VectorLists:
    """An index saved at ``path``: rows in folders by list, and what is known of each list.

    The driver holds the centroids (``n_lists`` vectors). Rows without a vector are in no list; zero vectors, at
    distance 1 from everything, are in list -1. An empty index has no lists.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.rows = self._rows(spark, path)
        known = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # a row a list
        self.list = np.array([r["list"] for r in known], np.int64)
        self.size = np.array([r["size"] for r in known], np.int64)
        self.radius = np.array([r["radius"] for r in known])
        self.centre = [r["centre"] for r in known]

    @staticmethod
    def _rows(spark: SparkSession, path: str) -> DataFrame:
        """The rows, by the schema of an empty table beside them: an empty index has no files to tell it."""
        return spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")

    @classmethod
    def build(cls, index: DataFrame, path: str, n_lists: int = 64, key: str = "vec_id", vector: str = "embedding") -> VectorLists:
        c = centroids(index, n_lists, vector)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _unit(b.column("__v")) if b.num_rows else np.zeros((0, c.shape[1]))
                cosine = x @ c.T if len(c) else np.zeros((len(x), 1))
                near = np.where(np.linalg.norm(x, axis=1) > 0, np.argmax(cosine, 1), -1)
                far = np.linalg.norm(x - c[near], axis=1) if len(c) else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(near, pa.int64()), pa.array(np.where(near < 0, 0, far), pa.float64())], names=[*b.schema.names[:-1], "__list", "__off"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
        kept = index.where(F.col(vector).isNotNull()).withColumn("__v", F.col(vector).cast("array<double>"))
        rows = kept.mapInArrow(placed, f"{schema}, __list long, __off double")
        rows.repartition("__list").sortWithinPartitions("__list", key).write.partitionBy("__list").parquet(f"{path}/rows")
        rows.limit(0).write.parquet(f"{path}/shape")
        spark = index.sparkSession
        known = cls._rows(spark, path).groupBy(F.col("__list").alias("list")).agg(F.count("*").alias("size"), F.max("__off").alias("radius"))
        centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list long, centre array<double>")
        known.join(centres, "list", "left").write.parquet(f"{path}/lists")
        return cls(spark, path)

    def topk(self, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> Found:
        """The k nearest rows by cosine distance, ties by key, and how many lists were read."""
        q = np.asarray(query, np.float64)
        n = np.linalg.norm(q)
        q = q / n if n > 0 else q
        # A zero vector is at distance 1, as vectors at a right angle are: sqrt(2) on the sphere.
        off = np.array([np.sqrt(2) if c is None or n == 0 else np.linalg.norm(q - np.array(c)) for c in self.centre])
        bound = np.maximum(0, off - np.where(self.list < 0, 0, self.radius)) if n > 0 else np.full(len(self.list), np.sqrt(2))
        order = np.argsort(bound, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(self.size[order]), k)) + 1]

        def nearest(lists: np.ndarray) -> DataFrame:
            return distances(self.rows.where(F.col("__list").isin(self.list[lists].tolist())), query, vector).orderBy("distance", key).limit(max(0, k)).drop("__list", "__off")

        got = nearest(first).select("distance").collect()  # k numbers
        reach = np.sqrt(2 * max(r[0] for r in got)) + SLACK if len(got) == k and k else np.inf
        lists = np.flatnonzero((bound <= reach) | np.isin(np.arange(len(bound)), first))
        return Found(nearest(lists), len(lists), len(self.list))
