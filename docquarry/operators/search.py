"""Vector, lexical and fused search."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import terms
from docquarry.functions.vectors import distances_to

#: Rows that a task compares with all queries of its block at once: three arrays of 16 MB at most.
SLICE = 256


def matches(filters: dict[str, Any]) -> Column:
    """All of key = value, as plain comparisons that scans can push down; an absent (null) key matches only
    a null value."""
    for key, value in filters.items():
        if not isinstance(key, str) or not key.strip():
            raise ValueError("filter keys must be non-blank strings")
        if isinstance(value, float) and not np.isfinite(value) or not isinstance(value, (str, int, float, bool, type(None))):
            raise ValueError("filter values must be finite scalars")
    out = F.lit(True)
    for key, value in filters.items():
        out = out & (F.col(key).isNull() if value is None else F.col(key) == F.lit(value))
    return out


def browse(records: DataFrame, key: str, offset: int, limit: int, filters: dict[str, Any] | None = None, text: str | None = None, contains: str | None = None) -> DataFrame:
    """A page of records by key, with total and has_more; limit is 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100, offset at least 0")
    rows = records.where(matches(filters or {}))
    if contains:
        rows = rows.where(F.col(text).contains(contains))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(key).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def distances(index: DataFrame, query: list[float], vector: str = "embedding", metric: str = "cosine", filters: dict[str, Any] | None = None) -> DataFrame:
    """The rows that match, with their distance to the query."""
    return index.where(matches(filters or {})).withColumn("distance", distances_to(query, metric)(F.col(vector).cast("array<double>")))


def vector_topk(index: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", filters: dict[str, Any] | None = None) -> DataFrame:
    """The k nearest rows by (distance, key): a filtered scan, distances by batch, TakeOrderedAndProject.

    Vectors of another dimension than the query's are errors (see ``vectors.is_vector`` for checks).
    """
    return distances(index, query, vector, metric, filters).orderBy("distance", key).limit(max(0, k))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of an array column as vectors of length one; a zero vector stays."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def batch_topk(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", exclude_self: bool = False, query_rows: int = 8192, index_rows: int = 16384) -> DataFrame:
    """query_id, key, distance, rank: the k nearest rows of each query by cosine distance, ties by key.

    Queries and index form a grid of blocks of about ``query_rows`` and ``index_rows`` rows. A task multiplies one block
    of each and keeps k rows for each query; these meet by query. No row passes through the driver. The index is sent
    once for each block of queries, so few queries are cut finer, but into eight blocks at most.
    """
    n_q, n_x = queries.count(), max(1, -(-index.count() // index_rows))
    n_q = max(1, -(-n_q // query_rows), min(8, -(-n_q // 2048)))

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        floats = df.schema[df.columns[1]].dataType.simpleString() == "array<float>"  # sent as they are
        v = F.col(df.columns[1]) if floats else F.col(df.columns[1]).cast("array<double>")
        salted = df.select(F.col(df.columns[0]).cast("long").alias("__id"), v.alias("__v")).where("__id IS NOT NULL AND __v IS NOT NULL")
        salted = salted.withColumn(own, F.pmod(F.xxhash64("__id", "__v"), F.lit(n_own)).cast("int"))
        return salted.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def cell(q: pa.Table, x: pa.Table) -> pa.Table:
        out_q, out_k, out_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if q.num_rows and x.num_rows and k:
            ids, a = q.column("__id").to_numpy(), _unit(q.column("__v").combine_chunks())
            keys, rest = x.column("__id").to_numpy(), _unit(x.column("__v").combine_chunks())
            best_d, best_k = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for i in range(0, len(keys), SLICE):
                some = keys[i : i + SLICE]
                d = np.round(1 - np.clip(a @ rest[i : i + SLICE].T, -1, 1), 12)  # equal vectors tie, whatever block they are in
                if exclude_self:
                    d[ids[:, None] == some[None, :]] = np.inf
                near = np.flatnonzero((d <= best_d[:, -1:]).any(1))  # queries for which this slice has something
                all_d, all_k = np.concatenate([best_d[near], d[near]], 1), np.concatenate([best_k[near], np.broadcast_to(some, (len(near), len(some)))], 1)
                order = np.lexsort((all_k, all_d), axis=1)[:, :k]
                best_d[near], best_k[near] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_k, order, 1)
            i, j = np.nonzero(np.isfinite(best_d))
            out_q, out_k, out_d = ids[i], best_k[i, j], best_d[i, j]
        return pa.table({query_key: out_q, key: out_k, "distance": out_d})

    left = blocks(queries.select(query_key, vector), "__q", n_q, "__x", n_x).groupBy("__q", "__x")
    right = blocks(index.select(key, vector), "__x", n_x, "__q", n_q).groupBy("__q", "__x")
    out = left.cogroup(right).applyInArrow(cell, f"{query_key} long, {key} long, distance double")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def semantic_hits(topk: DataFrame, chunk: str, source: Column) -> DataFrame:
    """Hits of a vector search: rank and semantic_score = 1 - distance."""
    rank = F.row_number().over(Window.orderBy("distance", chunk))  # k rows
    return topk.select(source.alias("source_ref"), F.col(chunk).alias("chunk_ref"), rank.alias("rank"), (1 - F.col("distance")).alias("semantic_score"))


def metadata_text(*values: Column) -> Column:
    """What lexical search reads: the metadata's strings, in order."""
    return F.concat_ws(" ", *values)


def lexical_search(records: DataFrame, query: str, text: Column, k: int, key: str = "chunk_ref") -> DataFrame:
    """Rows whose text holds a term of the query as a substring; keyword_score is the share of terms held."""
    one = records.sparkSession.range(1).select(terms(F.lit(query)).alias("t")).first()
    words = list(one["t"])
    if not words or k < 1:
        return records.withColumns({"keyword_score": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    low = F.lower(text)
    held = sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
    top = records.withColumn("keyword_score", held / float(len(words))).where("keyword_score > 0").orderBy(F.desc("keyword_score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("keyword_score"), key)))  # k rows


def fuse(semantic: DataFrame, lexical: DataFrame, k: int, constant: int = 60, key: str = "chunk_ref") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: sum of 1 / (constant + rank), ties by key."""
    a = semantic.select(key, "rank", "semantic_score", F.lit(None).cast("double").alias("keyword_score"))
    b = lexical.select(key, "rank", F.lit(None).cast("double").alias("semantic_score"), "keyword_score")
    fused = a.unionByName(b).groupBy(key).agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("fused_score"), F.max("semantic_score").alias("semantic_score"), F.max("keyword_score").alias("keyword_score"))
    top = fused.orderBy(F.desc("fused_score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), key)))  # k rows


def confidence(*scores: Column) -> Column:
    """The best of the hits' first known scores, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(F.coalesce(*scores))))
