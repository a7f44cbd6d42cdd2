"""Ports to external models, with deterministic fakes.

A port gets each distinct input once, in batches: hashes are counted, and only texts that repeat are moved. Ports must be idempotent, as Spark runs a task again when it is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import saved

#: Texts of a batch to vectors, in order.
Embedder = Callable[[list[str]], list[list[float]]]
#: Texts of a batch to labels of each, in order.
Tagger = Callable[[list[str]], list[list[str]]]
#: Hashes of repeated texts that are sent to all tasks at most; over it the rows are dealt by hash.
MOST = 4_000_000


class FakeEmbedder:
    """Vectors from digests: equal texts get equal vectors of length one."""

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{i}:{t}".encode()).digest() for i in range(-(-self.dimension // 32)))[: self.dimension]
            v = [b / 127.5 - 1 for b in raw]
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


class FakeTagger:
    """The vocabulary's words that a text holds."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = [w.lower() for w in vocabulary]

    def __call__(self, texts: list[str]) -> list[list[str]]:
        return [[w for w in self.vocabulary if w in t.lower()] for t in texts]


def _called(rows: DataFrame, text: str, fn: Callable, column: str, kind: str) -> DataFrame:
    """Texts that stand once are sent where they lie; those that repeat are made distinct and joined."""

    def checked(texts: list) -> list:
        got = fn(texts)
        if len(got) != len(texts):
            raise ValueError("a port must answer each input")
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__key": b["__key"], column: checked(b["__text"].tolist())})

    answer = F.pandas_udf(_one_by_one(checked), kind).asNondeterministic()  # so that no plan asks twice
    # Different texts with one hash are taken for repeated ones, which are told apart by their digests.
    coded = rows.withColumn("__code", F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    repeated = saved(coded.where("__code IS NOT NULL").groupBy("__code").count().where("count > 1").select("__code"), "repeated-texts")
    alone, others = coded.where("__code IS NOT NULL"), coded.where("__code IS NULL")
    if n := repeated.count():
        codes = F.broadcast(repeated) if n <= MOST else repeated
        alone, others = alone.join(codes, "__code", "left_anti"), others.unionByName(coded.join(codes, "__code", "left_semi").select(*coded.columns))
    others = others.drop("__code").withColumn("__key", F.sha2(F.col(text), 256))
    distinct = others.groupBy("__key").agg(F.first(text).alias("__text"))
    answers = distinct.mapInPandas(run, f"__key string, {column} {kind}")
    asked = alone.withColumn(column, answer(F.col(text))).select(*rows.columns, column)
    return asked.unionByName(others.join(answers, "__key", "left").select(*rows.columns, column))


def _one_by_one(checked: Callable[[list], list]) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(checked(texts.tolist()), dtype=object)

    return run


def embed(rows: DataFrame, text: str, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """rows with the vector of their text; the embedder sees each distinct text once."""
    return _called(rows, text, embedder, column, "array<double>")


def tag(rows: DataFrame, text: str, tagger: Tagger, column: str = "labels") -> DataFrame:
    """rows with the labels of their text; the tagger sees each distinct text once."""
    return _called(rows, text, tagger, column, "array<string>")


def vector_violations(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, rule: vectors that are missing, empty, not finite, or of another dimension than most."""
    from docquarry.functions.vectors import is_vector

    size = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    x = rows.crossJoin(F.broadcast(size.select("n")))  # one row
    rule = F.when(F.col(vector).isNull(), "missing").when(~is_vector(F.col(vector)), "empty or not finite").when(F.size(vector) != F.col("n"), "other dimension")
    return x.select(key, rule.alias("rule")).where(F.col("rule").isNotNull())
