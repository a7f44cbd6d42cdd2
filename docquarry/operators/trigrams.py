"""Substring search over an inverted index of three-character pieces.

A text can hold a word only if it holds all of the word's pieces, so the texts that a word is looked for in are those
in the posting lists of its rarest pieces (``candidates``). Texts lie in packs; a list names the texts of one pack that
hold a piece. Queries are answered by ``term_index`` over the same texts, as their terms hold no blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.term_index import TermIndex
from docquarry.session import saved

#: Texts of a pack at most.
PACK = 4096


def pieces(text: Column) -> Column:
    """The distinct three-character pieces of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def of(cs: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(cs) - 3), lambda i: F.concat(F.get(cs, i), F.get(cs, i + 1), F.get(cs, i + 2)))
        return F.array_distinct(F.when(F.size(cs) >= 3, whole).otherwise(F.expr("cast(array() as array<string>)")))

    return F.transform(F.array(chars), of)[0]  # the characters are a variable of the lambda, so found once


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pack, piece, n, docs of texts (pack, at, low): where in the pack the texts are that hold the piece, as a bitmap or,
    if that is shorter, as numbers. A pack that comes in parts has a row for each of them."""
    for b in batches:
        packs, at, low = b["pack"].to_numpy(zero_copy_only=False), b["at"].to_numpy(zero_copy_only=False), b["low"]
        starts = [0, *(np.flatnonzero(np.diff(packs)) + 1), len(packs)] if len(packs) else [0]
        for i, j in zip(starts, starts[1:], strict=False):
            codes, docs = [], []
            for place, text in zip(at[i:j], low[i:j], strict=True):
                c = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
                codes.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else c[:0])
                docs.append(np.full(len(codes[-1]), place, np.uint16))
            code, doc = np.concatenate(codes), np.concatenate(docs)
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            ends = np.append(first, len(code))[1:]
            pieces_ = ["".join(chr(x >> n & 0x1FFFFF) for n in (42, 21, 0)) for x in code[first].tolist()]
            yield pa.RecordBatch.from_pydict({"pack": np.full(len(first), packs[i]), "piece": pieces_, "n": ends - first, "docs": [_packed(doc[x:y]) for x, y in zip(first, ends, strict=True)]}, schema=_LIST)


_LIST = pa.schema([("pack", pa.int64()), ("piece", pa.string()), ("n", pa.int64()), ("docs", pa.binary())])


def _packed(docs: np.ndarray) -> bytes:
    if 2 * len(docs) < PACK // 8:
        return docs.tobytes()
    held = np.zeros(PACK, bool)
    held[docs] = True
    return np.packbits(held).tobytes()


def _met(lists: pa.Table) -> dict[str, np.ndarray]:
    """For each word of a pack's lists (word, piece, need, n, docs) the texts that are in those of all its pieces."""
    parts: dict[tuple[str, str], np.ndarray] = {}
    need: dict[str, int] = {}
    for word, piece, most, docs in zip(*(lists[c].to_pylist() for c in ("word", "piece", "need", "docs")), strict=True):
        held = parts.setdefault((word, piece), np.zeros(PACK, bool))
        if len(docs) < PACK // 8:
            held[np.frombuffer(docs, np.uint16)] = True
        else:
            held |= np.unpackbits(np.frombuffer(docs, np.uint8)).astype(bool)
        need[word] = most
    every: dict[str, list[np.ndarray]] = {}
    for (word, _), held in parts.items():
        every.setdefault(word, []).append(held)
    return {w: np.flatnonzero(np.logical_and.reduce(x)) for w, x in every.items() if len(x) == need[w]}


class TrigramIndex:
    """Posting lists (pack, piece) in folders by hash of the piece, sorted by it, and how many texts hold each piece.

    A null text is empty. Keys are unique and of one type; texts are kept in lower case beside the lists.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.texts, self.sizes = (spark.read.parquet(f"{path}/{n}") for n in ("texts", "sizes"))
        self.kind = self.texts.schema["key"].dataType.simpleString()
        self.lists = spark.read.schema("pack long, piece string, n long, docs binary, bucket int").parquet(f"{path}/lists")  # an empty index has no files
        self.terms = f"{path}/terms"
        self.buckets = int(spark.read.parquet(f"{path}/shape").first()["buckets"])

    @classmethod
    def build(cls, records: DataFrame, text: Column, key: str, path: str, buckets: int = 16) -> TrigramIndex:
        spark = records.sparkSession
        row = F.monotonically_increasing_id()
        placed = records.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("low"), row.alias("row"))
        placed.select(F.floor(F.col("row") / PACK).alias("pack"), (F.col("row") % PACK).cast("int").alias("at"), "key", "low").write.parquet(f"{path}/texts")
        posted = spark.read.parquet(f"{path}/texts").select("pack", "at", "low").mapInArrow(_listed, "pack long, piece string, n long, docs binary")
        # Each task writes its own packs' lists: nothing is shuffled.
        posted.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "piece", "pack").write.partitionBy("bucket").parquet(f"{path}/lists")
        lists = spark.read.schema("piece string, n long, bucket int").parquet(f"{path}/lists")
        lists.groupBy("piece").agg(F.sum("n").alias("n")).write.parquet(f"{path}/sizes")
        TermIndex.build(spark.read.parquet(f"{path}/texts"), F.col("low"), "key", f"{path}/terms")
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/shape")
        return cls(spark, path)

    def _postings(self, words: DataFrame, most_pieces: int) -> DataFrame:
        """pack, word, piece, need (how many pieces), docs of the ``most_pieces`` rarest pieces of each word."""
        held = words.where(F.length("word") >= 3).select("word", F.explode(pieces(F.col("word"))).alias("piece")).join(self.sizes, "piece", "left")
        # A piece that no text holds has no list: its word is nowhere.
        held = held.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        place = F.row_number().over(Window.partitionBy("word").orderBy("n", "piece"))
        rare = held.withColumn("place", place).where(F.col("place") <= most_pieces)
        need = rare.groupBy("word").agg(F.count("*").alias("need"))
        rare = rare.join(need, "word").withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(self.buckets)).cast("int"))
        # Written first, so that its size is known and lists need not move where it is small.
        return saved(rare.select("word", "piece", "bucket", "need"), "rare-pieces").join(self.lists, ["bucket", "piece"]).select("pack", "word", "piece", "need", "docs")

    def candidates(self, words: DataFrame, most_pieces: int = 3) -> DataFrame:
        """word, key: the texts that hold the ``most_pieces`` rarest pieces of each word (of three characters at least)."""

        def found(lists: pa.Table, texts: pa.Table) -> pa.Table:
            met = _met(lists)
            keys = dict(zip(texts["at"].to_pylist(), texts["key"].to_pylist(), strict=True))
            pairs = [(w, keys[i]) for w, at in met.items() for i in at.tolist()]
            return pa.table({"word": pa.array([w for w, _ in pairs], pa.string()), "key": pa.array([k for _, k in pairs], texts["key"].type)})

        return self._postings(words, most_pieces).groupBy("pack").cogroup(self.texts.select("pack", "at", "key").groupBy("pack")).applyInArrow(found, f"word string, key {self.kind}")

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """query_key, key, keyword_score (share of the query's terms held), rank: the k best texts of each query that
        hold any of its terms, ties by key."""
        return TermIndex(self.texts.sparkSession, self.terms).search(queries, k, query_key, query)
