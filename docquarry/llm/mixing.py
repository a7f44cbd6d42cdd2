"""Mixing sources to target weights, by blocks of words.

The words of a source, document after document, are packed into blocks of ``block`` words. A source's
target is turned into slots: whole passes over its blocks, then part of a pass whose last slot may end
inside its block. Slots are dealt to the output shards by multinomial draws from what each source has
left, and mapped to blocks by a pseudorandom permutation for each source and pass; slots and blocks
are then joined by block index. All draws come from ``seed``, so reruns agree.

Defined results: a null text has size 0; null is a source of its own, last in order; a source without
words has target 0; documents without words take 0; an empty table gives no rows; rows repeating a
doc_id, and those without one, are separate documents; columns other than id, text and source may have any names.
``repeated`` gives rows that repeat an id, or have none, the same number of copies each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from docquarry.llm.textkeys import quoted
from docquarry.session import saved, table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Targets by weight; what a source's cap turns away is shared again by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    free, left = set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > cap * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return target


def shard_draws(slots: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws from what is left; each source's column sums to its slots."""
    rng, left = np.random.default_rng(seed), slots.astype(np.int64).copy()
    out = np.zeros((n_shards, len(slots)), np.int64)
    for g in range(n_shards):
        want = int(left.sum()) // (n_shards - g)
        if g == n_shards - 1:
            out[g] = left
        elif want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            for i in np.argsort(got - left):  # what a source lacked comes from those with most left
                more = min(want - int(got.sum()), int(left[i] - got[i]))
                got[i] += more
            out[g] = got
        left -= out[g]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index's place in a pseudorandom permutation of 0..n-1 chosen by key: a Feistel network, walked
    along its cycle until it is inside the range."""
    n, key = n.astype(np.uint64), _mix64(key.astype(np.uint64))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, n).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            a, b = b, a ^ (_mix64(b + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))


@dataclass
class Mixture:
    documents: DataFrame  # doc_id, source, size, source_size, target, taken
    slots: DataFrame  # shard, slot (of the source), sid, block, words (of the block's beginning)
    pieces: DataFrame  # sid, block, offset (in the block), n, doc_id, start (in the document)
    sources: DataFrame  # sid, source, source_size, target


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 128, n_shards: int = 64, seed: int = 20, text: str = "text", key: str = "doc_id", source: str = "source", max_sources: int = 100_000) -> Mixture:
    """The mix of ``docs``. The driver holds a few numbers for each source and shard; ``max_sources``
    bounds them (more sources are an error, not a sample)."""
    spark = docs.sparkSession
    key, text, source = quoted([key, text, source])
    # The text's hash orders and spreads rows that repeat an id or have none.
    counted = saved(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("salt")), "mix-sizes")
    rows = counted.groupBy("source").agg(F.sum("size"), F.count("*")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    sizes = {r[0]: r[1] for r in rows}
    target = source_targets(sizes, weights, share, cap)
    names = list(target)
    size = np.array([sizes[s] for s in names], np.int64)
    want = np.rint([target[s] for s in names]).astype(np.int64)
    n_blocks = -(-size // block)
    passes = want // np.maximum(size, 1)
    rest = want - passes * size
    slots = passes * n_blocks + -(-rest // block)
    plan = [(i, s, int(size[i]), float(target[s]), int(n_blocks[i]), int(slots[i]), int(passes[i] * n_blocks[i]), int(rest[i] - (-(-rest[i] // block) - 1) * block) if rest[i] else block) for i, s in enumerate(names)]
    sources = spark.createDataFrame(plan, "sid int, source string, source_size long, target double, n_blocks long, n_slots long, whole_slots long, last_words long")
    counts = shard_draws(slots, n_shards, seed)
    first = np.cumsum(counts, 0) - counts
    g, i = np.nonzero(counts)
    dealt = pa.table({"shard": g.astype(np.int32), "sid": i.astype(np.int32), "first": first[g, i], "n": counts[g, i]})
    step = 65536
    dealt_rows = spark.createDataFrame(dealt).repartition(n_shards, "shard")
    runs = dealt_rows.select("shard", "sid", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("at"))
    slot_rows = runs.select("shard", "sid", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("n"), F.col("at") + step) - 1)).alias("slot"))
    s = F.broadcast(sources.select("sid", "n_blocks", "n_slots", "whole_slots", "last_words"))
    epoch = F.floor(F.col("slot") / F.col("n_blocks"))
    slot_rows = slot_rows.join(s, "sid").select(
        "shard",
        "slot",
        "sid",
        _permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64("sid", epoch, F.lit(seed))).alias("block"),
        F.when((F.col("slot") == F.col("n_slots") - 1) & (F.col("slot") >= F.col("whole_slots")), F.col("last_words")).otherwise(F.lit(block).cast("long")).alias("words"),
    )
    # Place each document in its source: prefix sums inside small chunks, then over the chunks' totals.
    n_chunks = max(1, int(sum(r[2] for r in rows) ** 0.5))
    named = counted.join(F.broadcast(sources.select("sid", F.col("source").alias("__s"))), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    named = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n_chunks)).cast("int"))
    totals = named.groupBy("sid", "chunk").agg(F.sum("size").alias("chunk_size"))
    totals = totals.withColumn("chunk_at", F.sum("chunk_size").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("chunk_size"))
    within = Window.partitionBy("sid", "chunk").orderBy("doc_id", "salt")
    run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = saved(named.withColumn("run", run).join(totals, ["sid", "chunk"]).select("doc_id", "sid", "size", (F.col("run") + F.col("chunk_at")).alias("at")), "mix-placed")
    full = placed.where("size > 0")
    b = F.lit(block).cast("long")
    pieces = full.select("*", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * b)
    pieces = pieces.select("sid", "block", (begin - F.col("block") * b).alias("offset"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - begin).alias("n"), "doc_id", (begin - F.col("at")).alias("start"), "at", "size")
    hit = F.greatest(F.lit(0).cast("long"), F.least(F.col("offset") + F.col("n"), F.col("words")) - F.col("offset"))
    taken = pieces.join(slot_rows.select("sid", "block", "words"), ["sid", "block"]).groupBy("doc_id", "sid", "at", "size").agg(F.sum(hit).alias("taken"))
    # (sid, at) names a document that has words, so rows that repeat a doc_id stay apart.
    all_docs = full.join(taken.select("sid", "at", "taken"), ["sid", "at"], "left").select("doc_id", "sid", "size", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    all_docs = all_docs.unionByName(placed.where("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken")))
    out = all_docs.join(F.broadcast(sources.select("sid", "source", "source_size", "target")), "sid").select("doc_id", "source", "size", "source_size", "target", "taken")
    return Mixture(out, slot_rows, pieces.drop("at", "size"), sources.select("sid", "source", "source_size", "target"))


def mixed_texts(docs: DataFrame, mixture: Mixture, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The mix itself: shard, slot, source, and the slot's words joined by single spaces (doc_id must be unique)."""
    words = docs.select(F.col(quoted([key])[0]).alias("doc_id"), F.regexp_extract_all(F.col(quoted([text])[0]), F.lit(f"({WORD})")).alias("w"))
    parts = mixture.pieces.join(words, "doc_id").select("sid", "block", "offset", F.slice("w", (F.col("start") + 1).cast("int"), F.col("n").cast("int")).alias("w"))
    blocks = parts.groupBy("sid", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "w"))), lambda x: x["w"])).alias("w"))
    slots = mixture.slots.join(blocks, ["sid", "block"]).join(F.broadcast(mixture.sources.select("sid", "source")), "sid")
    return slots.select("shard", "slot", "source", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def repeated(docs: DataFrame, seed: int = 20, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it: taken / size times, the fraction by a fixed draw.
    Rows without words stay once."""
    taken = mix(docs, seed=seed, text=text, key=key, source=source).documents.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("z"))
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("rec"), F.col(quoted([key])[0]).alias("id"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    n = F.when(F.col("z") > 0, F.floor(F.col("t") / F.col("z") + draw)).otherwise(1)
    joined = rows.join(taken, F.col("id").eqNullSafe(F.col("doc_id")), "left").withColumn("n", n).where("n > 0")
    return joined.select("rec", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).select("rec.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).documents.select("doc_id", "size", "source_size", "target", "taken", "source")
