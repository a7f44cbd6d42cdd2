"""Benchmark decontamination by a prefix-filtered set join.

Each item gives windows of ``window`` consecutive words (an item of fewer words is one window). A window
is the set of its shingles with their positions. Shingles are ordered by rarity over the whole corpus;
exact containment needs every shingle, so one prefix token, the rarest, is necessary. Documents are
probed with prefix tokens alone; a match fixes where the window would begin (positional bound), it must
fit into the document (length bound), and its words are then compared one by one.

The items are cut into blocks of at most ``block_bytes`` of text; a block's index is broadcast, about 25 bytes
for each byte of its text, so what is broadcast has that bound however many items there are, and two passes over
the documents count and probe it.

Defined results: null and empty texts have no words; items without words have no window; equal item ids
count once, a null item id is the empty string; rows repeat as in the input; an empty table gives no rows;
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.textkeys import ALNUM, column, keyed, mix64, quoted, recorded, shingle_keys, slices
from docquarry.session import saved, table


class Index:
    """The windows of some items, as arrays. ``shingles[k]``: sorted keys of the items' shingles of k words; the
    ids of these go on from k to k. Windows of the same words are one."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.items = [i for i, _ in items]
        self.buf, self.begin, self.end, words, bounds = keyed([t for _, t in items], ALNUM)
        size = np.diff(bounds)
        n = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        owner = np.repeat(np.arange(len(items)), n)
        first = bounds[:-1][owner] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(size[owner], window)
        key = np.zeros(len(first), np.uint64)
        for k in np.unique(length):
            some = length == k
            key[some] = mix64(shingle_keys(words, int(k))[first[some]] + np.uint64(k))
        order = np.lexsort((owner, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        for i in np.flatnonzero(~new):  # the same key: the same words as the one before
            a, b = order[i - 1], order[i]
            new[i] = self.words(first[a], length[a]) != self.words(first[b], length[b])
        self.first, self.length = first[order][new], length[order][new]
        self.owners, self.owned = owner[order], np.append(np.flatnonzero(new), len(order))
        self.sizes = np.minimum(self.length, shingle)
        self.shingles: dict[int, tuple[np.ndarray, int]] = {}
        self.parts: dict[int, np.ndarray] = {}
        at = 0
        for k in np.unique(self.sizes).tolist():
            self.parts[k] = shingle_keys(words, k)
            inside = [self.parts[k][self.first[some][:, None] + np.arange(m - k + 1)].ravel() for m in np.unique(self.length[self.sizes == k]).tolist() if len(some := np.flatnonzero((self.sizes == k) & (self.length == m)))]
            own = np.unique(np.concatenate(inside))
            self.shingles[k] = (own, at)
            at += len(own)
        self.n_shingles = at

    def words(self, first: int, length: int) -> list[bytes]:
        return self.buf[self.begin[first] : self.end[first + length - 1]].split()

    def ids(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in keys that hold one of the index's shingles of k words, and the shingles' ids."""
        own, first = self.shingles[k]
        place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        at = np.flatnonzero(own[place] == keys)
        return at, place[at] + first

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's prefix token: its rarest shingle. The windows of token i, and where it stands in
        them, are window and offset from probe[i] to probe[i + 1]."""
        rank = np.empty(self.n_shingles, np.int64)
        rank[np.lexsort((np.arange(self.n_shingles), counts))] = np.arange(self.n_shingles)
        token, offset = (np.zeros(len(self.first), np.int64) for _ in range(2))
        for m in np.unique(self.length).tolist():
            some = np.flatnonzero(self.length == m)
            k = int(self.sizes[some[0]])
            own, first = self.shingles[k]
            for part in np.array_split(some, len(some) // 100_000 + 1):
                ids = np.searchsorted(own, self.parts[k][self.first[part][:, None] + np.arange(m - k + 1)]) + first
                offset[part] = np.argmin(rank[ids], 1)
                token[part] = ids[np.arange(len(part)), offset[part]]
        by = np.argsort(token, kind="stable")
        self.window, self.offset = by, offset[by]
        self.probe = np.searchsorted(token[by], np.arange(self.n_shingles + 1))
        self.probed = np.diff(self.probe) > 0
        self.parts = {}


def _blocks(items: DataFrame, text: str, item: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    item, text = quoted([item, text])
    for i, t in items.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if held and size + len(t.encode()) > block_bytes:
            yield held
            held, size = [], 0
        held.append((i, t))
        size += len(t.encode())
    if held:
        yield held


def _counts(docs: DataFrame, text: str, index: Index) -> np.ndarray:
    """How often each of the index's shingles occurs in all documents; each task sends its sums once."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = np.zeros(own.n_shingles, np.int64)
        for part in slices(batches, "text"):
            _, _, _, words, bounds = keyed(part.column("text").to_pylist(), ALNUM)
            doc_end = np.repeat(bounds[1:], np.diff(bounds))
            for k in own.shingles:
                at, ids = own.ids(k, shingle_keys(words, k))
                sums += np.bincount(ids[at + k <= doc_end[at]], minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["id", "n"])

    out = np.zeros(index.n_shingles, np.int64)
    for i, n in docs.select(F.col(quoted([text])[0]).alias("text")).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _probe(own: Index, texts: list[str | None]) -> tuple[list[list[tuple[int, int]]], list[set[str]], np.ndarray]:
    """Of each text: the spans of words hit, the items hit, the number of words."""
    buf, begin, end, words, bounds = keyed(texts, ALNUM)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    doc_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for k in own.shingles:
        at, ids = own.ids(k, shingle_keys(words, k))
        some = own.probed[ids]
        for p, i in zip(at[some].tolist(), ids[some].tolist(), strict=True):
            d = int(doc_of[p])
            for at_probe in range(own.probe[i], own.probe[i + 1]):
                w = own.window[at_probe]
                a = p - own.offset[at_probe]
                b = a + own.length[w]
                if a < bounds[d] or b > bounds[d + 1]:
                    continue
                if buf[begin[a] : end[b - 1]].split() == own.words(own.first[w], own.length[w]):
                    spans[d].append((int(a - bounds[d]), int(b - bounds[d])))
                    items[d].update(own.items[o] for o in own.owners[own.owned[w] : own.owned[w + 1]])
    return spans, items, np.diff(bounds)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 22, keep: tuple[str, ...] | None = None) -> DataFrame:
    """rec (the columns of ``docs``, or ``keep``), n_words, hits (word spans) and items (ids, sorted) of the
    windows that occur, for each row."""
    own, place = recorded(docs, text, keep)
    out = own.selectExpr("*", "cast(0 as bigint) AS n_words", "cast(array() as array<struct<s:int,e:int>>) AS hits", "cast(array() as array<string>) AS items")
    sc, names, schema = docs.sparkSession.sparkContext, out.columns, out.schema
    hit_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    blocks = 0
    for block in _blocks(items, item_text, item, block_bytes):
        index = Index(block, window, shingle)
        if not len(index.first):
            continue
        index.order(_counts(docs, text, index))
        shared = sc.broadcast(index)
        if blocks:  # one index at a time in a worker
            out = saved(out, "decontaminated")
        blocks += 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, place):
                spans, found, n = _probe(shared.value, column(part, place).to_pylist())
                hits = [[*h, *({"s": a, "e": b} for a, b in s)] for h, s in zip(part.column("hits").to_pylist(), spans, strict=True)]
                ids = [sorted({*i, *new}) for i, new in zip(part.column("items").to_pylist(), found, strict=True)]
                results = {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, hit_type), "items": pa.array(ids, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([results.get(c, part.column(i)) for i, c in enumerate(names)], names=names)

        out = out.mapInArrow(run, schema)
    if not blocks:
        where = F.col("text") if place == "text" else F.col("rec").getField(own.schema["rec"].dataType.names[place])
        out = out.withColumn("n_words", F.coalesce(F.regexp_count(where, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long"))
    return out.select("rec", "n_words", "hits", "items")


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest of ``decontaminate``: counts, item digest and verdict of each row."""
    return found.select(
        F.col(f"rec.{quoted([key])[0]}"),
        "n_words",
        _hit_words(F.col("hits")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _hit_words(hits):
    """Words in the union of the spans: a fold over the spans in order."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))

    def add(acc, x):
        return F.struct((acc["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["reach"]))).alias("total"), F.greatest(acc["reach"], x["e"]).alias("reach"))

    return F.aggregate(F.array_sort(hits), start, add, lambda acc: acc["total"])


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    return decontaminate(docs, items, **options).where(F.size("hits") == 0).select("rec.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("doc_id",)))


SQL = {
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN t ON t.n = p.n AND t.g = p.g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
}
