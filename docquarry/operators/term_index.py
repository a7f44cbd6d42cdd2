"""Search of many queries' terms inside texts, over the texts' words.

A term holds letters, digits, ``_`` and ``-`` alone, so wherever it stands in a text it lies inside one of the pieces
that the other ASCII characters leave (a word here, however long). It is therefore looked for in each different word of
a pack of texts, by the pieces of three bytes that words hold, and never in the texts; a word's list names the texts of
the pack that hold it. Queries with the same terms are answered once. What leaves a pack's task is the k best texts of
each different set of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import terms
from docquarry.session import saved

#: Texts of a pack, and bytes of its texts, at most (one text may be longer).
PACK, PACK_BYTES = 16_384, 1 << 26
#: Sets of terms that one task holds, about at most.
SETS = 65_536
#: Rows of a table of terms and texts that is filled at once.
ROWS = 512
#: Numbers of an array that is needed for a moment, about at most.
AT_ONCE = 1 << 22
#: ASCII characters that no term holds become blanks; all bytes of other characters stay.
_BLANKED = bytes(b if b >= 128 or chr(b).isalnum() or chr(b) in "_-" else 32 for b in range(256))


def _packs(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting, n, size = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in batches:
            b = pa.table({"key": b["key"], "low": b["low"].cast(pa.string())})
            lengths = np.cumsum(pc.binary_length(b["low"]).to_numpy())
            at = 0
            while at < len(b):
                before = lengths[at - 1] if at else 0
                fits = int(np.searchsorted(lengths, before + PACK_BYTES - size, "right")) - at
                take = min(PACK - n, fits, len(b) - at)
                if take <= 0 and n:
                    yield _pack(part << 33 | number, pa.concat_tables(waiting))
                    number, waiting, n, size = number + 1, [], 0, 0
                    continue
                take = max(take, 1)
                waiting.append(b.slice(at, take))
                n, size, at = n + take, size + int(lengths[at + take - 1] - before), at + take
        if n:
            yield _pack(part << 33 | number, pa.concat_tables(waiting))

    return run, f"pack long, keys array<{kind}>, words binary, ends binary, starts binary, texts binary"


def _pack(number: int, rows: pa.Table) -> pa.RecordBatch:
    """A pack's keys in order, its different words (their bytes and where each ends) and each word's texts, by place."""
    rows = rows.take(pc.sort_indices(rows["key"]))
    keys, low = rows["key"].combine_chunks(), rows["low"].combine_chunks()
    _, offsets, data = low.buffers()
    blanked = pa.StringArray.from_buffers(len(low), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_BLANKED)), offset=low.offset)
    split = pc.ascii_split_whitespace(blanked)
    flat, place = split.flatten(), np.repeat(np.arange(len(low)), split.value_lengths().to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)  # blanks at the ends leave an empty word
    flat, place = flat.filter(some), place[some.to_numpy(zero_copy_only=False)]
    encoded = flat.dictionary_encode()
    found = np.sort(encoded.indices.to_numpy().astype(np.int64) * PACK + place)
    found = found[np.flatnonzero(np.diff(found, prepend=-1))]
    words = encoded.dictionary
    ends = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
    starts = np.searchsorted(found, np.arange(len(words) + 1) * PACK)
    row = {"pack": [number], "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "words": pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "").cast(pa.binary()), "ends": [ends.tobytes()], "starts": [starts.astype(np.int64).tobytes()], "texts": [(found % PACK).astype(np.uint16).tobytes()]}
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64() if k == "pack" else pa.binary()) for k, v in row.items()})


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (first, count): the number of the range and the position, of each of their positions."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _shares(items: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    """The items in runs that cost about ``AT_ONCE`` at most, or are one item."""
    return np.split(items, np.flatnonzero(np.diff(np.cumsum(cost[items]) // AT_ONCE)) + 1)


def _codes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of byte strings that stand in a row: code, string and position of all pieces of three bytes."""
    d = data.astype(np.int32)
    code = d[:-2] << 16 | d[1:-1] << 8 | d[2:] if len(d) > 2 else d[:0]
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(code)]
    at = np.flatnonzero(np.arange(len(code)) + 3 <= ends[own])
    return code[at], own[at], at


def _held(asked: list[bytes], data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term and word of each place where a word holds a term."""
    begins = ends - np.diff(ends, prepend=0)
    own = np.repeat(np.arange(len(ends)), ends - begins)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, t in enumerate(asked):
        if len(t) < 3:
            at = np.flatnonzero(data == t[0])
            if len(t) == 2:
                at = at[at + 1 < ends[own[at]]]
                at = at[data[at + 1] == t[1]]
            word = own[at]
            word = word[np.flatnonzero(np.diff(word, prepend=-1))]
            found.append((np.full(len(word), i), word))
    long = np.array([i for i, t in enumerate(asked) if len(t) > 2], np.int64)
    code, _, place = _codes(data, ends)
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    joined = np.frombuffer(b"".join(asked[i] for i in long), np.uint8)
    stops = np.cumsum([len(asked[i]) for i in long], dtype=np.int64)
    pieces, term, at = _codes(joined, stops)
    if len(pieces) and len(code):
        # Each term is looked for where its rarest piece stands.
        low, high = np.searchsorted(code, pieces, "left"), np.searchsorted(code, pieces, "right")
        rare = np.lexsort((high - low, term))
        rare = rare[np.flatnonzero(np.diff(term[rare], prepend=-1))]
        size = np.diff(stops, prepend=0)
        for length in np.unique(size):  # all terms of a length are compared at once
            for part in _shares(rare[size[term[rare]] == length], (high - low) * length):
                which, pos = _spread(low[part], (high - low)[part])
                start = stops[term[part]] - length
                begin = place[pos] - (at[part] - start)[which]
                word = own[place[pos]]
                fits = np.flatnonzero((begin >= begins[word]) & (begin + length <= ends[word]))
                which, begin, word = which[fits], begin[fits], word[fits]
                steps = np.arange(length)
                same = (data[begin[:, None] + steps] == joined[start[which][:, None] + steps]).all(axis=1)
                found.append((long[term[part][which[same]]], word[same]))
    return np.concatenate([t for t, _ in found]), np.concatenate([w for _, w in found])


def _bits(n: int, size: int, term: np.ndarray, word: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> list[int]:
    """For each of ``n`` terms the texts that hold it, as the bits of a number."""
    order = np.argsort(term, kind="stable")
    term, word, size_of = term[order], word[order], np.diff(starts)
    out = []
    for first in range(0, n, ROWS):
        last = min(n, first + ROWS)
        i, j = np.searchsorted(term, first), np.searchsorted(term, last)
        held = np.zeros((last - first, size), bool)
        for x in _shares(np.arange(i, j), size_of[word]):
            which, pos = _spread(starts[word[x]], size_of[word[x]])
            held[term[x][which] - first, texts[pos]] = True
        out += [int.from_bytes(r.tobytes(), "little") for r in np.packbits(held, axis=1, bitorder="little")]
    return out


def _top(held: list[int], k: int) -> list[tuple[int, int]]:
    """place, number of terms held: the k first texts by most terms, then by place."""
    least = [0] * (len(held) + 1)  # the texts that hold so many of the terms or more
    for n, h in enumerate(held):
        for j in range(n + 1, 1, -1):
            least[j] |= least[j - 1] & h
        least[1] |= h
    out: list[tuple[int, int]] = []
    above = 0
    for j in range(len(held), 0, -1):
        left = least[j] ^ above
        while left and len(out) < k:
            lowest = left & -left
            out.append((lowest.bit_length() - 1, j))
            left ^= lowest
        if len(out) >= k:
            break
        above = least[j]
    return out


class TermIndex:
    """Packs of texts with their words; a null text is empty. Keys are unique and of one type."""

    def __init__(self, spark: SparkSession, path: str):
        self.packs = spark.read.parquet(path)
        self.kind = self.packs.schema["keys"].dataType.elementType.simpleString()

    @classmethod
    def build(cls, records: DataFrame, text: Column, key: str, path: str) -> TermIndex:
        rows = records.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
        run, schema = _packs(rows.schema["key"].dataType.simpleString())
        rows.mapInArrow(run, schema).write.parquet(path, compression="zstd")  # each task writes its own packs: nothing is shuffled
        return cls(records.sparkSession, path)

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """query_key, key, keyword_score (share of the query's terms held), rank: the k best texts of each query that
        hold any of its terms, ties by key."""
        asked = queries.select(F.col(query_key).alias("__query"), F.array_sort(terms(F.col(query))).alias("words")).where(F.size("words") > 0)
        sets = saved(asked.select("words").distinct().withColumn("set", F.monotonically_increasing_id()), "term-sets")
        members = saved(asked.join(sets, "words").select("__query", "set", F.size("words").alias("n_terms")), "set-members")
        parts = max(1, -(-sets.count() // SETS))  # a task has one pack and a part of the sets
        part = F.pmod(F.xxhash64("set"), F.lit(parts)).cast("int")
        packs = F.broadcast(self.packs.select(F.col("pack").alias("in_pack")))  # a row for each pack
        given = sets.withColumn("part", part).crossJoin(packs).groupBy("in_pack", "part")
        index = self.packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("pack", "part")

        def best(asks: pa.Table, pack: pa.Table) -> pa.Table:
            """The k best texts of this pack for each set."""
            if not len(asks) or not len(pack):
                return pa.table({"set": pa.array([], pa.int64()), "key": pa.array([], pack.schema.field("keys").type.value_type), "held": pa.array([], pa.int64())})
            data, ends, starts, texts = (np.frombuffer(pack[c][0].as_buffer(), t) for c, t in (("words", np.uint8), ("ends", np.int64), ("starts", np.int64), ("texts", np.uint16)))
            lists = pa.concat_arrays(asks["words"].chunks)
            coded = lists.flatten().dictionary_encode()
            words = [w.encode() for w in coded.dictionary.to_pylist()]
            term, word = _held(words, data, ends)
            bits = _bits(len(words), len(pack["keys"][0].values), term, word, starts, texts)
            codes, stops = coded.indices.to_pylist(), np.cumsum(lists.value_lengths().to_numpy()).tolist()
            which, place, held, first = [], [], [], 0
            for i, stop in enumerate(stops):
                for at, n in _top([b for c in codes[first:stop] if (b := bits[c])], k):
                    which.append(i), place.append(at), held.append(n)
                first = stop
            return pa.table({"set": asks["set"].take(pa.array(which, pa.int64())), "key": pack["keys"][0].values.take(pa.array(place, pa.int64())), "held": pa.array(held, pa.int64())})

        few = given.cogroup(index).applyInArrow(best, f"set long, key {self.kind}, held long")
        place = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("held"), "key"))
        ranked = few.withColumn("rank", place).where(F.col("rank") <= k)
        return members.join(ranked, "set").select(F.col("__query").alias(query_key), "key", (F.col("held") / F.col("n_terms")).alias("keyword_score"), "rank")
