"""Removal of repeated byte strings by suffix order (difference cover).

A string of ``width`` bytes that stands in a document with a smaller doc_id is removed where it occurs again. Three
steps over packs of documents of some two megabytes; only packed integers and strings move:

1. Anchors. A string's anchor is the least hash of its 32-byte pieces, so equal strings have equal anchors. Packs send
   the anchors of their documents to ranges of anchors and get a bit for each: whether two documents have it. A string
   without a shared anchor occurs in one document only and is of no further concern.
2. Order. For the other strings, a pack sends the text around each shared anchor, each distinct one once with its
   smallest doc_id. A range of anchors holds all equal strings; where the texts around an anchor differ, the suffixes
   of all of them are sorted by the difference-cover algorithm (sort the sampled triples, recurse on their names, merge
   the rest) and neighbours compared on ``width`` bytes. Each string gets the smallest doc_id of its class.
3. Removal. Packs get a bit for each string they sent, and cover, count and hash their texts.

What moves for a frequent passage or a hot group of copies is one row of each pack. A task holds one pack, or one range.

Defined results: a null text is empty; documents without doc_id neither remove nor lose anything; rows that repeat a
doc_id do not count as each other's predecessors; an empty table gives no rows. Only the id and the text are read, so
other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.packed import grouped, parts, spread, squeezed, unparts, unsqueezed
from docquarry.llm.textkeys import mix64, quoted, slices
from docquarry.session import saved, table

# ---------------------------------------------------------------------------------------------- suffix order


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """One integer for each row of columns, in the same order as the rows."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * size >= 2**63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * size + c
    return key


def suffix_order(s: np.ndarray, width: int) -> np.ndarray:
    """Positions of s (positive integers) in the order of their suffixes, by their first ``width`` values at least:
    suffixes that agree on more come in any order, but together."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = _keys([t[sample], t[sample + 1], t[sample + 2]])
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if width > 3 and not new.all():
        order = suffix_order(names, -(-width // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    ranked = sample[order]
    ranked = ranked[ranked < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_keys([t[zero], rank[zero + 1]]), kind="stable")]
    # A remaining suffix's place among the sampled ones: against either class, by what both have ranks for.
    place = np.zeros(len(zero), np.int64)
    for shift in (1, 2):
        among = ranked[ranked % 3 == shift]
        cols = [t[np.concatenate([zero, among]) + k] for k in range(shift)] + [rank[np.concatenate([zero, among]) + shift]]
        both = _keys(cols)
        place += np.searchsorted(both[len(zero) :], both[: len(zero)])
    place = np.maximum.accumulate(place)
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + place] = zero
    at = np.arange(len(ranked))
    out[at + np.searchsorted(place, at, "right")] = ranked
    return out


def least_of_equals(texts: list[bytes], owner: np.ndarray, width: int) -> np.ndarray:
    """For every string of ``width`` bytes of every text, in order, the least owner of a text that has it."""
    if not texts:
        return np.zeros(0, np.int64)
    size = np.array([len(x) for x in texts])
    buf = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8).astype(np.int64) + 2
    begin = np.cumsum(size + 1) - size - 1
    buf[begin + size] = 1
    n = np.maximum(0, size - width + 1)
    start = np.repeat(begin, n) + spread(n)
    number = np.full(len(buf), -1, np.int64)
    number[start] = np.arange(len(start))
    ordered = suffix_order(buf, width)
    ordered = ordered[number[ordered] >= 0]
    if not len(ordered):
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(buf.astype(np.uint16), width)
    same = np.concatenate([(windows[ordered[i + 1 : i + 20_001]] == windows[ordered[i : i + 20_000][: len(ordered) - i - 1]]).all(1) for i in range(0, len(ordered), 20_000)])
    first = np.flatnonzero(np.concatenate([[True], ~same[: len(ordered) - 1]]))
    whose = np.repeat(owner, n)[number[ordered]]
    out = np.empty(len(start), np.int64)
    out[number[ordered]] = np.repeat(np.minimum.reduceat(whose, first), np.diff(np.append(first, len(ordered))))
    return out


# --------------------------------------------------------------------------------------------------- anchors


def _hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on (k a power of two)."""
    h = mix64(np.arange(1, 257, dtype=np.uint64))[buf]
    n, m = 1, 0xD1B54A32D192ED03
    while n < k:
        h = h[:-n] * np.uint64(m) + h[n:]
        n, m = 2 * n, m * m % 2**64
    return mix64(h)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    n = 1
    while 2 * n <= w:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if w > n else h


def anchored(buf: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``width`` bytes that have the same anchor: first string, end, anchor and document."""
    empty = np.zeros(0, np.int64)
    if len(buf) < width:
        return empty, empty, empty.astype(np.uint64), empty
    k = 1 << (2 * width // 3).bit_length() - 1
    anchor = _least(_hashes(buf, k), width - k + 1)
    new = np.zeros(len(buf) + 1, bool)
    new[0] = True
    new[1 : len(anchor)] = anchor[1:] != anchor[:-1]
    size = np.diff(bounds)
    last = bounds[1:] - width + 1  # strings begin before this
    new[bounds[:-1]] = True
    new[np.maximum(last, bounds[:-1])[size > 0]] = True
    start = np.flatnonzero(new[: len(anchor)])
    end = np.append(start[1:], len(anchor))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start < last[doc]
    start, end, doc = start[inside], end[inside], doc[inside]
    return start, end, mix64(anchor[start] + np.uint64(1)), doc  # least hashes are small: mixed again they spread over all ranges


TOP = np.uint64(16)  # shared anchors are told by 48 bits; a chance agreement only sends more text
NEAR = np.uint64(28)  # texts around an anchor meet by 36 bits of it; a chance agreement only sorts more together


class Pack:
    """Texts of a pack in one buffer, with the runs of their strings."""

    def __init__(self, ids: list, size: np.ndarray, raw: bytes, width: int):
        self.ids, self.raw, self.width = ids, raw, width
        self.buf = np.frombuffer(raw, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.start, self.end, self.anchor, self.doc = anchored(self.buf, self.bounds, width)
        known = np.array([i is not None for i in ids], bool)[self.doc]
        self.start, self.end, self.anchor, self.doc = (x[known] for x in (self.start, self.end, self.anchor, self.doc))

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order (48 bits), and whether several of the pack's documents have it."""
        a = self.anchor >> TOP
        order = np.lexsort((self.doc, a))
        a, doc = a[order], self.doc[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool))
        last = np.append(first[1:], len(a)) - 1
        return a[first], doc[first] != doc[last] if len(a) else np.zeros(0, bool)

    def around(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Runs whose anchor is shared, which distinct text each is, and these texts in the order of anchor and text,
        with anchors and smallest doc_ids."""
        a = self.anchor >> TOP
        at = np.searchsorted(shared, a)
        runs = np.flatnonzero((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == a)) if len(shared) else np.zeros(0, np.int64)
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(self.raw[s:e], len(seen)) for s, e in zip(self.start[runs].tolist(), (self.end[runs] + self.width - 1).tolist(), strict=True)], np.int64)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)[self.doc[runs]]
        least, anchor = np.full(len(seen), np.iinfo(np.int64).max), np.zeros(len(seen), np.uint64)
        np.minimum.at(least, which, ids)
        anchor[which] = self.anchor[runs]
        texts = list(seen)
        order = np.array(sorted(range(len(texts)), key=lambda i: (int(anchor[i]), texts[i])), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return runs, place[which] if len(which) else which, [texts[i] for i in order], anchor[order], least[order]


# ------------------------------------------------------------------------------------------------------ steps


def _texts(texts: list[bytes], level: int = 3) -> bytes:
    return parts(squeezed(np.array([len(t) for t in texts], np.int64)), zstandard.ZstdCompressor(level=level).compress(b"".join(texts)))


def _untexts(blob: bytes) -> tuple[np.ndarray, bytes]:
    size, raw = unparts(blob)
    size = unsqueezed(size).astype(np.int64)
    return size, zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, int(size.sum())))


def _ids(ids: np.ndarray) -> bytes:
    """Integers by how far they are above the least, which costs little for neighbours."""
    low = int(ids.min())
    return low.to_bytes(8, "little", signed=True) + squeezed(ids.astype(np.uint64) - np.uint64(low % 2**64))


def _unids(blob: bytes) -> np.ndarray:
    return (unsqueezed(blob[8:]) + np.uint64(int.from_bytes(blob[:8], "little", signed=True) % 2**64)).astype(np.int64)


def _rows(names: tuple[str, ...], *columns: list) -> pa.RecordBatch:
    kinds = {"pack": pa.int64(), "part": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns, strict=True)], names=list(names))


def _bits(held: list[dict]) -> np.ndarray:
    """The bits of all replies, in the order of parts."""
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)).astype(bool) for b, n in (_reply(r["blob"]) for r in sorted(held, key=lambda r: r["part"])))])


def _reply(blob: bytes) -> tuple[bytes, int]:
    n, bits = unparts(blob)
    return zstandard.ZstdDecompressor().decompress(bits, max_output_size=1 << 31), int.from_bytes(n, "little")


def _replied(bits: np.ndarray) -> bytes:
    return parts(len(bits).to_bytes(8, "little"), zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes()))


def _slices(group: np.ndarray, size: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Slices of whole groups (ascending), of about ``most`` bytes."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    before = (np.cumsum(size) - size)[first] // most
    cuts = [*first[np.flatnonzero(np.diff(before, prepend=-1))].tolist(), len(group)] if len(first) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield slice(a, b)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = 50, text: str = "text", key: str = "doc_id", bytes_per_pack: int = 1 << 21, packs_per_part: int = 5, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and ``kept`` (the bytes that stay) if asked for."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", bytes_per_pack):
            texts = [(t or "").encode() for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([part.column("__key").to_pylist()], pa.list_(pa.int64())), pa.array([_texts(texts, 6)], pa.binary())], names=["ids", "texts"])

    rows = docs.select(F.col(quoted([key])[0]).cast("long").alias("__key"), F.col(quoted([text])[0]).alias("__text"))
    packs = saved(rows.mapInArrow(packed, "ids array<long>, texts binary").withColumn("pack", F.monotonically_increasing_id()), "suffix-packs")
    n_parts = max(64, packs.count() // packs_per_part)

    def dealt(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts that have entries, and where each begins (and the last ends), of ascending 48-bit anchors."""
        part = (top.astype(np.float64) / 2**48 * n_parts).astype(np.int64)
        cut = np.searchsorted(part, np.arange(n_parts + 1))
        return np.flatnonzero(np.diff(cut)), cut

    def opened(row: dict) -> Pack:
        size, raw = _untexts(row["texts"])
        return Pack(row["ids"], size, raw, width)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, held in grouped(batches, "pack"):
            anchor, several = opened(held[0]).asked()
            here, cut = dealt(anchor)
            yield _rows(("part", "pack", "blob"), here.tolist(), [pack] * len(here), [parts(squeezed(anchor[cut[p] : cut[p + 1]], True), squeezed(several[cut[p] : cut[p + 1]])) for p in here])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in grouped(batches, "part"):
            asked = [list(map(unsqueezed, unparts(r["blob"]))) for r in held]
            found, where, n = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True, return_counts=True)
            shared = n > 1
            shared[where[np.concatenate([s for _, s in asked]).astype(bool)]] = True
            at = 0
            for r, (a, _) in zip(held, asked, strict=True):
                yield _rows(("pack", "part", "blob"), [r["pack"]], [part], [_replied(shared[where[at : at + len(a)]])])
                at += len(a)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, held in grouped(batches, "pack"):
            own = opened(held[0])
            anchor, _ = own.asked()
            _, _, texts, whose, least = own.around(anchor[_bits(held[1:])])
            here, cut = dealt(whose >> TOP)
            yield _rows(("part", "pack", "blob"), here.tolist(), [pack] * len(here), [parts(_texts(texts[cut[p] : cut[p + 1]]), squeezed(whose[cut[p] : cut[p + 1]] >> NEAR, True), _ids(least[cut[p] : cut[p + 1]])) for p in here])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in grouped(batches, "part"):
            seen: dict[bytes, int] = {}
            which, least, anchor = [], [], []
            for r in held:
                texts, whose, ids = unparts(r["blob"])
                size, raw = _untexts(texts)
                end = np.cumsum(size)
                which.append(np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip((end - size).tolist(), end.tolist(), strict=True)], np.int64))
                least.append(_unids(ids))
                anchor.append(unsqueezed(whose))
            flat = np.concatenate(which)
            owner, group = np.full(len(seen), np.iinfo(np.int64).max), np.zeros(len(seen), np.uint64)
            np.minimum.at(owner, flat, np.concatenate(least))
            group[flat] = np.concatenate(anchor)
            texts = list(seen)
            n = np.array([len(t) - width + 1 for t in texts], np.int64)
            first = np.cumsum(n) - n
            best = np.repeat(owner, n)  # of each string: where all texts around an anchor are equal, it is the text's own
            _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
            differ = np.flatnonzero(count[inverse] > 1)
            differ = differ[np.argsort(group[differ], kind="stable")]
            for some in _slices(group[differ], n[differ] + width):
                own = differ[some]
                at = np.repeat(first[own], n[own]) + spread(n[own])
                best[at] = least_of_equals([texts[i] for i in own], owner[own], width)
            for r, own, ids in zip(held, which, least, strict=True):
                place = np.repeat(first[own], n[own]) + spread(n[own])
                yield _rows(("pack", "part", "blob"), [r["pack"]], [n_parts + part], [_replied(best[place] < np.repeat(ids, n[own]))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped(batches, "pack"):
            own = opened(held[0])
            anchor, _ = own.asked()
            runs, which, texts, _, least = own.around(anchor[_bits([r for r in held[1:] if r["part"] < n_parts])])
            earlier = _bits([r for r in held[1:] if r["part"] >= n_parts])
            n = np.array([len(t) - width + 1 for t in texts], np.int64)
            first = np.cumsum(n) - n
            ids = np.array([0 if i is None else i for i in own.ids], np.int64)
            size = n[which]
            place, start = np.repeat(first[which], size) + spread(size), np.repeat(own.start[runs], size) + spread(size)
            later = np.repeat(ids[own.doc[runs]] > least[which], size)
            start = start[later | earlier[place]] if len(start) else start
            cover = np.zeros(len(own.buf) + 1, np.int32)
            cover += np.bincount(start, minlength=len(cover)).astype(np.int32)
            cover -= np.bincount(start + width, minlength=len(cover)).astype(np.int32)
            gone = np.cumsum(cover)[:-1] > 0
            out: list[list] = [[], [], [], [], [], []]
            for i, (a, b) in zip(own.ids, zip(own.bounds, own.bounds[1:], strict=False), strict=True):
                lost = gone[a:b]
                kept = own.raw[a:b] if not lost.any() else own.buf[a:b][~lost].tobytes()
                spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
                for c, v in zip(out, (i, int(b - a), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    c.append(v)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)][: 5 + with_kept], names=names)

    pack_first = packs.withColumn("part", F.lit(-1).cast("long")).withColumn("blob", F.lit(None).cast("binary"))

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_parts, "part").sortWithinPartitions("part")

    def by_pack(*replies: DataFrame) -> DataFrame:
        out = pack_first
        for r in replies:
            out = out.unionByName(r, allowMissingColumns=True)
        return out.repartition(n_parts, "pack").sortWithinPartitions("pack", "part")

    sent, back = "part long, pack long, blob binary", "pack long, part long, blob binary"
    shared = saved(by_part(packs.mapInArrow(ask, sent)).mapInArrow(told, back), "shared-anchors")
    classes = saved(by_part(by_pack(shared).mapInArrow(send, sent)).mapInArrow(ordered, back), "earlier-strings")
    return by_pack(shared, classes).mapInArrow(remove, OUT + ", kept binary" * with_kept)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
