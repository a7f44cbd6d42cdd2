"""Alignment of two tokenizers by the bytes of their tokens, counted over the corpus by runs on disk.

Both tokenizers cut before a single space that a visible character follows, so a text is aligned unit by unit (a
space and what stands up to the next), and each distinct unit is encoded once and remembered. A pack of documents
gives one run: its (pair, document, occurrences) records, radix-partitioned by A's id, in ascending order of pair, as
zstd blobs in the shared folder. How many documents of the pack hold a pair goes to the pair's radix part, where a
k-way heap merge of all packs' runs counts every pair; pairs come out A's id by A's id, so each id's highest
count is known as its pairs have passed. Counts and marks of the highest then stream back to the packs, in the
order of their runs, and are added up for each document. A pack sends one entry for each pair however many of its
documents hold it, so a frequent pair or a hot group of copies costs one entry a pack.

Defined results: a null or empty text, and one whose joined token bytes differ from space+text on a side, has no
tokens, zeros and an empty groups string; rows that repeat a doc_id, or have none, are separate documents and count
each; an empty table gives no rows. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.packed import grouped, parts, spread, squeezed, unparts, unsqueezed
from docquarry.llm.textkeys import quoted, slices
from docquarry.session import saved, table

#: A space before which both tokenizers cut whatever stands around it.
_CUT = re.compile(r"(?<=[^ ]) (?=[!-~\w])")
_VISIBLE = re.compile(r"[!-~\w]")
SHIFT = np.uint64(32)  # a pair is A's id << 32 | B's id


class Aligner:
    """Alignments of texts, unit by unit; remembers up to ``most`` distinct units."""

    def __init__(self, byte_file: str, piece_file: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level entries show as themselves
        rest = iter(range(256, 512))
        letter = {chr(b if b in own else next(rest)): b for b in range(256)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in entry) if all(c in letter for c in entry) else entry.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        #: Of each unit: A's tokens, B's, groups, links, whether the bytes agree, and where its pairs are.
        self.facts = np.zeros((1 << 16, 7), np.int64)
        self.pool, self.mult, self.used = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.uint32), 0

    def _learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 20_000):
            self._learn_some(units[k : k + 20_000])

    def _learn_some(self, units: list[str]) -> None:
        a_ids = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        b_ids = self.b.encode(units)
        fine = np.zeros(len(units), bool)
        for i, u in enumerate(units):
            raw = b" " + u.encode()
            fine[i] = b"".join(map(self.a_bytes.__getitem__, a_ids[i])) == raw == b"".join(map(self.b_bytes.__getitem__, b_ids[i]))
        a_n, b_n = (np.array([len(x) if f else 0 for x, f in zip(ids, fine, strict=True)], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.array([t for x, f in zip(ids, fine, strict=True) if f for t in x], np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        low = np.searchsorted(b_end, a_end - self.a_len[a], "right")  # the first B token that ends after A's begins
        n_links = np.searchsorted(b_end - self.b_len[b], a_end, "left") - low
        unit = np.repeat(np.arange(len(units)), a_n)
        pair = (np.repeat(a, n_links).astype(np.uint64) << SHIFT) | b[np.repeat(low, n_links) + spread(n_links)].astype(np.uint64) if len(a) else np.zeros(0, np.uint64)
        owner = np.repeat(unit, n_links)
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]) if len(pair) else np.zeros(0, bool))
        mult = np.diff(np.append(new, len(pair)))
        size = np.bincount(owner[new], minlength=len(units))
        cut = np.isin(a_end, b_end)  # groups end where both do
        cut_b = np.isin(b_end, a_end)
        n = len(self.known)
        while n + len(units) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        while self.used + len(new) > len(self.pool):
            self.pool, self.mult = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pool, self.mult))
        self.pool[self.used : self.used + len(new)], self.mult[self.used : self.used + len(new)] = pair[new], mult
        own = self.facts[n : n + len(units)]
        own[:, 0], own[:, 1], own[:, 4], own[:, 6] = a_n, b_n, fine, size
        own[:, 2] = np.bincount(unit[cut], minlength=len(units))
        own[:, 3] = np.bincount(owner, minlength=len(units))
        own[:, 5] = self.used + np.cumsum(size) - size
        self.used += len(new)
        at, bt = 0, 0
        cut, cut_b = cut.tolist(), cut_b.tolist()
        for i, u in enumerate(units):
            self.known[u] = n + i
            if not fine[i]:
                self.groups.append("")
                continue
            left, right = (";" if cut[at + j] else "," for j in range(a_n[i])), (";" if cut_b[bt + j] else "," for j in range(b_n[i]))
            a_text = "".join(x for t, s in zip(a_ids[i], left, strict=True) for x in (str(t), s))[:-1].split(";")
            b_text = "".join(x for t, s in zip(b_ids[i], right, strict=True) for x in (str(t), s))[:-1].split(";")
            self.groups.append(";".join([f"{x}|{y}" for x, y in zip(a_text, b_text, strict=True)]))
            at, bt = at + int(a_n[i]), bt + int(b_n[i])

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The unit of every place, by number, and where each text's units begin (and the last's end)."""
        if len(self.known) > self.most:
            self.clear()
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        words, index, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        odd = np.array([not _VISIBLE.match(w) for w in words], bool)
        apart = np.flatnonzero(np.add.reduceat(odd[index], bounds[:-1]) if len(index) else []) if odd.any() else np.zeros(0, np.int64)
        if len(apart):  # texts with runs of spaces, or a space before another sign than a visible one
            odd_texts = set(apart.tolist())
            flat = [_CUT.split(t) if i in odd_texts else t.split(" ") for i, t in enumerate(texts.to_pylist())]
            coded = pa.array([w for x in flat for w in x], pa.string()).dictionary_encode()
            words, index, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum([0, *map(len, flat)])
        own = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(own < 0)
        if len(new):
            self._learn([words[i] for i in new])
            own[new] = np.fromiter((self.known[words[i]] for i in new), np.int64, len(new))
        return own[index], bounds

    def pack(self, texts: pa.Array) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """facts[text] (A's tokens, B's, groups, links), hashes of the groups, and the run: pairs in ascending
        order, how many texts hold each, and these texts with the pair's occurrences."""
        texts = pc.fill_null(texts, "")
        unit, bounds = self.units(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        sums = np.zeros((len(unit) + 1, 5), np.int64)
        np.cumsum(self.facts[unit, :5], axis=0, out=sums[1:])
        facts = sums[bounds[1:]] - sums[bounds[:-1]]
        good = (facts[:, 4] == np.diff(bounds)) & (pc.binary_length(texts).to_numpy() > 0)
        facts[~good] = 0
        shas = [hashlib.sha256(";".join(map(self.groups.__getitem__, unit[x:y].tolist())).encode()).hexdigest() if g else "" for x, y, g in zip(bounds, bounds[1:], good, strict=False)]
        kept = good[doc]
        key, times = np.unique((doc[kept].astype(np.uint64) << SHIFT) | unit[kept].astype(np.uint64), return_counts=True)
        doc, unit = (key >> SHIFT).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = self.facts[unit, 6]
        at = np.repeat(self.facts[unit, 5], size) + spread(size)
        pair, doc, times = self.pool[at], np.repeat(doc, size), np.repeat(times, size) * self.mult[at]
        order = np.lexsort((doc, pair))
        pair, doc, times = pair[order], doc[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]) if len(pair) else np.zeros(0, bool))
        times = np.add.reduceat(times, new) if len(new) else times
        pair, doc = pair[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool))
        return facts[:, :4], shas, (pair[first], np.diff(np.append(first, len(pair))), doc, times)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_file: str, piece_file: str) -> Aligner:
    """One aligner for each pair of files and Python worker."""
    if (byte_file, piece_file) not in _ALIGNERS:
        _ALIGNERS[byte_file, piece_file] = Aligner(byte_file, piece_file)
    return _ALIGNERS[byte_file, piece_file]


def merged(runs: list[tuple[np.ndarray, np.ndarray]], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of sorted runs (keys ascending, counts): a heap of the runs by their next key gives one
    block after the other, in order."""
    heap = [(int(keys[0]), i, 0) for i, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    out_keys, out_counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    while heap:
        _, i, at = heap[0]
        bound = runs[i][0][min(at + block, len(runs[i][0])) - 1]
        keys, counts = [], []
        while heap and heap[0][0] <= bound:
            _, i, at = heapq.heappop(heap)
            own = runs[i][0]
            end = at + int(np.searchsorted(own[at : at + 4 * block], bound, "right"))
            while end < len(own) and own[end] <= bound:
                end += int(np.searchsorted(own[end : end + 4 * block], bound, "right"))
            keys.append(own[at:end])
            counts.append(runs[i][1][at:end])
            if end < len(own):
                heapq.heappush(heap, (int(own[end]), i, end))
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.uint64)
        np.add.at(total, where, np.concatenate(counts))
        out_keys.append(found)
        out_counts.append(total)
    return np.concatenate(out_keys), np.concatenate(out_counts)


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs, A's id by A's id, have the highest count of their A id."""
    if not len(keys):
        return np.zeros(0, bool)
    a = keys >> SHIFT
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))


_PACK = "doc_ids array<long>, facts array<long>, shas array<string>, run binary"


def align(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", key: str = "doc_id", bytes_per_pack: int = 1 << 22, packs_per_part: int = 8) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A task holds one pack, or one radix part: at most one entry for each pack and pair of its A ids.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_file, piece_file)
        for part in slices(batches, "__text", bytes_per_pack):
            facts, shas, run = own.pack(part.column("__text"))
            row = [[part.column("__key").to_pylist()], [facts.reshape(-1).tolist()], [shas], [parts(squeezed(run[0], True), *map(squeezed, run[1:]))]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()), strict=True)], names=["doc_ids", "facts", "shas", "run"])

    rows = docs.select(F.col(quoted([key])[0]).cast("long").alias("__key"), F.col(quoted([text])[0]).alias("__text"))
    packs = saved(rows.mapInArrow(encoded, _PACK).withColumn("pack", F.monotonically_increasing_id()), "align-packs")
    n_parts = max(64, packs.count() // packs_per_part)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, run in zip(batch.column("pack").to_pylist(), batch.column("run"), strict=True):
                pair, n = map(unsqueezed, unparts(run.as_py())[:2])
                part = ((pair >> SHIFT) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(n_parts + 1))
                here = np.flatnonzero(np.diff(cut))
                blobs = [parts(squeezed(pair[o], True), squeezed(n[o])) for o in (order[cut[p] : cut[p + 1]] for p in here)]
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array([pack] * len(here), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "pack", "blob"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in grouped(batches, "part"):
            runs = [tuple(map(unsqueezed, unparts(r["blob"]))) for r in held]
            keys, counts = merged(runs)
            best = highest(keys, counts).astype(np.uint64)
            for r, (own, _) in zip(held, runs, strict=True):
                at = np.searchsorted(keys, own)
                yield pa.RecordBatch.from_arrays([pa.array([r["pack"]], pa.int64()), pa.array([part], pa.int64()), pa.array([parts(squeezed(counts[at]), squeezed(best[at]))], pa.binary())], names=["pack", "part", "blob"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped(batches, "pack"):
            own, replies = held[0], {r["part"]: r["blob"] for r in held[1:]}
            pair, n, doc, times = map(unsqueezed, unparts(own["run"]))
            part = ((pair >> SHIFT) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            count, best = np.zeros((2, len(pair)), np.uint64)
            if replies:
                come = [unparts(replies[p]) for p in sorted(replies)]
                count[order], best[order] = (np.concatenate([unsqueezed(c[k]) for c in come]) for k in (0, 1))
            n_docs = len(own["doc_ids"])
            sums = np.zeros((2, n_docs), np.int64)
            times, doc, again = times.astype(np.int64), doc.astype(np.int64), np.repeat(np.arange(len(pair)), n.astype(np.int64))
            np.add.at(sums[0], doc, times * best[again].astype(np.int64))
            np.add.at(sums[1], doc, times * count[again].astype(np.int64))
            facts = np.array(own["facts"], np.int64).reshape(n_docs, 4)
            out = [pa.array(own["doc_ids"], pa.int64()), *(pa.array(facts[:, j]) for j in range(4)), pa.array(sums[0]), pa.array(sums[1]), pa.array(own["shas"], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    sent = packs.select("pack", "run").mapInArrow(dealt, "part long, pack long, blob binary")
    replies = sent.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(counted, "pack long, part long, blob binary")
    both = packs.withColumn("part", F.lit(-1).cast("long")).withColumn("blob", F.lit(None).cast("binary")).unionByName(replies, allowMissingColumns=True)
    n_out = max(64, n_parts)
    return both.repartition(n_out, "pack").sortWithinPartitions("pack", "part").mapInArrow(added, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
