"""Token ids in directly addressable codes.

A block holds the ids of consecutive whole documents. Each id is cut into 8-bit chunks: level 0 has the
low chunk of every id, level i the next chunk of those ids that go on. Beside each level lies a bitmap
that tells which of its entries go on, and a directory of the set bits before every 512th bit, so that
token i is read by one rank a level, without decoding its neighbours. Blocks are rows of Parquet files
in ascending order of document, so Spark's commit makes the files whole or absent.

Block image, little-endian: "DACT", version u32, ids u64, levels u32, documents u32; for each document
its first id u64; then for each level: entries u64, chunks u8[entries], bitmap u8[ceil(entries/8)]
(low bit first), directory u32[entries/512 + 1].

Defined results: a null or empty text gives the end id alone; documents repeat if their rows do; rows
with a null doc_id come first; an empty table gives no rows. Only the id and the text are read, so other columns
may have any names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.textkeys import quoted, slices
from docquarry.session import new_path, table

MAGIC, EVERY = b"DACT", 512


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The block image of ids; starts: the first id of each document."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        on = rest >= 256
        bits = np.packbits(on, bitorder="little").tobytes()
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, len(on), EVERY)) if len(on) else [])])[: len(rest) // EVERY + 1]
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits + ranks.astype("<u4").tobytes())
        rest = rest[on] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<IQII", 1, len(ids), len(levels), len(starts)) + starts.astype("<u8").tobytes() + b"".join(levels)


class Block:
    """A block image, read in place."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a block of token codes")
        _, self.n_ids, n_levels, n_docs = struct.unpack_from("<IQII", image, 4)
        self.starts = np.frombuffer(image, "<u8", n_docs, 24)
        self.levels, at = [], 24 + 8 * n_docs
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 8)
            bits = np.frombuffer(image, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(image, "<u4", n // EVERY + 1, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * len(ranks)

    def __getitem__(self, i: int) -> int:
        """Id i: one chunk and one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            base = i // EVERY
            inside = np.unpackbits(bits[base * (EVERY // 8) : (i >> 3) + 1], bitorder="little")[: i - base * EVERY]
            i = int(ranks[base]) + int(inside.sum())
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids, for whole scans."""
        out: np.ndarray | None = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None:
                value[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = value
        return out


_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Between a letter and an ASCII sign the tokenizer always cuts.
_SIGN = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level models use for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


class Encoder:
    """Ids of texts, exactly those of the tokenizer's ``encode(text, add_special_tokens=False)``.

    No piece that the tokenizer encodes holds a space or newline, so texts are cut there and each
    distinct word is encoded once and remembered, up to ``most_words``. Words of printable ASCII and
    Latin-1 letters, for which the tokenizer's normalisation is lower case alone, go to its BPE model
    directly; all others, and those with a special token, through ``encode``.
    """

    def __init__(self, file: str, most_words: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(file), most_words
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        probe = ["Word's", "ÉTÉ,", "a1b2...", "ß-Öl$$$", "it'S'LL!?", "x", "'Twas", "don't've", "3rd/4TH", "((x))", "e.g.,", "ñÑ'd", "100%", "a--b__c", "user@host.de", "Þórr#1", "``q''", "X'RE!'s", "÷×", "\\n{}[]~^|"]
        self.direct = all(self._direct(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0
        self.at, self.size, self.seen = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Forget words seen in one batch only, and beyond half of the limit the rarer ones."""
        n = len(self.known)
        keep = np.flatnonzero(self.seen[:n] > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[: self.most // 2]])
        words, at, size, seen = list(self.known), self.at[keep], self.size[keep], self.seen[keep]
        old, end = self.pool, np.cumsum(size)
        self.clear()
        self.used = int(end[-1]) if len(end) else 0
        self.pool = np.concatenate([old[np.repeat(at - (end - size), size) + np.arange(self.used)], np.zeros(1 << 20, "<u4")])
        self.known = {words[i]: j for j, i in enumerate(keep.tolist())}
        room = np.zeros(max(1 << 16, len(keep)), np.int64)
        self.at, self.size, self.seen = (np.concatenate([x, room]) for x in (end - size, size, seen // 2))

    def _direct(self, word: str) -> list[int]:
        out: list[int] = []
        for piece in _PIECES.findall(word.lower()):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            out += [t.id for t in self.tokenizer.model.tokenize(piece)]
        return out

    def _learn(self, words: list[str]) -> None:
        slow = []
        for w in words:
            if self.direct and _PLAIN.fullmatch(w) and not ("<" in w and any(s in w for s in self.special)):
                self._keep(w, self._direct(w))
            else:
                slow.append(w)
        for k in range(0, len(slow), 1024):
            part = slow[k : k + 1024]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                self._keep(w, e.ids)

    def _keep(self, word: str, ids: list[int]) -> None:
        i, n = len(self.known), len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if i == len(self.at):
            self.at, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.seen))
        self.pool[self.used : self.used + n] = ids
        self.at[i], self.size[i], self.known[word] = self.used, n, i
        self.used += n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the last's end)."""
        if len(self.known) > self.most:
            self._shrink()
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        special = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special)))
        signed = pc.replace_substring_regex(texts, _SIGN, r"\1 \2")
        split = pc.split_pattern(pc.if_else(special, texts, signed) if pc.any(special).as_py() else signed, " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        own = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(own < 0)
        if len(new):
            self._learn([words[i] for i in new])
            own[new] = np.fromiter((self.known[words[i]] for i in new), np.int64, len(new))
        self.seen[own] += 1
        at, size = self.at[own].astype(np.int32)[index], self.size[own].astype(np.int32)[index]
        end = np.cumsum(size, dtype=np.int32)
        total = int(end[-1]) if len(end) else 0
        source = np.repeat(at - (end - size), size)
        source += np.arange(total, dtype=np.int32)
        return self.pool[source], np.concatenate([[0], end])[bounds - bounds[0]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def _joined(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with end_id after each text, and the new bounds."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def write(docs: DataFrame, path: str, file: str, end_id: int = 1, text: str = "text", key: str = "doc_id", block_ids: int = 1 << 18, bytes_per_file: int = 1 << 26) -> None:
    """Encode every text and write blocks to ``path``, in ascending order of key over the files.

    Texts are shuffled once, by ranges of the key, of about ``bytes_per_file`` of text each; ids go straight to the
    files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(file)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        count = first = 0

        def block() -> pa.RecordBatch:
            nonlocal held, count, first
            keys = [k for h in held for k in h[0]]
            ids = np.concatenate([h[1] for h in held])
            at = np.cumsum([0, *(len(h[1]) for h in held)])
            starts = np.concatenate([h[2][:-1] + a for h, a in zip(held, at, strict=False)])
            row = [[first], [keys], [len(ids)], [pack(ids, starts)]]
            held, count, first = [], 0, first + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()), strict=True)], names=["first", "doc_ids", "n_ids", "image"])

        for part in slices(batches, "__text", 1 << 21):
            ids, bounds = _joined(*code.encode(part.column("__text")), end_id)
            held.append((part.column("__key").to_pylist(), ids, bounds))
            count += len(ids)
            if count >= block_ids:
                yield block()
        if held:
            yield block()

    rows = docs.select(F.col(quoted([key])[0]).cast("long").alias("__key"), F.col(quoted([text])[0]).alias("__text"))
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism * 4, total // bytes_per_file)
    blocks = rows.repartitionByRange(n, F.col("__key").asc_nulls_first()).sortWithinPartitions(F.col("__key").asc_nulls_first()).mapInArrow(run, "first long, doc_ids array<long>, n_ids long, image binary")
    blocks.withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian u32) of every document of
    the files at ``path``. The driver holds one number for each file."""
    blocks = spark.read.parquet(path)
    sums = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before = dict(zip((r[0] for r in sums), np.cumsum([0, *(r[1] for r in sums)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, keys, image in zip(*(batch.column(c) for c in ("part", "first", "doc_ids", "image")), strict=True):
                block = Block(image.as_buffer().to_pybytes())
                data, cut = block.ids().astype("<u4").tobytes(), [*(4 * int(s) for s in block.starts), 4 * block.n_ids]
                spans = list(zip(cut, cut[1:], strict=False))
                begin = before[part.as_py()] + first.as_py()
                out = {
                    "doc_id": pa.array(keys.as_py(), pa.int64()),
                    "start": pa.array([begin + a // 4 for a, _ in spans], pa.int64()),
                    "n_tokens": pa.array([(b - a) // 4 for a, b in spans], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(memoryview(data)[a:b]) for a, b in spans], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([data[a:b] for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("part", "first", "doc_ids", "image").mapInArrow(run, schema)


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-codes")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path, with_ids=False)
