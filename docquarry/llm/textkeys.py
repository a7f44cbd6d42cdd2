"""Words and shingles of many texts at once, as 64-bit keys in numpy arrays.

Texts are translated byte by byte (UTF-8; A-Z to lower case, separators to a space), so that words are
what ``bytes.split()`` gives. A word's key is a sum of byte values times a pseudorandom factor of each place, mixed
(multilinear hashing); a shingle's key combines the keys of its words. Keys depend on nothing but the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(names: list[str]) -> list[str]:
    """Column names as ``select`` reads them: dots and signs stay parts of a name."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words [^\x20\x09-\x0D]+ of the lower-cased text.
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else _LOWER[b] for b in range(256))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
ALNUM = bytes(_LOWER[b] if _LOWER[b] >= 128 or 48 <= _LOWER[b] <= 57 or 97 <= _LOWER[b] <= 122 else 32 for b in range(256))

_ODD = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_FACTOR = np.zeros(0, np.uint64)


def _factors(n: int) -> np.ndarray:
    """An odd pseudorandom factor for each place in a word."""
    global _FACTOR
    if len(_FACTOR) < n:
        _FACTOR = mix64(np.arange(1, max(n, 64) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return _FACTOR


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word in translated bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = np.frombuffer(buf, np.uint8) != 32
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_keys(buf: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    data = np.frombuffer(buf, np.uint8)
    data = data[data != 32]
    return mix64(np.add.reduceat(_BYTE[data] * _factors(int(size.max()))[place], first) + size.astype(np.uint64))


def shingle_keys(words: np.ndarray, k: int) -> np.ndarray:
    """Key of the k words from each position on; empty if there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * np.uint64(pow(_ODD | 1, 2 * j + 3, 2**64))
    return mix64(out)


def translated(texts: list[str | None], way: bytes) -> tuple[bytes, np.ndarray]:
    """The texts' translated bytes, each followed by a space, and where each begins (and the last ends)."""
    parts = [(t or "").encode().translate(way) for t in texts]
    return b" ".join([*parts, b""]), np.cumsum([0, *(len(p) + 1 for p in parts)])


def keyed(texts: list[str | None], way: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Translated bytes, begin and end of words, keys of words, and each text's range of words."""
    buf, at = translated(texts, way)
    begin, end = word_spans(buf)
    return buf, begin, end, word_keys(buf, begin, end), np.searchsorted(begin, at)


Column = str | int


def column(batch: pa.RecordBatch, text: Column) -> pa.Array:
    """The batch's column of that name; a number is the place of a field in its first column, a record."""
    return batch.column(text) if isinstance(text, str) else batch.column(0).field(text)


def slices(batches: Iterator[pa.RecordBatch], text: Column, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most_bytes`` of text, one row at least: memory follows the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.nan_to_num(pa.compute.binary_length(column(batch, text)).to_numpy(zero_copy_only=False).astype(float))
        part = np.floor(np.cumsum(size) / most_bytes)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def mapped(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: Column) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield fn(part)

    return run


def recorded(df: DataFrame, text: str, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, Column]:
    """``df`` with all its columns (or ``keep``) in one record ``rec``, so that no name of theirs meets another,
    and where the text is: in the record, or beside it in a column ``text``."""
    kept = list(df.columns if keep is None else keep)
    rec = F.struct(*quoted(kept)).alias("rec")
    if text in kept:
        return df.select(rec), kept.index(text)
    return df.select(rec, F.col(quoted([text])[0]).alias("text")), "text"
