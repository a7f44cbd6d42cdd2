"""Sorted integer arrays as small zstd blobs, and rows that meet by key in sorted partitions.

A blob holds an array's values, or the differences of an ascending one, byte plane by byte plane, so that high
bytes that hardly change cost next to nothing. ``grouped`` streams the rows of one key after another from batches
that are sorted by that key, so a task holds one key's rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_OUT, _IN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(values: np.ndarray, ascending: bool = False) -> bytes:
    """The blob of non-negative integers; ``ascending`` stores differences."""
    v = np.asarray(values).astype(np.uint64)
    if ascending and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width, int(ascending)]) + len(v).to_bytes(8, "little") + _OUT.compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(blob: bytes) -> np.ndarray:
    """The values of a blob, as unsigned 64-bit integers."""
    width, ascending, n = blob[0], blob[1], int.from_bytes(blob[2:10], "little")
    planes = np.frombuffer(_IN.decompress(blob[10:], max_output_size=max(1, width * n)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    v = out.reshape(-1).view("<u8").astype(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if ascending else v


def parts(*blobs: bytes) -> bytes:
    """Several blobs as one."""
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def unparts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Each key with its rows, from batches in which equal keys follow each other."""
    held, now = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts, one after the other."""
    end = np.cumsum(counts)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - counts, counts)
