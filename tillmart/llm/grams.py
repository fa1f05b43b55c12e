"""Hashed byte n-grams of many texts at once, in numpy. What is counted for a text depends on that text alone."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and texts handled at a time.
PORTION_BYTES, PORTION_TEXTS = 1 << 20, 256


def portions(column: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows and their whole texts, PORTION_BYTES and PORTION_TEXTS at a time; a longer text comes alone. Null and empty texts are left out."""
    rows, texts, held = [], [], 0
    for row, entry in enumerate(column):
        data = entry.as_py() or b""
        if texts and (held + len(data) > PORTION_BYTES or len(texts) == PORTION_TEXTS):
            yield rows, texts
            rows, texts, held = [], [], 0
        if data:
            rows.append(row)
            texts.append(data)
            held += len(data)
    if rows:
        yield rows, texts


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and which text each belongs to."""
    lengths = np.array([len(text) for text in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), lengths)


def gram_buckets(data: np.ndarray, owner: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the owner of each run of `size` bytes with one owner."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = owner[:count] == owner[size - 1 :]
    return _buckets(data, size, buckets)[inside], owner[:count][inside]


def _buckets(data: np.ndarray, size: int, buckets: int) -> np.ndarray:
    code = np.full(len(data) - size + 1, size, np.uint32)
    for n in range(size):
        code = code * np.uint32(0x01000193) ^ data[n : n + len(code)]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(7)
    return (code % np.uint32(buckets)).astype(np.int64)


def gram_counts_of(data: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Counts of the buckets in one text, hashed some bytes at a time; each portion begins with the last size - 1 bytes of the one before."""
    counts = np.zeros(buckets, np.int64)
    for start in range(0, max(len(data) - size + 1, 0), PORTION_BYTES):
        counts += np.bincount(_buckets(data[start : start + PORTION_BYTES + size - 1], size, buckets), minlength=buckets)
    return counts
