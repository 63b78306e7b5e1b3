"""Vectorised word and shingle hashing over Arrow text columns; whole texts, no loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4_000_000


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about limit bytes; a longer text is a run of its own."""
    i = size = 0
    for j, b in enumerate(texts):
        if size and size + len(b) > limit:
            yield i, j
            i, size = j, 0
        size += len(b) + 1
    if i < len(texts):
        yield i, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(texts: list[bytes], letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, first word of each text and the end) of the words, ASCII letters lower-cased.

    Words lie between ASCII white space; with letters, between ASCII bytes that are no letters or digits.
    """
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined.lower(), np.uint8)
    inside = np.ones(256, np.int8)
    inside[[9, 10, 11, 12, 13, 32]] = 0
    if letters:
        inside[:128] = [chr(i).isalnum() for i in range(128)]
    edge = np.diff(inside[buffer], prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter((len(b) + 1 for b in texts), np.int64, len(texts))
    limits = np.concatenate([[0], np.cumsum(sizes)])
    return buffer, starts, ends, np.searchsorted(starts, limits)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (starts ascending): a polynomial over a prefix sum, then mixed with the length.

    A hash doesn't depend on the place, so long buffers are worked on piece by piece.
    """
    if len(buffer) > 1 << 19 and len(starts) > 1:
        half = len(starts) // 2
        cut, end = int(starts[half]), int(ends[:half].max())
        return np.concatenate([span_hashes(buffer[:end], starts[:half], ends[:half]), span_hashes(buffer[cut:], starts[half:] - cut, ends[half:] - cut)])
    r, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    n = len(buffer)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers(r, n), out=total[1:])
    own = (total[ends] - total[starts]) * _powers(inverse, n)[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix(own ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, texts in order, and each text's limits in them.

    A text of fewer words gives its whole sequence as one shingle; a text without words gives none.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    limits = np.concatenate([[0], np.cumsum(n)])
    long = count >= k
    at = np.arange(limits[-1]) - np.repeat(limits[:-1], n) + np.repeat(first[:-1], n)
    multiplier = np.uint64(0x9FB21C651E98DF25)
    out = np.zeros(limits[-1], np.uint64)
    full = np.repeat(long, n)
    pos = at[full]
    h = np.full(len(pos), k, np.uint64)
    for j in range(k):
        h = (h ^ hashes[pos + j]) * multiplier
        h ^= h >> np.uint64(32)
    out[full] = mix(h)
    for i in np.flatnonzero((count > 0) & ~long):
        h = np.array([count[i]], np.uint64)
        for j in range(first[i], first[i + 1]):
            h = (h ^ hashes[j : j + 1]) * multiplier
            h ^= h >> np.uint64(32)
        out[limits[i]] = mix(h)[0]
    return out, limits
