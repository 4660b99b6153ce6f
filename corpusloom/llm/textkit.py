"""Whole Arrow batches of texts to word and shingle hashes, vectorised over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE_OF_WORD = np.where(SPACE, _U(0), _BYTE[LOWER])
#: Apart from words of letters and digits: every ASCII character that is neither a digit nor a small letter.
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_BYTE_OF_TERM = np.where(MARKS, _U(0), _BYTE)
_ROOT, _BACK = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_PLACE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0x2D358DCCAA6C78A5], dtype=_U)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n at least; grown by doubling and kept."""
    have = _POWERS.get(base, np.ones(1, dtype=_U))
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    _POWERS[base] = have
    return have


def word_hashes(data: np.ndarray, bounds: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs free of white space, A-Z lower-cased; with terms, runs free of MARKS, as they are)
    of texts laid end to end in data, and the number of the first word of each text (with the total as the last
    entry)."""
    if not len(data):
        return np.zeros(0, dtype=_U), np.zeros(len(bounds), dtype=np.int64)
    solid = ~(MARKS if terms else SPACE)[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_BYTE_OF_TERM if terms else _BYTE_OF_WORD)[data] * _powers(_ROOT, len(data))[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * _powers(_BACK, len(data))[s]), np.searchsorted(s, bounds)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words each, in order; of fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * _PLACE[:n]).sum(keepdims=True) + _U(n))
    m = n - k + 1
    out = words[:m] * _PLACE[0]
    for i in range(1, k):
        out = out + words[i : i + m] * _PLACE[i]
    return mix(out)


def spans(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of its texts) of runs of about `most` bytes; nulls are empty texts."""
    texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    if len(hashes) < 2:
        return hashes.copy()
    out = np.sort(hashes)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingle_sets(texts: pa.Array, k: int, least_words: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """For each text in order, its number of words and its distinct k-word shingles as sorted hashes (none for
    texts of fewer than least_words words)."""
    for _, data, bounds in spans(texts):
        words, at = word_hashes(data, bounds)
        every = shingle_hashes(words, k) if len(words) >= k else words[:0]  # those across two texts are left out below
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a < least_words:
                yield b - a, words[:0]
            else:
                yield b - a, distinct(every[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k))
