"""Vectorised 64-bit hashes of the words of Arrow text columns.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z folded to a-z. All words of a batch
are hashed at once on the UTF-8 buffer: prefix sums of ``T[byte] * B**i`` modulo
2**64 give each word's polynomial value, which is mixed to 64 even bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor, shift and multiply) on uint64."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sequence(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


_TABLE = _sequence(256, 7)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: list[np.ndarray] = []


def _pow_tables() -> list[np.ndarray]:
    if not _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            out = np.full(CHUNK + 1, _U(base))
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers


def _hash_chunk(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of data, where each begins and ends; no word crosses an index of starts_at."""
    n = len(data)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = _pow_tables()
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = starts_at[starts_at < n]
    first[cut] |= solid[cut]
    begins = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = cut[cut > 0]
    last[cut - 1] |= solid[cut - 1]
    ends = np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * inverse[begins]), begins, ends


def _hash_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One text of any length, cut at white space into chunks. A single word
    longer than a chunk is hashed piece by piece and the pieces are combined."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, at, open_word = len(data), 0, False
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            spaces = np.flatnonzero(_SPACE[data[at:to]])
            if len(spaces):
                to = at + int(spaces[-1]) + 1
        h, begins, ends = _hash_chunk(data[at:to], np.zeros(1, np.int64))
        begins, ends = begins + at, ends + at
        if open_word and len(h) and begins[0] == at:  # goes on from the last chunk
            was, b, e = parts[-1]
            was[-1:] = mix(was[-1:] * _U(_BASE) + h[0])
            e[-1] = ends[0]
            h, begins, ends = h[1:], begins[1:], ends[1:]
        if len(h):
            parts.append((h, begins, ends))
        open_word = not _SPACE[data[to - 1]]
        at = to
    if not parts:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def located_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (lo, hi, hashes, offsets, begins, ends): the words of texts[lo:hi],
    those of text lo + j at offsets[j]:offsets[j + 1]; begins and ends are places
    in the bytes of `buffers(texts)`."""
    if not len(texts):
        return
    data, at = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = min(int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1, len(texts))
        if hi <= lo:  # one text that is longer than a chunk
            h, begins, ends = _hash_long(data[at[lo] : at[lo + 1]])
            yield lo, lo + 1, h, np.array([0, len(h)]), begins + at[lo], ends + at[lo]
            lo += 1
            continue
        edge = at[lo : hi + 1] - at[lo]
        h, begins, ends = _hash_chunk(data[at[lo] : at[hi]], edge[:-1])
        yield lo, hi, h, np.searchsorted(begins, edge), begins + at[lo], ends + at[lo]
        lo = hi


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As located_words, without places."""
    for found in located_words(texts):
        yield found[:4]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; a shorter, not empty sequence is one run."""
    if 0 < len(words) < n:
        n = len(words)
    m = len(words) - n + 1
    if m <= 0 or not len(words):
        return np.empty(0, _U)
    out = np.full(m, _U(n))
    for k in range(n):
        out = out * _U(_BASE) + words[k : k + m]
    return mix(out)
