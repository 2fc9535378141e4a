"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, their hashes, shingles.

A column's bytes are cut into blocks of about a megabyte at document borders; a longer document is
cut at separators, so no temporary array grows with a text beyond its words' hashes.  Separators are
single ASCII bytes, which never occur inside a multi-byte character, so byte positions are safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64
_P, _MASK = 0x9E3779B97F4A7C15 | 5, (1 << 64) - 1
_P = (_P & ~7) | 5


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = _powers(BLOCK + 1, _P)
_INV = _powers(BLOCK + 1, pow(_P, -1, 1 << 64))


def powers(n: int) -> np.ndarray:
    """The weights of the first ``n`` places of a rolling hash; n is at most a block's size."""
    return _POW[:n]


def inverses(at: np.ndarray) -> np.ndarray:
    """What takes a hash's sum back to its place."""
    return _INV[at]


#: One random 64-bit value for each byte value.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Byte values after ASCII lower-casing.
FOLDED = _BYTE[_FOLD]
#: Everything but ASCII letters, digits and bytes of longer characters separates bare words.
BARE = np.ones(256, bool)
BARE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def _cuts(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, document starts inside) of blocks; none starts in one that goes on with a document.  A block never splits a word shorter than itself."""
    n, i = len(at) - 1, 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1
        if j > i:
            yield int(at[i]), int(at[j]), at[i:j]
            i = j
            continue
        a, end = int(at[i]), int(at[i + 1])
        while a < end:
            b = min(a + BLOCK, end)
            if b < end:
                gaps = np.flatnonzero(separator[data[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
            yield a, b, np.array([a] * int(a == at[i]), np.int64)
            a = b
        i += 1


def blocks(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR, value: np.ndarray = FOLDED) -> Iterator[tuple]:
    """(start, end, words' starts, words' ends, words' hashes) of blocks that have words; positions in ``data``."""
    for a, b, begins in _cuts(data, at, separator):
        body = data[a:b]
        inside = ~separator[body]
        fresh = np.zeros(len(body) + 1, bool)
        fresh[begins[begins < b] - a] = True
        left = inside.copy()
        left[1:] &= ~inside[:-1] | fresh[1:-1]
        right = inside.copy()
        right[:-1] &= ~inside[1:] | fresh[1:-1]
        s, e = np.flatnonzero(left), np.flatnonzero(right) + 1
        if not len(s):
            continue
        total = np.empty(len(body) + 1, U64)
        total[0] = 0
        np.cumsum(value[body] * _POW[: len(body)], out=total[1:])
        h = (total[e] - total[s]) * _INV[s]
        yield a, b, s + a, e + a, mix(h ^ ((e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR, value: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the n + 1 offsets that say which row has which.

    A word of more than ``BLOCK`` bytes counts as its pieces' sequence folded into one hash.
    """
    hashes, starts, last = [], [], -1
    for a, _, s, e, h in blocks(data, at, separator, value):
        if s[0] == last == a and a != at[min(int(np.searchsorted(at, a)), len(at) - 1)]:  # the last block ended inside this word
            hashes[-1][-1] = mix(hashes[-1][-1:] * U64(31) + h[:1])[0]
            h, s = h[1:], s[1:]
        last = int(e[-1])
        if len(h):
            hashes.append(h)
            starts.append(s)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, at)


_STEP = [U64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingles(word: np.ndarray, at: np.ndarray, size: int = 4) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word shingles; of its whole sequence if it has fewer words."""
    n = len(word)
    if n >= size:
        rolled = np.zeros(n - size + 1, U64)
        for k in range(size):
            rolled += mix(word[k : n - size + 1 + k] + _STEP[k % 4]) * (_STEP[(k + 1) % 4] + U64(2 * k))
        rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own
        elif b > a:
            h = np.full(1, b - a, U64)
            for k in range(a, b):
                h = mix(h * _STEP[0] + word[k : k + 1])
            yield h
        else:
            yield np.zeros(0, U64)
