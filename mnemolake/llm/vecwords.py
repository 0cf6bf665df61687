"""Words of Arrow string columns as 64-bit hashes, by numpy over the bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Hashes are polynomial over a word's bytes
(mod 2^64) and then mixed.  Texts are taken in blocks of about a megabyte, cut between words, so the memory of
a batch does not depend on how long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLAIN = np.arange(1, 257, dtype=_U)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += _U(32)
_tables: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        n = BLOCK + 2
        for base in (_B, pow(_B, -1, 1 << 64)):
            t = np.full(n, base, _U)
            t[0] = 1
            _tables.append(np.multiply.accumulate(t))
    return _tables[0], _tables[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def _block(part: np.ndarray, breaks: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a stretch of bytes; ``breaks``: places where a text begins."""
    full = ~_SPACE[part]
    before = np.empty_like(full)
    before[0] = False
    before[1:] = full[:-1]
    before[breaks] = False
    starts = np.flatnonzero(full & ~before)
    after = np.empty_like(full)
    after[-1] = False
    after[:-1] = full[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(full & ~after) + 1
    up, down = _powers()
    sums = np.empty(len(part) + 1, _U)
    sums[0] = 0
    np.cumsum(lut[part] * up[: len(part)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407)), starts, ends


def word_hashes(column, lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for every row."""
    for row, h, _, _ in words(column, lower):
        yield row, h


def words(column, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hashes, starts, ends) for every row; starts and ends are places in the bytes of ``buffers``."""
    raw, off = buffers(column)
    lut = _LOWER if lower else _PLAIN
    n = len(off) - 1
    row = 0
    while row < n:
        a = int(off[row])
        last = int(np.searchsorted(off, a + BLOCK, side="right")) - 1
        last = min(max(last, row + 1), n)
        b = int(off[last])
        if b - a <= BLOCK:
            if b == a:
                h = s = e = np.zeros(0, np.int64)
                h = h.astype(_U)
            else:
                inner = off[row:last] - a
                h, s, e = _block(raw[a:b], inner[inner < b - a], lut)
                s, e = s + a, e + a
            cut = np.searchsorted(s, off[row : last + 1])
            for k in range(last - row):
                i, j = cut[k], cut[k + 1]
                yield row + k, h[i:j], s[i:j], e[i:j]
        else:  # one text longer than a block
            parts = list(_long(raw, a, b, lut))
            yield row, *(np.concatenate(x) for x in zip(*parts))
        row = last


def _long(raw: np.ndarray, a: int, b: int, lut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one long text, cut at spaces; a word longer than a block is hashed as one string."""
    none = np.zeros(0, np.int64)
    yield none.astype(_U), none, none
    while a < b:
        c = min(a + BLOCK, b)
        if c < b:
            spaces = np.flatnonzero(_SPACE[raw[a:c]])
            if len(spaces):
                c = a + int(spaces[-1]) + 1
            else:
                while c < b and not _SPACE[raw[c]]:
                    step = np.flatnonzero(_SPACE[raw[c : c + BLOCK]])
                    c = c + int(step[0]) if len(step) else min(c + BLOCK, b)
                word = raw[a:c]
                if lut is _LOWER:
                    word = np.where((word >= 65) & (word <= 90), word + 32, word).astype(np.uint8)
                yield np.array([xxhash.xxh3_64_intdigest(word.tobytes())], _U), np.array([a]), np.array([c])
                a = c
                continue
        h, s, e = _block(raw[a:c], none, lut)
        yield h, s + a, e + a
        a = c


def ngrams(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of the k-grams of a sequence of hashes, by doubling; empty if it is shorter."""
    if len(h) < k:
        return np.zeros(0, _U)
    base = (_B * (2 * seed + 1) + 2 * seed) & 0xFFFFFFFFFFFFFFFF | 1
    power = h * _U((2 * seed + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) ^ _U(seed)
    size, out, have, left = 1, None, 0, k
    while left:
        if left & 1:
            if out is None:
                out, have = power, size
            else:  # out covers `have` tokens, the next `size` follow
                m = min(len(out), len(power) - have)
                out = out[:m] * _U(pow(base, size, 1 << 64)) + power[have : have + m]
                have += size
        left >>= 1
        if left:
            m = len(power) - size
            power = power[:m] * _U(pow(base, size, 1 << 64)) + power[size : size + m]
            size *= 2
    return mix64(out[: len(h) - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
