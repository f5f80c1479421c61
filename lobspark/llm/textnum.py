"""Whole-array text work on Arrow string columns: word bounds, word hashes, k-word hashes.

Texts stay UTF-8 bytes. Every separator used here is ASCII, and no byte of a multi-byte character is, so
bytes can be cut without decoding. Hashes are 64-bit polynomial hashes over random byte values, finished by a
bijective mix; equal words always get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is worked on alone.
CHUNK = 1 << 21
#: The same where every byte gets 64-bit hashes: a worker holds some ten arrays of eight times as many bytes.
HASHED = 1 << 19
U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_P_INV, _Q_INV = pow(_P, -1, 1 << 64), pow(_Q, -1, 1 << 64)
#: [\x20\x09-\x0D]
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: [\x00-\x2F\x3A-\x60\x7B-\x7F]
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix((np.arange(256, dtype=U) + U(1)) * U(_P))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**1 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.cumprod(np.full(max(n, 1 << 16), base, U), dtype=U)
        if n > 2 * HASHED:  # one very long text; its table isn't kept
            return out
        have = _powers[base] = out
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their bounds; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, bounds, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if bounds is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bounds, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `most` bytes of text, or one row."""
    _, off = utf8(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_bounds(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its row. A word never spans two rows."""
    inside = ~separators[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off[1:], starts, "right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * powers(_P, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_P_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(_Q))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes, across rows too: the caller masks those."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    if k <= 8:
        out = np.zeros(n - k + 1, U)
        q = 1
        for j in range(k):
            out += h[j : n - k + 1 + j] * U(q)
            q = q * _Q % (1 << 64)
        return mix(out)
    total = np.zeros(n + 1, U)
    np.cumsum(h * powers(_Q, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_Q_INV, n)[: n - k + 1])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+counts[0]-1, starts[1] .. and so on."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every row (lower-cased A-Z), and their bounds.

    Words are `[^\\x20\\x09-\\x0D]+`. A row with 1 to k-1 words has its whole sequence as one shingle; a row
    without words has none.
    """
    rows = len(off) - 1
    data = LOWER[data]
    starts, ends, row = word_bounds(data, off, SPACES)
    h = word_hashes(data, starts, ends)
    g = run_hashes(h, k)
    ok = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    value, owner = g[ok], row[: len(g)][ok]
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = []
        for r in short:
            v = 0
            for x in h[first[r] : first[r + 1]].tolist():
                v = (v * _Q + x + 1) % (1 << 64)
            extra.append(v)
        value = np.concatenate([value, mix(np.array(extra, U))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
