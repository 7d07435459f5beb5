"""Words, word hashes and SimHash fingerprints of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _table() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


#: Maps UTF-8 bytes: A-Z to lower case, all other ASCII characters but digits and a-z to a space.
WORDS_ONLY = _table()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    if len(_powers[base]) < n:
        _powers[base] = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(max(n, 1024), base)]))
    return _powers[base][:n]


def word_bounds(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer as numbers, and starts and ends of its words: runs of bytes over 0x20."""
    a = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = a > 0x20
    edge = np.diff(inside)
    return a, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Words are hashed in stretches of about so many bytes, so that what they take stays in the processor's cache.
_STRETCH = 1 << 15


def word_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in the place within the word, then mixed.

    It is a difference of running sums over a stretch of words, divided by the power at which the word starts.
    """
    out = np.zeros(len(starts), U64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + _STRETCH, side="right")))
        here, until = slice(first, last), int(ends[last - 1])
        sums = np.zeros(until - begin + 1, U64)
        np.cumsum(_BYTE[a[begin:until]] * powers(until - begin), out=sums[1:])
        at = starts[here] - begin
        out[here] = (sums[ends[here] - begin] - sums[at]) * powers(until - begin, _INVERSE)[at]
        first = last
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, by the place of the first."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for i in range(k):
        total = total * _BASE + words[i : i + n]
    return mix(total)


def _spread() -> np.ndarray:
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.ascontiguousarray(bits.astype(np.uint8)).view(U64).ravel()


_SPREAD = _spread()


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each run of ``counts`` hashes have each bit: a row of 64 for each run, bytes where no run is over 255.

    Eight counters of a byte each are added as one 64-bit number, in stretches of at most 255 hashes.
    """
    n = counts.astype(np.int64)
    full = np.flatnonzero(n)
    small = not len(full) or n.max() <= 255
    out = np.zeros((len(n), 64), np.uint8 if small else np.int64)
    if not len(full):
        return out
    own = n[full]
    parts = (own + 254) // 255
    of = np.repeat(np.arange(len(full)), parts)
    first = np.cumsum(own) - own
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    lanes = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8)].reshape(-1, 8)
    sums = np.add.reduceat(lanes, first[of] + 255 * nth, axis=0)
    bits = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64)
    out[full] = bits if small else np.add.reduceat(bits.astype(np.int64), np.cumsum(parts) - parts, axis=0)
    return out


def majority(bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of bit counts: a bit is 1 if set in over half of the hashes, zero without any."""
    half = (counts // 2).astype(bits.dtype)
    return np.packbits(bits > half[:, None], axis=1, bitorder="little").view(U64).ravel()


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes."""
    return majority(bit_counts(hashes, counts), counts)
