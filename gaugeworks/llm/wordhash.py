"""64-bit hashes of words and word shingles, whole batches of texts at a time, in numpy.

A word's hash is a polynomial over a fixed random value per byte, modulo 2**64, then mixed.
All arithmetic wraps on purpose.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 2**64, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {"up": _powers(BASE, 1), "down": _powers(_INVERSE, 1)}


def _table(kind: str, n: int) -> np.ndarray:
    if len(_CACHE[kind]) < n:
        _CACHE[kind] = _powers(BASE if kind == "up" else _INVERSE, n)
    return _CACHE[kind][:n]


def _pieces(data: np.ndarray, most: int):
    """Views of at most ``most`` bytes, cut where a word ends; a longer word stays whole."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + most)
        while end < n:
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(n, end + most)
        yield at, data[at:end]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and how many each row has.

    ``data`` and ``offsets`` as ``text_bytes`` returns them. A-Z count as a-z; a word is a run
    of bytes other than white space (20, 09-0D) and ends with its row.
    """
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    cuts = offsets[1:-1]
    for base, part in _pieces(data, most):
        space = SPACE[part]
        first = ~space
        last = first.copy()
        own = cuts[(cuts > base) & (cuts < base + len(part))] - base
        start = first.copy()
        start[1:] &= space[:-1]
        start[own] |= first[own]
        last[:-1] &= space[1:]
        last[own - 1] |= first[own - 1]
        a, b = np.flatnonzero(start), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[part]] * _table("up", len(part)), out=total[1:])
        h = (total[b] - total[a]) * _table("down", len(part) + 1)[a]
        # A word that runs over the end of a row at a piece's end cannot be: pieces end at white space.
        hashes.append(mix(h ^ ((b - a).astype(np.uint64) << np.uint64(48))))
        places.append(a + base)
    h, at = np.concatenate(hashes), np.concatenate(places)
    rows = np.searchsorted(at, offsets, "left")
    return h, np.diff(rows)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text, sorted and distinct, as signed 64-bit values.

    Fewer than n words: the whole sequence is one; no words: none.
    """
    k = min(n, len(h))
    if not k:
        return np.zeros(0, np.int64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(BASE) + h[i : len(h) - k + 1 + i])
    out = np.sort(out.view(np.int64))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
