"""Words and word shingles of whole lots of texts as 64-bit hashes, computed in numpy.

A word's hash is a polynomial of its bytes modulo 2**64: prefix sums over the
lot give all of them at once, without a table of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
LOT = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


# A-Z count as a-z; words end at \x20 and \x09-\x0D.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SIGN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_LOWER]
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(max(n, LOT + 64), base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def lots(texts: list[bytes | None], most: int = LOT) -> Iterator[tuple[int, list[bytes]]]:
    """Successive texts of about ``most`` bytes together, with the place of the first; a longer text is a lot."""
    first, lot, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if lot and size + len(t) > most:
            yield first, lot
            first, lot, size = i, [], 0
        lot.append(t)
        size += len(t) + 1
    if lot:
        yield first, lot


def word_hashes(lot: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more than texts)."""
    joined = np.frombuffer(b"\n" + b"\n".join(lot) + b"\n", np.uint8)
    blank = _BLANK[joined]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = powers(len(joined) + 1)
    sums = np.empty(len(joined) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_SIGN[joined] * up[: len(joined)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    text_starts = np.cumsum([1, *(len(t) + 1 for t in lot)])
    return hashes, np.searchsorted(starts, text_starts)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the shingle at each word of one text; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _STEP + hashes[i : n - k + 1 + i]
    return mix(out)


def shingle_lists(texts: list[bytes | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingles of each text in turn."""
    for _, lot in lots(texts):
        hashes, at = word_hashes(lot)
        for i in range(len(lot)):
            yield shingles(hashes[at[i] : at[i + 1]], size)
