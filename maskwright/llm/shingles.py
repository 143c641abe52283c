"""Word-shingle sets of many texts at once, as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte of a word, and which bytes belong to words (letters, digits, beyond ASCII)."""
    rng = np.random.default_rng(20)
    word = np.zeros(256, dtype=bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64), word


#: Longest stretch for which powers are kept between calls (4 MB).
_KEPT = 1 << 18


def _fresh(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, dtype=np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@cache
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _fresh(_KEPT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2 ** 64."""
    return _usual() if n <= _KEPT else _fresh(n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts in order, and for each word its text's number."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8)
    random, word = _tables()
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = word[data]
    change = np.diff(inside)
    starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(random[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(ends, starts, side="right")


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of `width` words; a text of fewer words (but some) has one of all of them."""
    words, of = word_hashes(texts)
    rows = np.searchsorted(of, np.arange(len(texts) + 1))
    n = max(0, len(words) - width + 1)
    joint = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        joint = mix(joint * np.uint64(_ODD) + words[k : k + n])
    out = []
    for start, stop in zip(rows.tolist(), rows[1:].tolist()):
        if stop - start >= width:
            out.append(np.unique(joint[start : stop - width + 1]))
        elif stop > start:
            short = np.zeros(1, dtype=np.uint64)
            for w in words[start:stop]:
                short = mix(short * np.uint64(_ODD) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
