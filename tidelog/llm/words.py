"""Word hashes of many texts at once, made over their bytes with numpy."""

from __future__ import annotations

import numpy as np

from tidelog.llm.common import cache, mix

#: An odd multiplier and its inverse modulo 2^64, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_POWERS: dict[int, np.ndarray] = {}
cache(_POWERS.clear)
#: Most powers of a base that a worker keeps.
KEPT = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers of a base, from 0 on."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = np.cumprod(steps, dtype=np.uint64)
        if len(held) <= KEPT:
            _POWERS[base] = held
    return held


def mask(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: those in none of the ranges."""
    m = np.ones(256, bool)
    for lo, hi in separators:
        m[lo : hi + 1] = False
    return m


class Words:
    """Words of a list of texts: hash, doc (index into the list) and length in bytes of each.

    A-Z are lower-cased.  Byte 0x20 must be a separator; texts are joined by it."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        data = b" ".join(texts).translate(LOWER)
        a = np.frombuffer(data, np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        inside = np.concatenate([[False], is_word[a], [False]])
        flips = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = flips[::2], flips[1::2]
        n = len(a)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[a] * powers(BASE, n)[:n], out=sums[1:])
        self.length = ends - starts
        self.hash = mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + self.length.astype(np.uint64)) if n else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(ends_of, starts, "right")
        self.per_doc = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k hashes in a row; position i holds that of i to i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(BASE)
        out += h[j : j + n]
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of w values in a row, by doubling."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def portions(texts: list[bytes], most: int = 1 << 18):
    """(lo, hi) of portions of about `most` bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
