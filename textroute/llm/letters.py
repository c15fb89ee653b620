"""Texts as arrays of folded characters: lower-case letters and digits, with one blank between runs."""
from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def _kept(digits: bool) -> np.ndarray:
    """Whether each character is a letter (or a digit)."""
    test = str.isalnum if digits else str.isalpha
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


def folded(text: str | None, digits: bool = False) -> np.ndarray:
    """Code points of the lower-cased text; everything but letters (and digits) is a blank, runs of it one, and one
    blank stands at either end. A text without a letter is a single blank."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_kept(digits)[codes], codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each run of `n` code points."""
    if len(codes) < n:
        return np.zeros(0, np.uint32)
    h = np.zeros(len(codes) - n + 1, np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) + codes[i:len(codes) - n + 1 + i]
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x85EBCA6B + 2 * n)
    return h ^ (h >> np.uint32(13))
