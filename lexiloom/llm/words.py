"""Words and n-grams of whole texts as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile("[a-zà-öø-ÿ0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Longest runs of a-z, à-ö, ø-ÿ or 0-9 in the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def spans(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The words and where each lies in the lower-cased text."""
    found = [(m.group(), m.span()) for m in WORD.finditer(text.lower())] if text else []
    return [w for w, _ in found], [s for _, s in found]


class Hashes(dict):
    """The 64-bit hash of each word, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Rolling polynomial hash of every n consecutive codes."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = codes[: len(codes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = out * _BASE + codes[j : len(codes) - n + 1 + j]
    return out
