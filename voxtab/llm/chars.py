"""Vectorised letter words and character n-grams over whole texts.

Texts are lower-cased and laid end to end as code points; everything that is not
a word character becomes one boundary mark, so the n-grams of a word are the
windows of its letters with a mark on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from voxtab.llm.words import _P, _P_INV, U, mix


@cache
def word_characters(digits: bool) -> np.ndarray:
    """Whether a code point is a letter (or a digit)."""
    return np.array([chr(i).isalnum() if digits else chr(i).isalpha() for i in range(0x110000)])


class CharBlock:
    """Words and n-gram hashes of the texts lo..hi."""

    def __init__(self, texts: list[str | None], lo: int, hi: int, digits: bool):
        self.lo, self.hi = lo, hi
        part = [(t or "").lower() for t in texts[lo:hi]]
        cp = np.frombuffer((" " + " ".join(part) + " ").encode("utf-32-le", "replace"), np.uint32)
        size = np.array([len(t) + 1 for t in part], np.int64)
        begin = 1 + np.concatenate([[0], np.cumsum(size)])
        table = word_characters(digits)
        solid = table[cp]
        edge = np.diff(solid.view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.first = np.searchsorted(self.start, begin)
        self.doc = np.repeat(np.arange(hi - lo), np.diff(self.first))
        code = np.where(solid, mix(cp.astype(np.uint64) + U(0x51)), U(0x20))
        power = np.full(len(cp) + 1, _P, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(code * power[:-1], out=self.sums[1:])
        self.inverse = np.full(len(cp) + 1, _P_INV, np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def word_hashes(self) -> np.ndarray:
        """One hash per word."""
        return mix((self.sums[self.end] - self.sums[self.start]) * self.inverse[self.start] + U(1))

    def ngrams(self, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every n-character window of the chosen words with their two marks."""
        words = np.arange(len(self.start)) if words is None else words
        count = np.maximum(self.end[words] - self.start[words] + 3 - n, 0)
        word = np.repeat(words, count)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        at = self.start[word] - 1 + nth
        return word, mix((self.sums[at + n] - self.sums[at]) * self.inverse[at] + U(n << 8))


def char_blocks(texts: list[str | None], digits: bool = False, block_chars: int = 1 << 17) -> Iterator[CharBlock]:
    """Blocks of whole texts of about block_chars characters, one text at least."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t or "") > block_chars:
            yield CharBlock(texts, lo, i, digits)
            lo, held = i, 0
        held += len(t or "")
    if lo < len(texts):
        yield CharBlock(texts, lo, len(texts), digits)
