"""Texts as arrays: characters, words and their hashes for many texts at once, in a few vector operations each."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Characters (with one separator a text) that are handled at once; a longer text is handled by itself.
CHUNK_CHARS = 500_000
GOLDEN, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LETTER, UPPER, DIGIT, SPACE, PUNCTUATION, SYMBOL = 1, 2, 4, 8, 16, 32


@functools.cache
def class_table() -> np.ndarray:
    """Bits of LETTER, UPPER, DIGIT, SPACE (ASCII), PUNCTUATION, SYMBOL for each code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            table[c] = LETTER | (UPPER if kind in ("Lu", "Lt") else 0)
        elif kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] == "P":
            table[c] = PUNCTUATION
        elif kind[0] == "S":
            table[c] = SYMBOL
    for c in "#*%&@\\/_":
        table[ord(c)] = SYMBOL
    for c in " \t\n\x0b\x0c\r":
        table[ord(c)] = SPACE
    return table


@functools.cache
def lower_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, PRIME)))) if n > 1 else np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(10, int(n - 1).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `chars` characters, at least one text each."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Texts:
    """Code points of texts, each followed by a line feed, and its words (runs without ASCII white space)."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.classes = class_table()[self.codes]
        space = self.classes == SPACE
        edge = np.diff(space.view(np.int8), prepend=1)
        #: first character of each word, and one past its last
        self.word_starts, self.word_ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.word_ends) and self.word_ends[0] == 0:
            self.word_ends = self.word_ends[1:]
        self.in_word = ~space
        #: text of each word, and each text's first word
        self.word_text = np.searchsorted(self.starts, self.word_starts, "right") - 1
        self.first_word = np.searchsorted(self.word_starts, np.concatenate((self.starts, [len(self.codes)])))

    def word_hashes(self, lower: bool = False, keep: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; of its characters of the classes `keep` only, where given (0 if it has none)."""
        if not len(self.word_starts):
            return np.zeros(0, np.uint64)
        codes = self.codes[self.in_word]
        if lower:
            codes = lower_table()[codes]
        lengths = self.word_ends - self.word_starts
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        if keep:
            kept = (self.classes[self.in_word] & keep) != 0
            before = np.concatenate(([0], np.cumsum(kept)))
            place = before[:-1] - np.repeat(before[first], lengths)
        else:
            place = np.arange(len(codes)) - np.repeat(first, lengths)
        with np.errstate(over="ignore"):
            value = (codes.astype(np.uint64) + np.uint64(1)) * GOLDEN
            value ^= value >> np.uint64(29)
            value *= powers(int(lengths.max()))[place]
            if keep:
                value[~kept] = 0
            total = np.add.reduceat(value, first)
            out = mix(total)
        return out

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, and the index of each one's first word."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.word_text[:n] == self.word_text[k - 1 :])
        total = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                total = total * PRIME + hashes[at + j]
            return mix(total), at
