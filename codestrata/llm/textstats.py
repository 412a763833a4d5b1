"""Statistics of many texts at once, on whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd

from codestrata.llm import pretok
from codestrata.llm.words import Words

#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Fixed value: words of a window whose repetition counts.
WINDOW = 5


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text, how many of its elements hold."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(mask, bounds[full], dtype=np.int64)
    return out


def _within(codes: np.ndarray, of: np.ndarray) -> pd.Series:
    """Numbers that equal codes of the same text share, and no others."""
    return pd.Series(of * (int(codes.max(initial=0)) + 1) + codes)


class Stats:
    """Each method gives a number for each text. What several need is worked out once."""

    def __init__(self, texts: list[str]):
        self.words = Words(texts)
        self.n = len(texts)
        self._codes: np.ndarray | None = None
        self._first: np.ndarray | None = None

    def take(self, keep: np.ndarray) -> Stats:
        """Of the texts that keep says, with what is worked out already."""
        out = Stats.__new__(Stats)
        out.words, own = self.words.take(keep)
        out.n = len(out.words.bounds) - 1
        out._codes, out._first = None if self._codes is None else self._codes[own], None
        return out

    def codes(self) -> np.ndarray:
        """A number for each word, the same for equal words."""
        if self._codes is None:
            self._codes, self._first = self.words.distinct()
        return self._codes

    def first_words(self) -> np.ndarray:
        """A word of each number."""
        if self._first is None:
            self._codes, self._first = self.words.distinct()
        return self._first

    def n_words(self) -> np.ndarray:
        return np.diff(self.words.offsets)

    def of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words())

    def bytes_in(self, chosen: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chosen)] = True
        return _sums(table[self.words.raw], self.words.bounds)

    def n_chars(self) -> np.ndarray:
        return _sums((self.words.raw & 0xC0) != 0x80, self.words.bounds)

    def word_chars(self) -> np.ndarray:
        """Code points in words: all but the gaps, which are one byte each."""
        return self.n_chars() - self.bytes_in(b" \t\n\v\f\r")

    def n_symbols(self) -> np.ndarray:
        return self.bytes_in(SYMBOLS)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text) of the lines that have a word."""
        raw, bounds = self.words.raw, self.words.bounds
        full = np.flatnonzero(np.diff(bounds))
        breaks = np.flatnonzero(raw == 10)
        starts = np.unique(np.concatenate([bounds[:-1][full], breaks + 1]))
        starts = starts[starts < len(raw)]
        if not len(starts):
            return starts, starts, starts
        ends = np.append(starts[1:], len(raw))
        ends = ends - (raw[ends - 1] == 10)
        of = np.searchsorted(bounds, starts, "right") - 1
        has = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.starts, starts)
        return starts[has], ends[has], of[has]

    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines()[2], minlength=self.n)

    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        starts, ends, of = self.lines()
        if not len(starts):
            return np.zeros(self.n, np.int64)
        again = _within(pretok.distinct(self.words.raw, starts, ends)[0], of).duplicated().to_numpy()
        return np.bincount(of[again], minlength=self.n)

    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of five words that the text has twice or more; a word counts once."""
        starts, ends, offsets = self.words.windows(WINDOW, whole_if_fewer=False)
        of = np.repeat(np.arange(self.n), np.diff(offsets))
        again = starts[_within(pretok.distinct(self.codes(), starts, ends)[0], of).duplicated(keep=False).to_numpy()]
        edge = np.zeros(len(self.words.starts) + 1, np.int64)
        edge[again] += 1
        np.add.at(edge, again + WINDOW, -1)
        return _sums(np.cumsum(edge)[:-1] > 0, self.words.offsets)

    def n_distinct_words(self) -> np.ndarray:
        of = self.of_word()
        return np.bincount(of[~_within(self.codes(), of).duplicated().to_numpy()], minlength=self.n)

    def squared_lengths(self) -> np.ndarray:
        """Sum of the words' squared lengths in bytes."""
        size = self.words.ends - self.words.starts
        return np.bincount(self.of_word(), size * size, self.n)
