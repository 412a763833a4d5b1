"""Vectorised pre-tokenisation for byte-level BPE vocabularies.

``split`` finds, with numpy over the code points of many texts at once, the matches of the fixed byte-level
pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. The pattern's
alternatives depend only on the class of each character (letter, number, space, other), so a match begins where the
class changes, with three corrections: one plain space joins the run after it, the last space of a run that precedes
other text stands for itself, and a lone apostrophe takes the contraction that follows. Texts with code points that
this Python's Unicode tables do not assign go through the ``regex`` module instead.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 4, 5
#: Code points with the Unicode property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed value: the pattern, as the public tokenizers give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters handled at once; bounds the arrays of a task.
BATCH_CHARS = 1_000_000
_CUT = re.compile("[^{0}](?=[{0}])".format("".join(map(chr, WHITE))))


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "C": OTHER}
    table = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for non-empty ranges in ascending order."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each range, first range of each code) for ranges as in range_hashes: equal values share a code, no others.

    Hashes only propose what is equal. Each range is compared with the first of its code, value by value; codes whose
    ranges differ are dealt anew by the values themselves.
    """
    codes, unique = pd.factorize(range_hashes(values, starts, ends)) if len(starts) else (np.zeros(0, np.int64), starts)
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    of, sizes = first[codes], ends - starts
    odd = sizes != sizes[of]
    again = np.flatnonzero((of != np.arange(len(of))) & ~odd)
    for begin, end in batches(sizes[again].tolist()):
        some = again[begin:end]
        size = sizes[some]
        differs = values[ragged(starts[some], size)] != values[ragged(starts[of[some]], size)]
        if differs.any():
            odd[np.repeat(some, size)[differs]] = True
    if odd.any():
        known: dict[bytes, int] = {}
        added: list[int] = []
        for k in np.flatnonzero(np.isin(codes, codes[odd])).tolist():
            key = values[starts[k] : ends[k]].tobytes()
            if key not in known:
                own = first[codes[k]] == k
                known[key] = int(codes[k]) if own else len(first) + len(added)
                added += [] if own else [k]
            codes[k] = known[key]
        first = np.concatenate([first, np.array(added, np.int64)])
    return codes, first


class Words:
    """The pre-tokens of several texts: word k is big[starts[k]:ends[k]]; text i has words[offsets[i]:offsets[i+1]]."""

    def __init__(self, big: str, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, codes: np.ndarray):
        self.big, self.starts, self.ends, self.offsets, self._codes = big, starts, ends, offsets, codes

    def distinct(self) -> tuple[np.ndarray, list[str]]:
        """(code of each word, the distinct words)."""
        codes, first = distinct(self._codes, self.starts, self.ends)
        big = self.big
        return codes, [big[s:e] for s, e in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)]


def split(texts: list[str]) -> Words:
    """Matches of PATTERN in each text, in order. Empty texts have none."""
    big = "".join(texts)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    codes, n = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32), len(big)
    if not n:
        return Words(big, bounds[:0], bounds[:0], np.zeros(len(texts) + 1, np.int64), codes)
    kind = _classes()[codes]
    first = np.zeros(n + 4, bool)  # a text begins or all texts have ended
    first[bounds], first[n:] = True, True
    run = first[: n + 1].copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = run[:n].copy()
    solid = np.flatnonzero(start & ~space)
    solid = solid[~first[solid]]
    solid = solid[space[solid - 1]]
    start[solid - 1] = True
    start[solid[codes[solid - 1] == 32]] = False

    lone = np.flatnonzero(codes == 39)
    lone = lone[start[lone] & run[lone + 1] & ~first[lone + 1]]
    if len(lone):
        pad = np.concatenate([codes, np.zeros(4, np.uint32)])
        a, b = pad[lone + 1], np.where(first[lone + 2], 0, pad[lone + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, size in ((one, 2), (two, 3)):
            at = lone[which]
            start[at + 1] = False
            after = at + size
            after = after[~first[after]]
            start[after] = True

    if (odd := np.flatnonzero(kind == UNKNOWN)).size:
        import regex

        for i in np.unique(np.searchsorted(bounds, odd, "right") - 1):
            s, e = int(bounds[i]), int(bounds[i + 1])
            start[s:e] = False
            start[[s + m.start() for m in regex.finditer(PATTERN, big[s:e])]] = True
    starts = np.flatnonzero(start)
    return Words(big, starts, np.append(starts[1:], n), np.searchsorted(starts, bounds), codes)


def cut(text: str, limit: int = BATCH_CHARS) -> Iterator[str]:
    """The text in pieces of about limit characters, cut only where a non-space precedes a space.

    No match of PATTERN reaches over such a place and none depends on what is beyond it, so the pieces' matches are
    the text's. Text without such places stays whole.
    """
    at = 0
    while len(text) - at > limit and (found := _CUT.search(text, at + limit)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def batches(sizes: Iterator[int] | list[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of up to about limit in total, an item at least."""
    begin = total = end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield begin, end
            begin, total = end, 0
    if end > begin:
        yield begin, end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges starts[k] .. starts[k]+lengths[k], one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class WordIds:
    """Ids of words, encoded once each while they are kept; the store starts anew beyond ``cap`` words or ``cap_chars`` characters."""

    def __init__(self, encode: Callable[[str], list[int]], cap: int = 400_000, cap_chars: int = 16_000_000):
        self.encode, self.cap, self.cap_chars = encode, cap, cap_chars
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.pool, self.used, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0

    def look_up(self, words: Words) -> np.ndarray:
        """Positions in starts and sizes, one for each word."""
        if len(self.place) > self.cap or self.chars > self.cap_chars:
            self._clear()
        codes, unique = words.distinct()
        place, known = self.place, len(self.place)
        out = np.fromiter((place.get(w, -1) for w in unique), np.int64, len(unique))
        if (at := np.flatnonzero(out < 0)).size:
            new, encode = [unique[k] for k in at.tolist()], self.encode
            ids = [encode(w) for w in new]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
            for name, need in (("starts", known + len(new)), ("sizes", known + len(new)), ("pool", self.used + len(flat))):
                have = getattr(self, name)
                if len(have) < need:
                    setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))
            self.pool[self.used : self.used + len(flat)] = flat
            self.starts[known : known + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[known : known + len(new)] = sizes
            self.used += len(flat)
            self.chars += sum(map(len, new))
            place.update(zip(new, range(known, known + len(new)), strict=True))
            out[at] = np.arange(known, known + len(new))
        return out[codes]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and where each text's begin (one more than texts)."""
        words = split(texts)
        at = self.look_up(words)
        sizes = self.sizes[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[ragged(self.starts[at], sizes)], before[words.offsets]
