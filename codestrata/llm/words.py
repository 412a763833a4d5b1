"""Words of many texts at once, in numpy: runs of bytes other than space and 0x09 to 0x0D."""

from __future__ import annotations

import hashlib

import numpy as np

from codestrata.llm import pretok

#: The bytes between words.
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once.
BATCH_BYTES = 1_000_000


class Words:
    """Words of texts: word k is raw[starts[k]:ends[k]]; text i has bytes bounds[i]:bounds[i+1], words offsets[i]:offsets[i+1]."""

    def __init__(self, texts: list[str]):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b"".join(encoded), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))]).astype(np.int64)
        n = len(self.raw)
        gap = np.ones(n + 2, bool)  # one before and one after
        gap[1:-1] = GAPS[self.raw]
        begins = np.zeros(n + 1, bool)
        begins[self.bounds] = True
        solid = ~gap[1:-1]
        self.starts = np.flatnonzero(solid & (gap[:-2] | begins[:n]))
        self.ends = np.flatnonzero(solid & (gap[2:] | begins[1:])) + 1
        self.offsets = np.searchsorted(self.starts, self.bounds)

    def take(self, keep: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words of the texts that keep says, and which words those are; nothing is read again."""
        sizes, counts = np.diff(self.bounds), np.diff(self.offsets)
        own = np.repeat(keep, counts)
        out = Words.__new__(Words)
        out.raw = self.raw[np.repeat(keep, sizes)]
        out.bounds = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int64)
        out.offsets = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int64)
        shift = np.repeat(out.bounds[:-1] - self.bounds[:-1][keep], counts[keep])
        out.starts, out.ends = self.starts[own] + shift, self.ends[own] + shift
        return out, own

    def distinct(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, first word of each code), with A-Z lower-cased or as it is."""
        return pretok.distinct(LOWER[self.raw] if lower else self.raw, self.starts, self.ends)

    def windows(self, n: int, whole_if_fewer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words of n in a row, ends, offsets by text). A text of fewer words is one window or none."""
        count = np.diff(self.offsets)
        many = np.maximum(count - n + 1, 0)
        if whole_if_fewer:
            many = np.where((count > 0) & (count < n), 1, many)
        starts = pretok.ragged(self.offsets[:-1], many)
        ends = np.minimum(starts + n, np.repeat(self.offsets[1:], many))
        return starts, ends, np.concatenate([[0], np.cumsum(many)])


def codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct n-word shingles (A-Z lower-cased) of each text, ascending, and offsets by text.

    Two shingles have the same number if and only if they are the same words; numbers hold for these texts alone.
    """
    words = Words(texts)
    starts, ends, offsets = words.windows(n, whole_if_fewer=True)
    own, _ = pretok.distinct(words.distinct(lower=True)[0], starts, ends)
    top = int(own.max(initial=0)) + 1
    both = np.unique(np.repeat(np.arange(len(texts)), np.diff(offsets)) * top + own)
    return both % top, np.searchsorted(both, np.arange(len(texts) + 1) * top)


def sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hashes (two numbers) of the distinct n-word shingles of each text, ascending, and offsets by text.

    A shingle's hash mixes the BLAKE2 digests of its words, each digest taken once a batch.
    """
    words = Words(texts)
    code, first = words.distinct(lower=True)
    raw = LOWER[words.raw].tobytes()
    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)), np.uint64).reshape(-1, 2)
    starts, ends, offsets = words.windows(n, whole_if_fewer=True)
    size = ends - starts
    high, low = size.astype(np.uint64), ~size.astype(np.uint64)
    for k in range(n):
        inside = slice(None) if (size > k).all() else np.flatnonzero(size > k)
        own = digests[code[starts[inside] + k]]
        a, b = high[inside], low[inside]
        a, b = (a ^ own[:, 0]) * np.uint64(0x9E3779B97F4A7C15) + b, (b ^ own[:, 1]) * np.uint64(0xD6E8FEB86659FD93) + a
        high[inside], low[inside] = pretok.mix(a), pretok.mix(b)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        order = np.argsort(high[s:e])
        high[s:e], low[s:e] = high[s:e][order], low[s:e][order]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    same = np.concatenate([[False], (high[1:] == high[:-1]) & (text[1:] == text[:-1])])[: len(high)]
    if (same[1:] & (low[1:] != low[:-1])).any():
        order = np.lexsort((low, high, text))
        high, low = high[order], low[order]
    keep = ~same
    keep[1:] |= low[1:] != low[:-1]
    return high[keep], low[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
