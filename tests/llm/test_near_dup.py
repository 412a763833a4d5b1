"""Near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from codestrata.llm import near_dup, words
from tests.llm import util

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=4, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return [(i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True)]


def copies(seed, groups=6, size=25):
    """Groups of copies with a word changed here and there, so that similarities lie on both sides of the threshold."""
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = [random.choice(vocabulary) for _ in range(random.choice([3, 4, 6, 30, 120]))]
        for _ in range(size):
            own = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 4, 8])):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed, block, shingles, pivots", [(1, 1024, 2_000_000, 16), (2, 4, 2_000_000, 2), (3, 1024, 300, 16), (4, 3, 2_000_000, 0)])
def test_components_are_those_of_all_pairs(spark, seed, block, shingles, pivots):
    rows = copies(seed)
    got = near_dup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), p=near_dup.Params(shingle=4, block=block, block_shingles=shingles, pivots=pivots)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_documents(spark, sf):
    rows = list(util.texts(spark, sf).items())
    got = near_dup.contract(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_awkward_rows(spark):
    got = near_dup.clusters(util.awkward(spark), p=near_dup.CONTRACT).collect()
    assert len(got) == len(util.AWKWARD)
    by = {r.id: r for r in got}
    assert [by[k].n_shingles for k in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[8].component == 4 and not by[8].kept and by[1].kept and by[2].component == 2
    assert by[None].component is None and not by[None].kept
    assert near_dup.clusters(util.empty(spark)).count() == 0


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(60)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.key): bytes(r.root) for r in near_dup.components(links).collect()}
    assert got == {bytes([k]): b"\x00" for k in range(61)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_registers_hold_zeros_and_mantissa_of_the_least():
    p = near_dup.Params(bands=1, rows=2)
    half = 1 << 63
    hashes = np.array([half // 4, half - 1, half + (half >> 9) + 5], np.uint64)  # two in the first bucket
    regs = near_dup.registers(hashes, np.array([0, 3, 3]), p)[:2]
    assert regs[0].tolist() == [2 << 10, 9 << 10] and regs[1].tolist() == [near_dup.EMPTY] * 2


def test_estimate_is_near_the_similarity():
    random.seed(3)
    p = near_dup.Params()
    for percent in (50, 80, 95):
        n = 4000
        both = np.array(random.sample(range(1 << 62), n), np.uint64) * np.uint64(4)
        cut = int(n * (100 - percent) / 200)
        a, b = np.sort(both[cut:]), np.sort(both[: n - cut])
        regs = near_dup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), p)
        assert abs((regs[0] == regs[1]).mean() - percent / 100) < 0.13
    assert near_dup.may_link(regs[0], regs[1:], p).all()


def test_sets_are_those_of_plain_words():
    texts = [t for _, t, _ in util.AWKWARD]
    high, low, offsets = words.sets([t or "" for t in texts], 4)
    numbers, edges = words.codes([t or "" for t in texts], 4)
    expected = [shingles(t, 4) for t in texts]
    assert np.diff(offsets).tolist() == np.diff(edges).tolist() == [len(x) for x in expected]
    alone = [words.sets([t or ""], 4)[:2] for t in texts]  # hashes don't depend on what else is in the batch
    assert (np.concatenate([a for a, _ in alone]) == high).all() and (np.concatenate([b for _, b in alone]) == low).all()
    for own in (list(zip(high.tolist(), low.tolist(), strict=True)), numbers.tolist()):
        found = [set(own[s:e]) for s, e in zip(offsets, offsets[1:], strict=False)]
        for i, a in enumerate(expected):
            assert [len(found[i] & b) for b in found] == [len(a & b) for b in expected]


def test_words_that_polynomial_hashes_confuse_are_told_apart(spark):
    got = {r.id: r for r in near_dup.clusters(util.awkward(spark), p=near_dup.CONTRACT).collect()}
    assert all(got[k].component == k and got[k].kept for k in range(9, 15))


def test_ranges_with_equal_hashes_are_told_apart(monkeypatch):
    from codestrata.llm import pretok

    random.seed(8)
    for modulus in (1, 2, 7):
        monkeypatch.setattr(pretok, "range_hashes", lambda v, s, e, m=modulus: (np.add.reduceat(v, s) % m).astype(np.uint64))
        for _ in range(50):
            ranges = [[random.randint(0, 2) for _ in range(random.randint(1, 4))] for _ in range(random.randint(1, 30))]
            ends = np.cumsum([len(r) for r in ranges])
            code, first = pretok.distinct(np.array([x for r in ranges for x in r], np.uint8), np.concatenate([[0], ends[:-1]]), ends)
            assert [[a == b for b in ranges] for a in ranges] == (code[:, None] == code).tolist()
            assert (code[first] == np.arange(len(first))).all()
