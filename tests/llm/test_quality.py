"""Quality scores on held-out labels, text statistics and the rule cascade against plain readings."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import quality, rules
from codestrata.llm.textstats import Stats
from tests.llm import util

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_metrics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_kept(text):
    text = text or ""
    n, chars, symbols, dup, repeated = plain_metrics(text)
    failed = n < 10 or 100 * repeated > 20 * n
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    return failed, not (failed or 10 * symbols > 3 * n or upper > 2 * lower or 2 * text.count("!") > n or chars < 2 * n or chars > 20 * n or 2 * dup > lines)


def random_texts(seed, n=300):
    random.seed(seed)
    bits = ["a", "bc", "def", "é中", "#$", "!", "A", "\n", " ", "\t", "\x0b", "\x1c", " ", "one two three four five six\n", "|", "x" * 30]
    return ["".join(random.choice(bits) + random.choice(["", " ", " ", "\n"]) for _ in range(random.choice([0, 1, 8, 40]))) for _ in range(n)]


def test_statistics_of_any_texts():
    texts = random_texts(1) + ["", "\n", "\n\n a", "a\na\n a\n", "no end\n"]
    s = Stats(texts)
    got = list(zip(*(getattr(s, m)().tolist() for m in rules.METRICS), strict=True))
    assert got == [plain_metrics(t) for t in texts]
    assert s.n_lines().tolist() == [sum(bool(WORD.search(x)) for x in t.split("\n")) for t in texts]
    assert s.n_distinct_words().tolist() == [len(set(WORD.findall(t))) for t in texts]
    assert Stats([]).n_words().tolist() == [] and Stats([""]).n_repeat_words().tolist() == [0]


def test_rules_contract(spark, sf):
    rows = list(util.texts(spark, sf).items()) + [(10_000 + k, t) for k, t in enumerate(random_texts(2))]
    got = rules.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain_metrics(t), *plain_kept(t)) for i, t in rows)


def test_awkward_rows(spark):
    got = rules.contract(util.awkward(spark)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *plain_metrics(t), *plain_kept(t))) for i, t, _ in util.AWKWARD)
    assert rules.contract(util.empty(spark)).count() == 0
    judged = rules.judge(util.awkward(spark))
    assert judged.columns == [*util.awkward(spark).columns, "rejected_by"] and judged.count() == len(util.AWKWARD)


def test_order_changes_no_verdict():
    texts = random_texts(3)
    every = rules.BASE + rules.RULES
    kept = rules.cascade(texts, every) < 0
    for seed in range(5):
        shuffled = list(every)
        random.Random(seed).shuffle(shuffled)
        assert ((rules.cascade(texts, tuple(shuffled)) < 0) == kept).all()


def _slow(s):
    import time

    time.sleep(0.02)
    return np.ones(s.n, bool)


def _quick(s):
    return np.ones(s.n, bool)


def _never(s):
    return np.zeros(s.n, bool)


def test_rules_go_by_rejection_per_cost(spark, sf):
    given = (rules.Rule("never", _never), rules.Rule("slow", _slow), rules.Rule("quick", _quick))
    got = rules.ordered(spark.read.parquet(f"{sf}/documents.parquet"), given, sample=100)
    assert [r.name for r in got] == ["quick", "slow", "never"]
    assert [r.name for r in rules.ordered(util.empty(spark), given)] == ["never", "slow", "quick"]


def test_later_rules_see_only_what_is_left():
    seen = []

    def first(s):
        return s.n_words() < 5

    def second(s):
        seen.append(s.n)
        return np.zeros(s.n, bool)

    rules.cascade(["a b c d e f", "a", "b", "c"], (rules.Rule("first", first), rules.Rule("second", second)))
    assert seen == [1]


def test_held_out_accuracy(spark, sf):
    root = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    got = quality.contract(spark.read.parquet(f"{root}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    own = [r for r in got if r.held_out]
    assert len(own) > 80 and np.mean([r.predicted == r.quality for r in own]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_change_nothing(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn(documents, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_scores_of_awkward_rows_and_of_no_labels(spark):
    rows = util.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.contract(rows, none).collect()
    assert len(got) == len(util.AWKWARD) and {r.score for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    some = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (8, None), (6, 0)], "doc_id long, quality int")
    assert quality.contract(rows, some).count() == len(util.AWKWARD)
    assert quality.contract(util.empty(spark), some).count() == 0


def test_pairwise_ranking_orders_by_the_preferred_feature():
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(400, 3))
    good = x[:, 1] + 0.1 * random_.normal(size=400) > 0.5
    model = quality.fit(x, good)
    assert abs(model.weights[1]) > 5 * np.abs(model.weights[[0, 2]]).max()
    assert ((model.score(x) >= 0.5) == good).mean() > 0.95
    assert (model.score(x) >= 0.5).sum() == good.sum()  # the threshold is that quantile


def test_weights_are_those_of_an_independent_descent():
    random_ = np.random.default_rng(2)
    z, good = np.clip(random_.normal(size=(120, 5)), -6, 6), random_.random(120) < 0.4
    up, down = quality.pairs_of(good, 3)
    assert good[up].all() and not good[down].any()
    w = np.zeros(5)
    for _ in range(20_000):  # plain gradient descent on the differences themselves
        d = z[up] - z[down]
        w -= 0.3 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + quality.RIDGE * w)
    assert np.allclose(quality.pairwise(z, up, down), w, atol=1e-5)


def plain_features(text):
    """The features by counting in plain Python."""
    words = WORD.findall(text)
    n, chars, symbols, dup, repeated = plain_metrics(text)
    lines = max(sum(bool(WORD.search(x)) for x in text.split("\n")), 1)
    w, c = max(n, 1), max(len(text), 1)
    sizes = [len(x.encode()) for x in words]
    among = lambda some: sum(b in some for b in text.encode())
    upper, lower = among(range(65, 91)), among(range(97, 123))
    mean = chars / w
    dense = [np.log1p(n), float(n == 0), min(n, 40) / 40, mean, np.sqrt(max(sum(x * x for x in sizes) / w - mean**2, 0)), np.sqrt(symbols / w), symbols / c]
    dense += [upper / max(upper + lower, 1), *(np.sqrt(among(x) / w) for x in (b"!", b"|")), np.sqrt(among(b"0123456789") / c), *(np.sqrt(among(x) / w) for x in (b".", b",;:"))]
    dense += [np.log1p(lines), np.log(w / lines), dup / lines, repeated / w, len(set(words)) / w, np.log1p(len(set(words)))]
    return [*dense, np.sqrt(among(b"@/_=+()[]{}\\\"'") / w), among(range(128, 256)) / c]


def test_features_are_the_plain_counts():
    texts = random_texts(11, 80) + [t or "" for _, t, _ in util.AWKWARD]
    got = quality.features(texts)
    assert np.allclose(got[:, : -2 * quality.BUCKETS], np.array([plain_features(t) for t in texts]))
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(got, alone) and np.isfinite(got).all()
    low = [quality.features([t])[:, -2 * quality.BUCKETS :] for t in ("a b a", "A B A", "b a a")]
    assert np.allclose(low[0], low[1]) and np.allclose(low[0][:, : quality.BUCKETS], low[2][:, : quality.BUCKETS])
    assert not np.allclose(low[0], low[2])  # pairs of words tell the order


def test_words_alone_can_tell_the_labels():
    random.seed(12)
    good = np.arange(300) % 2 == 0
    pick = lambda own: " ".join(random.choice(own) for _ in range(30))
    texts = [pick(["lake", "tree", "bird", "moon"]) if g else pick(["cash", "prix", "sale", "shop"]) for g in good]
    model = quality.fit(quality.features(texts[:200]), good[:200])
    assert ((model.score(quality.features(texts[200:])) >= 0.5) == good[200:]).mean() > 0.97


def test_a_clashing_score_column_is_an_error(spark):
    model = quality.fit(quality.features([""]), np.ones(1, bool))
    with pytest.raises(ValueError):
        quality.score(spark.createDataFrame([("a", 1.0)], "text string, score double"), model)


def test_every_rule_sees_only_what_is_left():
    seen = []

    def counting(bad):
        def rejects(s):
            seen.append(s.n)
            return s.n_words() == bad
        return rejects

    texts = ["a b", "a", "", "é b c", "a b c", "d e f", "x\ny z", "w w w"]
    by = rules.cascade(texts, tuple(rules.Rule(str(k), counting(k)) for k in range(4)))
    assert seen == [8, 7, 6, 5] and by.tolist() == [2, 1, 0, 3, 3, 3, 3, 3]


def test_statistics_of_a_part_are_those_of_its_texts():
    texts = random_texts(5)
    keep = np.arange(len(texts)) % 3 != 1
    for hashed in (False, True):
        whole = Stats(texts)
        if hashed:
            whole.codes()
        part, alone = whole.take(keep), Stats([t for t, k in zip(texts, keep, strict=True) if k])
        for name in (*rules.METRICS, "n_lines", "n_chars", "n_distinct_words", "squared_lengths"):
            assert (getattr(part, name)() == getattr(alone, name)()).all()
    assert whole.take(np.zeros(len(texts), bool)).n == 0
