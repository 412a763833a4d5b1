"""Quality scores by Bradley-Terry pairwise ranking.

Of two labelled documents the good one is preferred to the bad one with a probability that is the logistic function of
the difference of their scores. Scores are linear in features of the text; their weights minimise the logistic loss on
the pairs' feature differences: counts of characters, words and lines, and hashed words and pairs of words, whose
weights are held down more strongly. A document is good if its score reaches a quantile of the labelled documents' scores,
the one that the share of bad ones asks for. The reported score is the logistic function of the distance to it.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, pretok, words
from codestrata.llm.textstats import Stats
from codestrata.llm.words import LOWER

#: Labelled rows that are learnt from at most: the fixed bound of what the driver gets.
SAMPLE = 20_000
PAIRS_PER_ROW, RIDGE, STEPS = 8, 1e-3, 25
#: Buckets of hashed words, and of hashed pairs of words; the scale that their weights' ridge makes them start from.
BUCKETS, LEXICAL_SCALE = 128, 0.1


def lexical(s: Stats) -> np.ndarray:
    """(texts, 2 * BUCKETS): words and pairs of neighbours by signed hash buckets, over the square root of their number."""
    code, first = s.codes(), s.first_words()
    raw = LOWER[s.words.raw].tobytes()
    own = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(s.words.starts[first].tolist(), s.words.ends[first].tolist(), strict=True)), np.uint64, len(first))
    word, of = pretok.mix(own + np.uint64(1))[code], s.of_word()
    out = np.zeros((s.n, 2 * BUCKETS))
    pair = np.flatnonzero(of[1:] == of[:-1])
    both = pretok.mix(word[pair] * np.uint64(0x9E3779B97F4A7C15) + word[pair + 1])
    for at, h, text in ((0, word, of), (BUCKETS, both, of[pair])):
        cell = text * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        out[:, at : at + BUCKETS] = np.bincount(cell, sign, s.n * BUCKETS).reshape(s.n, BUCKETS)
    return out / np.sqrt(np.maximum(s.n_words(), 1))[:, None]


def features(texts: list[str]) -> np.ndarray:
    """(texts, features) of whole texts, those of ``lexical`` last; finite for empty ones too."""
    s = Stats(texts)
    w, c, lines = np.maximum(s.n_words(), 1), np.maximum(s.n_chars(), 1), np.maximum(s.n_lines(), 1)
    letters = np.maximum(s.bytes_in(bytes(range(65, 91))) + s.bytes_in(bytes(range(97, 123))), 1)
    mean = s.word_chars() / w
    columns = [
        np.log1p(s.n_words()),
        (s.n_words() == 0).astype(float),
        np.minimum(s.n_words(), 40) / 40,
        mean,
        np.sqrt(np.maximum(s.squared_lengths() / w - mean**2, 0)),
        np.sqrt(s.n_symbols() / w),
        s.n_symbols() / c,
        s.bytes_in(bytes(range(65, 91))) / letters,
        np.sqrt(s.bytes_in(b"!") / w),
        np.sqrt(s.bytes_in(b"|") / w),
        np.sqrt(s.bytes_in(b"0123456789") / c),
        np.sqrt(s.bytes_in(b".") / w),
        np.sqrt(s.bytes_in(b",;:") / w),
        np.log1p(lines),
        np.log(w / lines),
        s.n_dup_lines() / lines,
        s.n_repeat_words() / w,
        s.n_distinct_words() / w,
        np.log1p(s.n_distinct_words()),
        np.sqrt(s.bytes_in(b"@/_=+()[]{}\\\"'") / w),
        s.bytes_in(bytes(range(128, 256))) / c,
    ]
    return np.concatenate([np.stack([np.asarray(x, np.float64) for x in columns], axis=1), lexical(s)], axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -40, 40)))


def pairs_of(good: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the preferred and of the other document of each pair."""
    random = np.random.default_rng(seed)
    n = PAIRS_PER_ROW * len(good)
    return random.choice(np.flatnonzero(good), n), random.choice(np.flatnonzero(~good), n)


def pairwise(z: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Weights of least logistic loss on the differences of rows, by Newton's method with conjugate gradients.

    Differences are never built: a pair adds to its two rows' coefficients, and those weigh the rows.
    """

    def spread(value: np.ndarray) -> np.ndarray:
        return (np.bincount(up, value, len(z)) - np.bincount(down, value, len(z))) @ z / len(up)

    def loss(w: np.ndarray, s: np.ndarray) -> float:
        return float(np.logaddexp(0, s[down] - s[up]).mean() + RIDGE / 2 * w @ w)

    w, s = np.zeros(z.shape[1]), np.zeros(len(z))
    for _ in range(STEPS):
        wrong = 1 / (1 + np.exp(np.clip(s[up] - s[down], -40, 40)))
        gradient = RIDGE * w - spread(wrong)
        if np.abs(gradient).max() < 1e-8:
            break
        curve = wrong * (1 - wrong)
        step, left = np.zeros(len(w)), -gradient
        toward, size = left, left @ left
        for _ in range(60):
            t = z @ toward
            bent = spread(curve * (t[up] - t[down])) + RIDGE * toward
            far = size / (toward @ bent)
            step, left = step + far * toward, left - far * bent
            new = left @ left
            if new < 1e-12 * (gradient @ gradient):
                break
            toward, size = left + new / size * toward, new
        rate, move, here = 1.0, z @ step, loss(w, s)
        while loss(w + rate * step, s + rate * move) > here and rate > 1e-4:
            rate /= 2
        w, s = w + rate * step, s + rate * move
    return w


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Model:
    """Weights learnt on pairs, and the threshold. Without labels of both kinds all scores are 0.5."""
    width = x.shape[1]
    if good.all() or not good.any():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    if width > 2 * BUCKETS:
        scale[-2 * BUCKETS :] /= LEXICAL_SCALE
    z = np.clip((x - mean) / scale, -6, 6)
    model = Model(mean, scale, pairwise(z, *pairs_of(good, seed)), 0.0)
    s = np.sort(model.raw(x))
    bad = int((~good).sum())
    return Model(mean, scale, model.weights, float((s[bad - 1] + s[bad]) / 2))


def held_out(id_: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@common.tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            x = features(common.texts(part.column("text")))
            yield pa.record_batch([part.column("id"), part.column("good"), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=["id", "good", "x"])


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """From at most ``sample`` labelled rows that are not held out, taken in the order of a hash of the id."""
    rows = common.pick(labels, id=id_col, good=label_col).where("id is not null and good is not null").where(~held_out(F.col("id")))
    rows = rows.select("id", (F.col("good") > 0).alias("good")).distinct().orderBy(F.xxhash64("id"), "id", "good").limit(sample)
    own = common.pick(documents, id=id_col, text=text_col).join(F.broadcast(rows), "id")  # the sample's bound
    kind = own.schema["id"].dataType.simpleString()
    found = own.select("id", "good", "text").mapInArrow(_features, f"id {kind}, good boolean, x binary").orderBy(F.xxhash64("id"), "good", "x").limit(sample).collect()
    x = np.frombuffer(b"".join(r.x for r in found), "<f4").reshape(len(found), -1 if found else 1).astype(np.float64)
    return fit(x if found else features([""]), np.array([r.good for r in found], bool) if found else np.ones(1, bool))


@common.tidy
def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            score = model.value.score(features(common.texts(part.column("text"))))
            yield pa.record_batch([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "score"])


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns and the score, from 0 to 1; null and empty texts are scored alike, repeated rows stay.

    The document's columns must not include score_col.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    if score_col in names:
        raise ValueError(f"a column is named {score_col}")
    inner = documents.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    out = inner.mapInArrow(functools.partial(_scored, model=shared), f"{schema}, score double")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), F.col("score").alias(score_col))


def contract(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(documents, labels)
    rows = score(common.pick(documents, doc_id="doc_id", text="text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
