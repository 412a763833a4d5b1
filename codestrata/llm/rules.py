"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a statistic of the whole text. On a sample, a rule's cost (seconds a byte) and its share
of rejections are estimated; rules then run in the order of rejection per cost, and a later rule sees only what the
former ones have left. A document is kept if no rule rejects it, whatever the order.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, words
from codestrata.llm.textstats import Stats

#: Documents that costs and selectivities are estimated on, at most.
SAMPLE = 2_000


@dataclass(frozen=True)
class Rule:
    """rejects(statistics) says which texts the rule rejects."""

    name: str
    rejects: Callable[[Stats], np.ndarray]


def _few_words(s: Stats) -> np.ndarray:
    return s.n_words() < 10


def _repeats(s: Stats) -> np.ndarray:
    return 100 * s.n_repeat_words() > 20 * s.n_words()


def _symbols(s: Stats) -> np.ndarray:
    return 10 * s.n_symbols() > 3 * s.n_words()


def _shouting(s: Stats) -> np.ndarray:
    upper, lower = s.bytes_in(bytes(range(65, 91))), s.bytes_in(bytes(range(97, 123)))
    return upper > 2 * lower


def _exclaims(s: Stats) -> np.ndarray:
    return 2 * s.bytes_in(b"!") > s.n_words()


def _word_size(s: Stats) -> np.ndarray:
    n, chars = s.n_words(), s.word_chars()
    return (chars < 2 * n) | (chars > 20 * n)


def _dup_lines(s: Stats) -> np.ndarray:
    return 2 * s.n_dup_lines() > s.n_lines()


#: The contract's base.
BASE = (Rule("few_words", _few_words), Rule("repeats", _repeats))
#: What the method adds.
RULES = (Rule("symbols", _symbols), Rule("shouting", _shouting), Rule("exclaims", _exclaims), Rule("word_size", _word_size), Rule("dup_lines", _dup_lines))


@common.tidy
def _measured(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            texts = common.texts(part.column("text"))
            base = Stats(texts)
            for k, rule in enumerate(rules):
                stats = base.take(np.ones(len(texts), bool))  # nothing worked out yet
                began = time.perf_counter()
                rejected = int(rule.rejects(stats).sum())
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([time.perf_counter() - began]), pa.array([rejected], pa.int64()), pa.array([len(texts)], pa.int64())], names=["rule", "seconds", "rejected", "n"])


def ordered(df: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of the rows, taken by a hash of their ids; ties stay as given."""
    rows = common.pick(df, id=id_col, text=text_col)
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    own = rows.join(F.broadcast(chosen), "id").select("text").limit(sample)  # the sample's bound
    found = own.mapInArrow(functools.partial(_measured, rules=rules), "rule int, seconds double, rejected long, n long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    worth = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in found}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0), k)))


def cascade(texts: list[str], rules: tuple[Rule, ...], stats: Stats | None = None, alive: np.ndarray | None = None) -> np.ndarray:
    """Of each text, the place of the rule that rejected it, or -1. alive: the texts to look at."""
    by = np.full(len(texts), -1)
    at = np.arange(len(texts))
    stats = stats or Stats(texts)
    left = np.ones(len(texts), bool) if alive is None else alive
    for k, rule in enumerate(rules):
        if not left.all():  # a rule works on what the former ones have left, and on nothing else
            at, stats = at[left], stats.take(left)
        if not len(at):
            break
        rejected = rule.rejects(stats)
        by[at[rejected]] = k
        left = ~rejected
    return by


@common.tidy
def _judged(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    names = pa.array([r.name for r in rules], pa.string())
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            by = cascade(common.texts(part.column("text")), rules)
            yield pa.record_batch([*part.columns, names.take(pa.array(by, mask=by < 0))], names=[*part.schema.names, "rejected_by"])


def judge(df: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, id_col: str = "doc_id", text_col: str = "text", rule_col: str = "rejected_by") -> DataFrame:
    """All columns and rule_col: a rule that rejects the row, null if none does.

    Which of several such rules it names depends on the order, and so on measured times; whether it is null does not.
    Null and empty texts have no words; repeated rows are judged alike. The columns must not include rule_col.
    """
    names = df.columns
    if rule_col in names:
        raise ValueError(f"a column is named {rule_col}")
    rules = ordered(df, rules, id_col, text_col)
    inner = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    out = inner.mapInArrow(functools.partial(_judged, rules=rules), f"{schema}, rejected_by string")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), F.col("rejected_by").alias(rule_col))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@common.tidy
def _metrics(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            texts = common.texts(part.column("text"))
            stats = Stats(texts)
            values = [np.asarray(getattr(stats, m)(), np.int64) for m in METRICS]
            n, repeated = values[0], values[4]
            failed = (n < 10) | (100 * repeated > 20 * n)
            kept = ~failed & (cascade(texts, rules, stats, ~failed) < 0)
            yield pa.record_batch([part.column("doc_id"), *map(pa.array, values), pa.array(failed), pa.array(kept)], names=["doc_id", *METRICS, "base_failed", "kept"])


def contract(documents: DataFrame) -> DataFrame:
    """The contract's columns: base metrics of every row, and the cascade's verdict on what the base leaves.

    The metrics are results, so they are worked out for every row whatever the verdict: the order of the rules spares
    only what they need besides. ``judge`` is the cascade that spares the metrics too.
    """
    rows = common.pick(documents, doc_id="doc_id", text="text")
    rules = ordered(rows, RULES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_metrics, rules=rules), f"doc_id {kind}, " + ", ".join(f"{m} long" for m in METRICS) + ", base_failed boolean, kept boolean")
