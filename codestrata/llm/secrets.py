"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every historical version of a file is a blob, named by the SHA-256 of its content. The ledger has the pairs of blob and
rule version that were scanned, and the findings. An update scans one copy of each blob, for the rule versions the
ledger has no pair for, and adds to both tables; a report joins findings back to all paths that hold the blob. A new
version of one rule scans all blobs for that rule alone.

Spans come from splitting: the lengths of the pieces between matches and of the matches, summed up in order, give each
match's place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm import common

FINDINGS = "blob string, kind string, version int, start int, end int"
SEEN = "blob string, kind string, version int"
#: Findings (some 150 bytes each) that are broadcast to the texts, at most; with more of them both sides are shuffled.
BROADCAST_FINDINGS = 500_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java regular expression, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: In the order in which kinds with the same start are listed. A run of 24 hex digits is found as a run of at least 24,
#: and likewise for access keys: both patterns match whole runs only, so the same matches remain.
RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, start, end) of rows (blob, text, kinds): each kind's matches, leftmost and not overlapping.

    kinds lists what to look for in the row. Positions are code points, end exclusive; null texts have no match. A blob
    may come in several rows, with the same text and kinds: it counts once.
    """

    def matches(rule: Rule) -> Column:
        rx = F.lit(rule.pattern)
        pairs = F.arrays_zip(F.split("text", rule.pattern, -1).alias("piece"), F.regexp_extract_all("text", rx, F.lit(0)).alias("hit"))
        own = F.transform(
            F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("at"), F.length(p["piece"]).cast("long").alias("gap"), p["hit"].alias("hit"))), lambda p: p["hit"].isNotNull()),
            lambda p: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), p["at"].alias("at"), p["gap"].alias("gap"), F.length(p["hit"]).cast("long").alias("size"), (F.length(F.regexp_extract(p["hit"], rule.pattern, rule.group)) >= rule.least).alias("holds")),
        )
        return F.when(F.array_contains("kinds", rule.kind) & F.col("text").rlike(rule.pattern), own).otherwise(F.array().cast("array<struct<kind:string,version:int,at:int,gap:bigint,size:bigint,holds:boolean>>"))

    rows = blobs.select("blob", F.inline(F.concat(*(matches(r) for r in rules))))
    rows = rows.repartition("blob", "kind").dropDuplicates(["blob", "kind", "at"])
    before = Window.partitionBy("blob", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    return rows.select("blob", "kind", "version", "holds", (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end")).where("holds").drop("holds")


class Ledger:
    """Two Parquet tables in one folder, which all executors share. Appending twice changes no report."""

    def __init__(self, path: str, rules: tuple[Rule, ...] = RULES):
        self.path, self.rules = path.rstrip("/"), rules

    def _table(self, spark, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def findings(self, spark) -> DataFrame:
        wanted = F.create_map(*(F.lit(x) for r in self.rules for x in (r.kind, r.version)))
        return self._table(spark, "findings", FINDINGS).where(F.col("version") == F.try_element_at(wanted, F.col("kind"))).distinct()

    def unseen(self, history: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(blob, kinds): the rule kinds for which the ledger lacks the blob at the rule's version, if any."""
        pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in self.rules))
        blobs = common.pick(history, text=text_col).select(blob_of(F.col("text")).alias("blob")).distinct()
        todo = blobs.select("blob", F.inline(pairs)).join(self._table(history.sparkSession, "seen", SEEN), ["blob", "kind", "version"], "left_anti")
        return todo.groupBy("blob").agg(F.collect_set("kind").alias("kinds"))

    def update(self, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Scans one copy of each blob for what was not seen, then adds the findings, and last the pairs as seen.

        Ids may be null or repeated, and rows too; null texts are the empty blob; an empty history adds nothing.
        """
        rows = common.pick(history, id=id_col, text=text_col).withColumn("blob", blob_of(F.col("text")))
        todo = self.unseen(history, id_col, text_col)
        # The row that stands for a blob; the join moves each text once and sorts none.
        one = rows.groupBy("blob").agg(F.min("id").alias("id")).join(todo, "blob")
        a, b = rows.alias("a"), one.hint("shuffle_hash").alias("b")
        texts = a.join(b, (F.col("a.blob") == F.col("b.blob")) & F.col("a.id").eqNullSafe(F.col("b.id"))).select("a.blob", "a.text", "b.kinds")
        found = spans(texts, self.rules).distinct()
        todo = todo.select("blob", F.inline(F.transform("kinds", lambda k: F.struct(k.alias("kind"))))).withColumn("version", F.element_at(F.create_map(*(F.lit(x) for r in self.rules for x in (r.kind, r.version))), F.col("kind")))
        seen = common.written(todo.select("blob", "kind", "version"))  # before the ledger changes
        found.write.mode("append").parquet(f"{self.path}/findings")
        seen.write.mode("append").parquet(f"{self.path}/seen")

    def by_blob(self, spark) -> DataFrame:
        """(blob, spans): spans in the order of start and then of the rules."""
        order = F.create_map(*(F.lit(x) for i, r in enumerate(self.rules) for x in (r.kind, i)))
        return self.findings(spark).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", F.element_at(order, F.col("kind")).alias("order"), "end", "kind"))).alias("spans"))

    def report(self, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, blob, spans) for every row of history, repeated ones and those with null ids too.

        Rows without findings, and null texts, have an empty list.
        """
        spark = history.sparkSession
        rows = common.pick(history, id=id_col, text=text_col).select("id", blob_of(F.col("text")).alias("blob"))
        found = self.by_blob(spark)
        kind = found.schema["spans"].dataType
        return rows.join(found, "blob", "left").select("id", "blob", F.coalesce("spans", F.array().cast(kind)).alias("spans"))

    def redact(self, history: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
        """All of history's columns, with the spans of the findings replaced by the mark; overlapping ones by one mark.

        Repeated rows are redacted alike; null texts stay null. Columns may have any names, each but once. Texts are not
        moved while the ledger's findings are few enough to be broadcast.
        """
        spark = history.sparkSession
        few = self._table(spark, "findings", FINDINGS).count() <= BROADCAST_FINDINGS
        found = self.by_blob(spark).hint("broadcast" if few else "merge")
        names = history.columns
        inner = history.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text_col}`").alias("text"))
        # A span that begins after all former ones end starts a new gap.
        merged = F.aggregate(
            "spans",
            F.array().cast("array<struct<start:int,end:int>>"),
            lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
        )
        ends = F.concat(F.array(F.lit(0)), F.transform("merged", lambda s: s["end"]))
        starts = F.concat(F.transform("merged", lambda s: s["start"]), F.array(F.char_length("text")))
        kept = F.array_join(F.zip_with(ends, starts, lambda e, s: F.substring(F.col("text"), e + 1, s - e)), mark)
        joined = inner.withColumn("blob", blob_of(F.col("text"))).join(found, "blob", "left").withColumn("merged", merged)
        redacted = F.when(F.col("merged").isNull(), F.col("text")).otherwise(kept)
        return joined.select(*((redacted if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)))


def scan(documents: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """The contract's columns, a row for each row; without a ledger's path a new one in the shared folder begins empty.

    Repeated rows, null ids and copies of a text have the same spans as any other row; null texts have none.
    """
    ledger = Ledger(ledger_path or common.shared_dir(documents.sparkSession))
    ledger.update(documents)
    report = ledger.report(documents)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return report.select(F.col("id").alias("doc_id"), *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))
