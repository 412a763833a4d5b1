"""Low-value code: hits grouped to findings, and the share of lines that hits and clones cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import findings

#: Comments that silence the compiler, hits that make code verbose, hits that escape the types.
SILENCING = r"^\s*(?:\/\/|\/\*+|\*)\s*@ts-(ignore|nocheck)\b"
VERBOSE = ["empty-catch", "console-only-catch", "redundant-else", "assign-then-return", "boolean-ternary", "passthrough-wrapper"]
ESCAPES = ["type-escape-any", "type-escape-assertion", "type-escape-comment"]
MODULE = "#module"


def silencing_comments(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Hits of lines whose comment switches the compiler off; they belong to the module, not to a function."""
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "source"))
    name = F.regexp_extract("source", SILENCING, 1)
    line = (F.col("at") + 1).alias("line")
    return lines.where(F.col("source").rlike(SILENCING)).select(F.lit(ESCAPES[2]).alias("rule"), "file", line, line.alias("end_line"), F.lit(MODULE).alias("symbol"), F.lit("major").alias("severity"), F.concat(F.lit("@ts-"), name, F.lit(" hides compile errors")).alias("message"))


def slop_findings(hits: DataFrame) -> DataFrame:
    """A finding for each rule, file and symbol: how many, the worst severity, and the first one's line and message."""
    rank = findings.severity_rank(F.col("severity"))
    grouped = hits.groupBy("rule", "file", "symbol").agg(
        F.count("*").alias("n"),
        F.max_by("severity", rank).alias("severity"),
        F.min(F.struct("line", "end_line", "message")).alias("first"),
    )
    text = F.when(F.col("n") > 1, F.format_string("%s (%d times)", "first.message", "n")).otherwise(F.col("first.message"))
    return findings.make(grouped, "metrics", F.col("rule"), F.col("file"), text, line=F.col("first.line"), symbol=F.col("symbol"), value=F.col("n"), severity=F.col("severity"))


def lines_of(ranges: DataFrame) -> DataFrame:
    """(file, line) of ranges (file, line, end_line), each line once."""
    return ranges.where("line <= end_line").select("file", F.explode(F.sequence("line", "end_line")).alias("line")).distinct()


def verbosity(hits: DataFrame, sloc_lines: DataFrame, clone_lines: DataFrame | None = None) -> DataFrame:
    """One row: non-blank lines that hits or clones cover, all non-blank lines, and the share; 0 without any."""
    covered = lines_of(hits.where(F.col("rule").isin(VERBOSE)))
    if clone_lines is not None:
        covered = covered.union(clone_lines.select("file", "line")).distinct()
    kept = covered.join(sloc_lines, ["file", "line"], "left_semi").agg(F.count("*").alias("verbose_lines"))
    total = sloc_lines.agg(F.count("*").alias("total_sloc"))
    return kept.crossJoin(total).withColumn("fraction", F.coalesce(F.try_divide("verbose_lines", "total_sloc"), F.lit(0.0)))  # one row each


def hits_by_rule(hits: DataFrame) -> DataFrame:
    """One row with a map of the rules to their hits."""
    counts = hits.groupBy("rule").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "n")))).alias("hits_by_rule"))


def escapes(hits: DataFrame) -> DataFrame:
    """One row: hits, not groups, of the rules about types."""
    return hits.agg(F.count_if(F.col("rule").isin(ESCAPES)).alias("type_escapes"))
