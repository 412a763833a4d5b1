"""Findings: one row for each place a rule objects to, with a stable id, a severity and an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.config import REPORT_LEVEL_OF, Config

SCHEMA = "id string, tool string, rule string, severity string, file string, line int, symbol string, value double, threshold double, message string, below_report_threshold boolean"
#: Severities from the worst on, and the ratios up to which they hold.
SEVERITIES = ["critical", "major", "minor", "info"]
MINOR_UP_TO, MAJOR_UP_TO = 1.25, 2.0


def finding_id(tool: Column, rule: Column, file: Column, key: Column) -> Column:
    """It has no line, so that moved code keeps its id; two findings may share one."""
    return F.sha1(F.concat_ws("|", tool, rule, file, F.coalesce(key, F.lit("")))).substr(1, 12)


def severity_of(value: Column, threshold: Column) -> Column:
    """By value / threshold; a threshold of 0 is always exceeded critically, a missing one means major."""
    ratio = F.try_divide(value.cast("double"), threshold.cast("double"))
    return (
        F.when(value.isNull() | threshold.isNull(), "major")
        .when(threshold == 0, "critical")
        .when(ratio <= MINOR_UP_TO, "minor")
        .when(ratio <= MAJOR_UP_TO, "major")
        .otherwise("critical")
    )


def severity_rank(severity: Column) -> Column:
    """Greater is worse."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(reversed(SEVERITIES)):
        out = F.when(severity == name, k).otherwise(out)
    return out


def make(rows: DataFrame, tool: str | Column, rule: str | Column, file: Column, message: Column, line: Column | None = None, symbol: Column | None = None, key: Column | None = None, value: Column | None = None, threshold: Column | None = None, severity: Column | None = None) -> DataFrame:
    """Findings of rows. An explicit severity goes before that of the ratio; the key defaults to the symbol."""
    none = F.lit(None)
    tool, rule = (F.lit(x) if isinstance(x, str) else x for x in (tool, rule))
    line, symbol, value, threshold = (none if x is None else x for x in (line, symbol, value, threshold))
    ratio = severity_of(value, threshold)
    return rows.select(
        finding_id(tool, rule, file, F.coalesce(key, symbol) if key is not None else symbol).alias("id"),
        tool.alias("tool"),
        rule.alias("rule"),
        (F.coalesce(severity, ratio) if severity is not None else ratio).alias("severity"),
        file.alias("file"),
        line.cast("int").alias("line"),
        symbol.cast("string").alias("symbol"),
        value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"),
        message.alias("message"),
        F.lit(False).alias("below_report_threshold"),
    )


def ordering() -> list[Column]:
    """The worst first, then by how far the threshold is exceeded, then by id."""
    ratio = F.when(F.col("threshold") > 0, F.try_divide("value", "threshold"))
    return [F.desc(severity_rank(F.col("severity"))), F.desc(F.coalesce(ratio, F.lit(0.0))), F.asc("id")]


def apply_config(findings: DataFrame, config: Config) -> DataFrame:
    """Without the rules that are off, and marked where the value doesn't exceed the level of reports."""
    off = [r for r, on in config.rules.items() if not on]
    level = F.lit(None).cast("double")
    for rule in REPORT_LEVEL_OF:
        level = F.when(F.col("rule") == rule, F.lit(float(config.report_level(rule)))).otherwise(level)
    below = F.col("below_report_threshold") | F.coalesce(F.col("value") <= level, F.lit(False))
    return findings.where(~F.col("rule").isin(off) if off else F.lit(True)).withColumn("below_report_threshold", below)


def visible(findings: DataFrame, show_all: bool = False) -> DataFrame:
    return findings if show_all else findings.where(~F.col("below_report_threshold"))


def demote_dead(findings: DataFrame, unused_files: DataFrame, own_entry_points: bool) -> DataFrame:
    """Measures of files that are unused anyway go below the level of reports, if the project said where it begins."""
    if not own_entry_points:
        return findings
    dead = unused_files.select(F.col("file").alias("__file")).distinct()
    marked = findings.join(dead, F.col("file") == F.col("__file"), "left")
    low = F.col("below_report_threshold") | ((F.col("tool") == "metrics") & F.col("__file").isNotNull())
    return marked.withColumn("below_report_threshold", low).drop("__file")


def top(findings: DataFrame, limit: int = 20) -> DataFrame:
    return findings.orderBy(*ordering()).limit(limit)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
