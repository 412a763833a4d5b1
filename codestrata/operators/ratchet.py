"""The ratchet: a scan's debt and aggregates against a stored baseline; only what got worse fails."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregates in their order, ratios and their numerators, rules whose debt is their worst value, rules
# that some scans don't measure, and the tolerance.
AGGREGATES = ["erosion.fraction", "erosion.mass", "verbosity.fraction", "verbosity.lines", "typesafety.escapes.count", "imports.unknown.count", "cycles.count", "coupling.hidden.count", "deadcode.exports.count", "deadcode.files.count", "duplication.percent", "duplication.lines", "orphans.count"]
NUMERATORS = {"erosion.fraction": "erosion.mass", "verbosity.fraction": "verbosity.lines", "duplication.percent": "duplication.lines"}
MAX_RULES = ["cyclomatic-complexity", "cognitive-complexity", "function-length", "file-length", "nesting-depth", "too-many-params", "nested-callbacks"]
SOMETIMES = [("orphans.count", "depcruise", "orphan"), ("coupling.hidden.count", "churn", "hidden-coupling")]
EPSILON = 1e-6
FORMAT, IMPORT_RULES = 2, 3

DEBT = ["kind", "tool", "rule", "file"]


def rounded(value: Column) -> Column:
    """Six decimals, half up."""
    return F.floor(value * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)


def debt(findings: DataFrame) -> DataFrame:
    """(kind, tool, rule, file, value): the worst value for rules that measure a function, else how many."""
    rows = findings.withColumn("kind", F.when(F.col("rule").isin(MAX_RULES), "max").otherwise("count"))
    grouped = rows.groupBy(*DEBT).agg(F.max(F.coalesce("value", F.lit(0.0))).alias("worst"), F.count("*").cast("double").alias("n"))
    return grouped.select(*DEBT, F.when(F.col("kind") == "max", F.col("worst")).otherwise(F.col("n")).alias("value"))


def comparable(rows: DataFrame, before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Debt counts that both scans measured, and the rest. before, now: aggregates (key, value); maxima always stay."""
    keys = unmeasured_rules(before).unionByName(unmeasured_rules(now)).distinct()
    unmeasured = keys.withColumn("kind", F.lit("count"))
    on = ["kind", "tool", "rule"]
    return rows.join(unmeasured, on, "left_anti"), rows.join(unmeasured, on, "left_semi")


def unmeasured_rules(aggregates: DataFrame) -> DataFrame:
    """(tool, rule) of the rules that the absence of an aggregate says weren't measured."""
    wanted = aggregates.sparkSession.createDataFrame(SOMETIMES, "key string, tool string, rule string")
    return wanted.join(aggregates.where("value is not null").select("key"), "key", "left_anti").select("tool", "rule")


def compare_debt(before: DataFrame, after: DataFrame, tools: list[str]) -> DataFrame:
    """Debt of both sides with a verdict, by a full outer join on the key.

    What only the baseline has is skipped if its tool did not run now, else an improvement; what only the scan has is
    a regression, whether or not the tool ran for the baseline.
    """
    a = before.select(*DEBT, F.col("value").alias("before"))
    b = after.select(*DEBT, F.col("value").alias("after"))
    known = before.select("file").distinct().withColumn("known", F.lit(True))
    both = a.join(b, DEBT, "full_outer").join(known, "file", "left")
    verdict = (
        F.when(F.col("before").isNull(), F.when(F.col("known"), "new-entry").otherwise("new-file"))
        .when(F.col("after").isNull(), F.when(F.col("tool").isin(tools), "improvement").otherwise("skipped"))
        .when(F.col("after") > F.col("before"), "increase")
        .when(F.col("after") < F.col("before"), "improvement")
        .otherwise("unchanged")
    )
    return both.select(*DEBT, "before", "after", verdict.alias("verdict"))


def compare_aggregates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after, verdict). What one side lacks is skipped; a ratio may rise while its numerator does not."""
    a, b = before.where("value is not null").select("key", F.col("value").alias("before")), after.where("value is not null").select("key", F.col("value").alias("after"))
    both = a.join(b, "key", "full_outer").where(F.col("key").isin(AGGREGATES))
    companion = F.create_map(*(F.lit(x) for pair in NUMERATORS.items() for x in pair))
    own = both.withColumn("companion", F.try_element_at(companion, F.col("key")))
    numerators = both.where(F.col("key").isin(list(NUMERATORS.values()))).select(F.col("key").alias("companion"), F.col("before").alias("mass_before"), F.col("after").alias("mass_after"))
    joined = own.join(numerators, "companion", "left")
    diluted = F.coalesce(F.col("mass_after") <= F.col("mass_before") + EPSILON, F.lit(False))
    verdict = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "skipped")
        .when(F.col("after") > F.col("before") + EPSILON, F.when(diluted, "diluted").otherwise("regression"))
        .when(F.col("after") < F.col("before") - EPSILON, "improvement")
        .otherwise("unchanged")
    )
    return joined.select("key", "before", "after", verdict.alias("verdict"))


REGRESSIONS = ["regression", "new-file", "new-entry", "increase"]


@dataclass(frozen=True)
class Snapshot:
    """debt and aggregates of a scan, and what has to agree for a comparison."""

    debt: DataFrame
    aggregates: DataFrame
    thresholds: dict[str, float]
    scope: dict[str, Any]
    generator: str
    tools: dict[str, str] = field(default_factory=dict)
    format: int = FORMAT


def incompatibility(before: Snapshot, now: Snapshot, unused_files: int | None = None) -> str | None:
    """Why two snapshots can't be compared, the first reason in a fixed order; none if they can."""
    if before.format != FORMAT:
        return f"the baseline has format {before.format}, {FORMAT} is expected"
    if before.generator != now.generator:
        return f"the baseline is by version {before.generator}, this is {now.generator}"
    for key, value in now.thresholds.items():
        if before.thresholds.get(key) != value:
            return f"threshold {key} was {before.thresholds.get(key)}, is {value}"
    a, b = before.scope, now.scope
    if a.get("include") != b.get("include") or a.get("exclude") != b.get("exclude"):
        return "the scope has changed"
    if {"knip", "jscpd"} & before.tools.keys() and a.get("tools_scoped") is not True:
        return "the baseline counts clones and dead code outside the scope"
    if a.get("import_rules") != IMPORT_RULES:
        return "the baseline follows older import rules"
    if a.get("gitignore") != b.get("gitignore"):
        return "ignored files are left out on one side only"
    if not isinstance(a.get("rules"), list):
        return "the baseline is older than the choice of rules"
    if a["rules"] != b.get("rules"):
        return f"optional rules were {a['rules']}, are {b.get('rules')}"
    if (a.get("vendored") or []) != (b.get("vendored") or []):
        return "vendored sub-projects have changed"
    if "knip" in before.tools and b.get("knip_trusted") is not None and a.get("knip_trusted", True) != b["knip_trusted"]:
        said = "not measured" if unused_files is None else str(unused_files)
        return f"the dead-code report is trusted on one side only ({said} unused files now)"
    for tool, version in before.tools.items():
        if tool in now.tools and now.tools[tool] != version:
            return f"{tool} was {version}, is {now.tools[tool]}"
    return None


def compare(before: Snapshot, now: Snapshot) -> DataFrame:
    """(kind, key, before, after, verdict): aggregates, counts and maxima. Raises ValueError if they can't be compared."""
    if reason := incompatibility(before, now):
        raise ValueError(reason)
    key = F.concat_ws("|", "tool", "rule", "file")
    a, a_left = comparable(before.debt, before.aggregates, now.aggregates)
    b, b_left = comparable(now.debt, before.aggregates, now.aggregates)
    tools = [*now.tools, "metrics", "imports", "depcruise", "churn"] if now.tools is not None else []
    of_debt = compare_debt(a, b, tools).select("kind", key.alias("key"), "before", "after", "verdict")
    left = a_left.select("kind", key.alias("key")).union(b_left.select("kind", key.alias("key"))).distinct()
    none = F.lit(None).cast("double")
    skipped = left.select("kind", "key", none.alias("before"), none.alias("after"), F.lit("skipped").alias("verdict"))
    rounded_now = now.aggregates.withColumn("value", rounded(F.col("value")))
    of_aggregates = compare_aggregates(before.aggregates, rounded_now).select(F.lit("aggregate").alias("kind"), "key", "before", "after", "verdict")
    return of_aggregates.unionByName(of_debt).unionByName(skipped)


def regressions(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict").isin(REGRESSIONS))


def findings_behind(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings whose debt key got worse."""
    keys = regressions(verdicts).select("key").distinct()
    return findings.join(keys, F.concat_ws("|", "tool", "rule", "file") == F.col("key"), "left_semi")


def check_ratios(aggregates: DataFrame) -> DataFrame:
    """The aggregates, or an error where a share is more than its whole."""
    limit = F.when(F.col("key") == "duplication.percent", 100.0).when(F.col("key").isin("verbosity.fraction", "erosion.fraction"), 1.0)
    wrong = F.coalesce(F.col("value") > limit + EPSILON, F.lit(False))
    return aggregates.withColumn("value", F.when(wrong, F.raise_error(F.concat(F.lit("out of range: "), F.col("key"))).cast("double")).otherwise(F.col("value")))
