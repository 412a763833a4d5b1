"""Measures of functions and files, their summary, and what exceeds a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.config import Config
from codestrata.operators import findings

#: A line is blank if it has white space alone, as the source language's own trim sees it.
BLANK = "^[\\s\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*$"
#: Rule, measure of a function, threshold's name.
FUNCTION_RULES = [
    ("cyclomatic-complexity", "cyclomatic", "cyclomaticComplexity"),
    ("cognitive-complexity", "cognitive", "cognitiveComplexity"),
    ("function-length", "sloc", "maxLinesPerFunction"),
    ("too-many-params", "params", "maxParams"),
    ("nesting-depth", "nesting_depth", "maxDepth"),
    ("nested-callbacks", "callback_depth", "maxNestedCallbacks"),
]


def sloc_lines(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line) of the lines that aren't blank; comments count."""
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "source"))
    return lines.where(~F.col("source").rlike(BLANK)).select("file", (F.col("at") + 1).alias("line"))


def file_sloc(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Every file, those without such lines having 0."""
    n = F.size(F.filter(F.split(F.col(text), "\n", -1), lambda s: ~s.rlike(BLANK)))
    return files.select(F.col(file).alias("file"), F.coalesce(n, F.lit(0)).alias("sloc"))


def mass(cyclomatic: Column, sloc: Column) -> Column:
    return cyclomatic * F.sqrt(sloc)


def erosion(functions: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Mass, eroded mass (of functions whose complexity exceeds the threshold) and its share; 0 without any."""
    m = mass(F.col("cyclomatic"), F.col("sloc"))
    out = functions.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(m), F.lit(0.0)).alias("total_mass"),
        F.coalesce(F.sum(F.when(F.col("cyclomatic") > threshold, m)), F.lit(0.0)).alias("eroded_mass"),
    )
    return out.withColumn("fraction", F.coalesce(F.try_divide("eroded_mass", "total_mass"), F.lit(0.0)))


def median_of(column: str) -> Column:
    """Exact; the mean of the two middle ones; 0 without any."""
    return F.coalesce(F.median(column), F.lit(0.0))


def summarize(files: DataFrame, functions: DataFrame, config: Config) -> DataFrame:
    """One row over the project. files: file, sloc, function_count; functions: their measures."""
    limit = config.thresholds["cyclomaticComplexity"]
    per_file = files.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("sloc"), F.lit(0)).alias("total_sloc"),
        F.coalesce(F.avg("function_count"), F.lit(0.0)).alias("functions_per_file"),
    )
    per_function = functions.agg(
        F.count("*").alias("function_count"),
        F.coalesce(F.max("cyclomatic"), F.lit(0)).alias("max_cyclomatic"),
        F.coalesce(F.max("cognitive"), F.lit(0)).alias("max_cognitive"),
        F.count_if(F.col("cyclomatic") > limit).alias("over_cyclomatic"),
        median_of("sloc").alias("median_function_sloc"),
        median_of("cyclomatic").alias("median_cyclomatic"),
        F.coalesce(F.sum(mass(F.col("cyclomatic"), F.col("sloc"))), F.lit(0.0)).alias("total_mass"),
        F.coalesce(F.sum(F.when(F.col("cyclomatic") > limit, mass(F.col("cyclomatic"), F.col("sloc")))), F.lit(0.0)).alias("eroded_mass"),
    )
    both = per_file.crossJoin(per_function)  # one row each
    return both.withColumn("erosion_fraction", F.coalesce(F.try_divide("eroded_mass", "total_mass"), F.lit(0.0)))


def exceeding(functions: DataFrame, config: Config, keys: list[str]) -> DataFrame:
    """A row (keys, rule, value, threshold) for each measure above its threshold: one pass, no join."""
    pairs = [x for rule, column, limit in FUNCTION_RULES for x in (F.lit(rule), F.col(column).cast("double"), F.lit(float(config.thresholds[limit])))]
    rows = functions.select(*keys, F.stack(F.lit(len(FUNCTION_RULES)), *pairs).alias("rule", "value", "threshold"))
    return rows.where("value > threshold")


def threshold_findings(files: DataFrame, functions: DataFrame, config: Config) -> DataFrame:
    """Findings of functions and of files that are too long."""
    limit = F.lit(float(config.thresholds["maxFileLines"]))
    long = files.where(F.col("sloc") > limit)
    of_files = findings.make(long, "metrics", "file-length", F.col("file"), F.format_string("%d lines", F.col("sloc").cast("int")), line=F.lit(1), value=F.col("sloc"), threshold=limit)
    over = exceeding(functions, config, ["file", "line", "symbol"])
    text = F.format_string("%s: %s is %s, the limit is %s", F.col("symbol"), F.col("rule"), F.col("value").cast("long").cast("string"), F.col("threshold").cast("long").cast("string"))
    of_functions = findings.make(over, "metrics", F.col("rule"), F.col("file"), text, line=F.col("line"), symbol=F.col("symbol"), value=F.col("value"), threshold=F.col("threshold"))
    return findings.apply_config(of_files.unionByName(of_functions), config)
