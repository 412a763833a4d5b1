"""Baselines in a folder: debt and aggregates as Parquet tables, the rest as one small JSON row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import ratchet

DEBT = "kind string, tool string, rule string, file string, value double"
AGGREGATES = "key string, value double"


class BaselineError(ValueError):
    """A stored baseline isn't one."""


def write(snapshot: ratchet.Snapshot, path: str) -> None:
    """Aggregates are rounded; an absent one stays absent."""
    spark = snapshot.debt.sparkSession
    snapshot.debt.orderBy(*ratchet.DEBT).write.mode("overwrite").parquet(f"{path}/debt")
    snapshot.aggregates.where("value is not null").withColumn("value", ratchet.rounded(F.col("value"))).orderBy("key").write.mode("overwrite").parquet(f"{path}/aggregates")
    about = {"format": snapshot.format, "generator": snapshot.generator, "thresholds": snapshot.thresholds, "scope": snapshot.scope, "tools": snapshot.tools}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read(spark: SparkSession, path: str) -> ratchet.Snapshot:
    """Raises BaselineError for what isn't a baseline of this format."""
    try:
        about = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/about").collect()))
    except Exception as e:
        raise BaselineError(f"{path}: {e}") from e
    if not isinstance(about, dict) or about.get("format") != ratchet.FORMAT or not isinstance(about.get("generator"), str) or not isinstance(about.get("scope"), dict):
        raise BaselineError(f"{path} is no baseline of format {ratchet.FORMAT}")
    return ratchet.Snapshot(spark.read.schema(DEBT).parquet(f"{path}/debt"), spark.read.schema(AGGREGATES).parquet(f"{path}/aggregates"), about.get("thresholds", {}), about["scope"], about["generator"], about.get("tools", {}), about["format"])




def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """(kind, tool, rule, file, value) of baselines that keep debt as two maps by ``tool|rule|file``."""
    schema = "version int, debtCounts map<string,double>, debtMaxima map<string,double>"
    parsed = texts.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("b")).where("b.version = 2")
    rows = parsed.select(F.lit("count").alias("kind"), F.explode("b.debtCounts").alias("key", "value")).unionByName(parsed.select(F.lit("max").alias("kind"), F.explode("b.debtMaxima").alias("key", "value")))
    part = F.split("key", "\\|", 3)
    return rows.select("kind", part[0].alias("tool"), part[1].alias("rule"), part[2].alias("file"), "value")
