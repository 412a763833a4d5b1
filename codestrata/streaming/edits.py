"""Findings of files as they are edited: a stateless stream over a folder of changed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.config import Config
from codestrata.frontend.tables import Parsed
from codestrata.operators import findings, metrics, slop


#: Fixed value: the schema of Spark's binary files.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def findings_of(files: DataFrame, config: Config) -> DataFrame:
    """Findings of a batch (file, text) that measures and rules give by themselves, without graph and history."""
    parsed = Parsed(files)
    found = metrics.threshold_findings(parsed.file_metrics(), parsed.functions(), config)
    return found.unionByName(slop.slop_findings(parsed.hits(config)))


def watch(spark: SparkSession, folder: str, sink: str, checkpoint: str, config: Config) -> StreamingQuery:
    """Appends each micro-batch's visible findings to the table at ``sink``, and ends when the folder is read.

    A batch that runs again after a failure writes the same batch number, which readers may keep once.
    """
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder)
    texts = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        found = findings.visible(findings_of(batch, config)).withColumn("batch", F.lit(number))
        found.write.mode("append").parquet(sink)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
