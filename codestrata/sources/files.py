"""Files of a project as rows, from any store that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.config import Config
from codestrata.functions import globs

#: Fixed value: exclude globs that aim at tests.
TEST_GLOB = re.compile(r"(?:^|[/.])(?:tests?|spec|e2e-spec)(?:[/.]|$)|__tests__")


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of all files below the root, as UTF-8; paths are relative."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # A path bears its scheme and the root as it was given: what follows the root's last folders is the file.
    tail = F.lit("/" + root.split("://", 1)[-1].strip("/") + "/")
    whole = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    below = whole.substr(F.instr(whole, tail) + F.length(tail), F.length(whole))
    return rows.select(F.url_decode(F.regexp_replace(below, r"\+", "%2B")).alias("file"), F.decode("content", "UTF-8").alias("text"))


def in_scope(files: DataFrame, config: Config, ignored_dirs: DataFrame | None = None, ignored_files: DataFrame | None = None) -> DataFrame:
    """Files that the scope includes, that no exclude glob takes by themselves or by a folder, and that aren't ignored."""
    kept = files.where(globs.in_scope(F.col("file"), config.include, config.exclude))
    if ignored_files is not None:
        kept = kept.join(ignored_files.select("file").distinct(), "file", "left_anti")
    if ignored_dirs is not None:
        above = kept.select("file", F.explode(globs.ancestors(F.col("file"))).alias("dir"))
        under = above.join(ignored_dirs.select("dir").distinct(), "dir", "left_semi").select("file").distinct()
        kept = kept.join(under, "file", "left_anti")
    return kept


def test_files(files: DataFrame, config: Config, measured: DataFrame) -> DataFrame:
    """Files that only globs for tests keep out of the scope."""
    loose = Config(include=config.include, exclude=tuple(g for g in config.exclude if not TEST_GLOB.search(g)))
    return in_scope(files, loose).join(measured.select("file").distinct(), "file", "left_anti")
