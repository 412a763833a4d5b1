"""Clones: repeated runs of lines or tokens found by window hashes, and reports of an outside tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators import findings

#: Least lines and tokens of a clone.
LEAST_LINES, LEAST_TOKENS = 5, 50
#: A word or a sign.
TOKEN = r"[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$]"


def windows(files: DataFrame, size: int = LEAST_LINES, file: str = "file", text: str = "text") -> DataFrame:
    """(file, at, line, end_line, before, after, hash): each run of ``size`` non-blank lines, trimmed.

    at is the place of its first line among the non-blank ones, line and end_line are lines of the file; before and
    after are how many tokens the file has ahead of the run and up to its end.
    """
    source = F.regexp_replace("raw", r"^\s+|\s+$", "")
    rows = files.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "raw"))
    rows = rows.select("file", (F.col("place") + 1).alias("line"), source.alias("source")).where("source <> ''")
    own = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("n", F.regexp_count("source", F.lit(TOKEN)).cast("long"))
    rows = rows.withColumns({"at": F.row_number().over(own) - 1, "upto": F.sum("n").over(own)})
    ahead = own.rowsBetween(0, size - 1)
    body = F.collect_list("source").over(ahead)
    rows = rows.withColumns({"end_line": F.last("line").over(ahead), "after": F.last("upto").over(ahead), "body": body})
    hash_ = F.unhex(F.md5(F.array_join("body", "\n").cast("binary"))).alias("hash")
    before = (F.col("upto") - F.col("n")).alias("before")
    return rows.where(F.size("body") == size).select("file", "at", "line", "end_line", before, "after", hash_)


def repeated(windowed: DataFrame) -> DataFrame:
    """(hash, first, copies) of windows that occur twice or more: aggregated before anything is joined."""
    seen = windowed.groupBy("hash").agg(F.min(F.struct("file", "at", "line", "end_line")).alias("first"), F.count("*").alias("copies"))
    return seen.where("copies > 1")


def clones(windowed: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(first_file, first_start, first_end, file, start, end, lines, tokens): maximal runs that repeat an earlier place.

    Each repeated window is paired with its first occurrence, so n copies give n - 1 rows, not n squared; runs on the
    same diagonal with no gap are one clone. Starts and ends are lines of the files, blank ones between them included.
    """
    pairs = windowed.join(repeated(windowed), "hash").where((F.col("file") != F.col("first.file")) | (F.col("at") != F.col("first.at")))
    pairs = pairs.withColumns({"first_file": F.col("first.file"), "diagonal": F.col("at") - F.col("first.at")})
    by = Window.partitionBy("first_file", "file", "diagonal").orderBy("at")
    runs = pairs.withColumn("island", F.col("at") - F.row_number().over(by)).groupBy("first_file", "file", "diagonal", "island")
    found = runs.agg(
        F.min("first.line").alias("first_start"),
        F.max("first.end_line").alias("first_end"),
        F.min("line").alias("start"),
        F.max("end_line").alias("end"),
        (F.max("end_line") - F.min("line") + 1).alias("lines"),
        (F.max("after") - F.min("before")).alias("tokens"),
    )
    return found.where(F.col("tokens") >= least_tokens).select("first_file", "first_start", "first_end", "file", "start", "end", "lines", "tokens")


def sides(found: DataFrame) -> DataFrame:
    """Clones as a report has them: first and second (file, start, end), the later place first, and lines."""
    later = F.struct("file", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    earlier = F.struct(F.col("first_file").alias("file"), F.col("first_start").cast("int").alias("start"), F.col("first_end").cast("int").alias("end"))
    return found.select(later.alias("first"), earlier.alias("second"), F.col("lines").cast("int").alias("lines"))


def copied_lines(found: DataFrame, sloc_lines: DataFrame) -> DataFrame:
    """One row: non-blank lines that repeat an earlier place, each once, and their share of all such lines in percent."""
    copies = found.select("file", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    own = copies.join(sloc_lines, ["file", "line"], "left_semi").agg(F.count("*").alias("lines"))
    both = own.crossJoin(sloc_lines.agg(F.count("*").alias("total")))  # one row each
    return both.select("lines", F.coalesce(F.try_divide(F.col("lines") * 100.0, F.col("total")), F.lit(0.0)).alias("percent"))


def covered_lines(found: DataFrame) -> DataFrame:
    """(file, line) that either side of a clone covers, each once. found: first/second (file, start, end) and lines."""
    sides = found.select(F.stack(F.lit(2), "first.file", "first.start", "first.end", "second.file", "second.start", "second.end").alias("file", "start", "end"))
    return sides.where("start <= end").select("file", F.explode(F.sequence("start", "end")).alias("line")).distinct()


def in_scope(found: DataFrame, files: DataFrame, vendored: DataFrame) -> DataFrame:
    """Clones with both sides in scope, except between vendored files; the measured side comes first."""
    known = files.select("file").distinct()
    kept = found.join(known, found["first.file"] == known["file"], "left_semi").join(known, found["second.file"] == known["file"], "left_semi")
    theirs = vendored.select(F.col("file").alias("v")).distinct()
    a = theirs.select(F.col("v").alias("va"))
    b = theirs.select(F.col("v").alias("vb"))
    kept = kept.join(a, F.col("first.file") == F.col("va"), "left").join(b, F.col("second.file") == F.col("vb"), "left").where("va is null or vb is null")
    swap = F.col("va").isNotNull()
    return kept.select(F.when(swap, F.col("second")).otherwise(F.col("first")).alias("first"), F.when(swap, F.col("first")).otherwise(F.col("second")).alias("second"), "lines")


def clone_findings(found: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    key = F.concat_ws(":", "second.file", F.col("second.start").cast("string"))
    text = F.format_string("%s lines as in %s", F.col("lines").cast("string"), key)
    return findings.make(found, "jscpd", "duplicate-block", F.col("first.file"), text, line=F.col("first.start"), key=key, value=F.col("lines"), threshold=F.lit(float(least)))
