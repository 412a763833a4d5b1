"""Version-control history as rows."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The record marks of the log's format, NUL between records.
COMMIT_MARK, FIELD_MARK = "\x01", "\x1f"
LOG = ["log", "--no-merges", "--full-history", "--relative", "--numstat", "-z", "--format=%x01%H%x1f%aI"]
IGNORED = ["ls-files", "-z", "--others", "--ignored", "--exclude-standard", "--directory"]
CHANGES = "commit_pos long, hash string, date string, file_pos long, path string, previous_path string, added_lines long, deleted_lines long, binary boolean"


@dataclass(frozen=True)
class History:
    """raw is the log's text; a folder that is no repository is a normal state with a reason."""

    available: bool
    raw: str = ""
    reason: str | None = None


@dataclass(frozen=True)
class Ignored:
    available: bool
    directories: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    reason: str | None = None


def _git(root: str | Path, arguments: list[str]) -> tuple[str | None, str | None]:
    """Output, or the first line of what went wrong."""
    try:
        done = subprocess.run(["git", *arguments], cwd=root, capture_output=True, check=False)
    except OSError as e:
        return None, str(e)
    if done.returncode:
        return None, next(iter(done.stderr.decode("utf-8", "replace").splitlines()), "git failed")
    return done.stdout.decode("utf-8", "replace"), None


def read_log(root: str | Path, since: str | None = None, revisions: str | None = None) -> History:
    raw, reason = _git(root, [*LOG, *([f"--since={since}"] if since else []), *([revisions] if revisions else []), "--", "."])
    return History(raw is not None, raw or "", reason)


def read_ignored(root: str | Path) -> Ignored:
    """Ignored paths; a slash at the end stands for all below a folder."""
    raw, reason = _git(root, IGNORED)
    if raw is None:
        return Ignored(False, reason=reason)
    names = [n for n in raw.split("\0") if n not in ("", "./")]
    return Ignored(True, [n[:-1] for n in names if n.endswith("/")], [n for n in names if not n.endswith("/")])


def window_start(days: float, now: datetime | None = None) -> str:
    """The date, in UTC, that many times 24 hours ago."""
    return ((now or datetime.now(timezone.utc)).astimezone(timezone.utc) - timedelta(days=days)).strftime("%Y-%m-%d")


def window_start_column(days: int, now: Column) -> Column:
    return F.date_format(F.timestamp_add("DAY", F.lit(-days), now), "yyyy-MM-dd")


def parse_log(logs: DataFrame, raw: str = "raw", by: str | None = None) -> DataFrame:
    """(commit_pos, hash, date, file_pos, path, previous_path, added_lines, deleted_lines, binary) of raw logs.

    by: a column that tells logs apart, if there are several. A record that begins with the mark is a commit; one with
    an empty path is a rename, whose two next records are the old and the new path; counts of ``-`` are those of a
    binary file. Commits without changes have a row with a null path.
    """
    key = F.col(by) if by else F.lit(0)
    rows = logs.select(key.alias("log"), F.posexplode(F.split(F.col(raw), "\0", -1)).alias("at", "record"))
    in_order = Window.partitionBy("log").orderBy("at")
    text = F.regexp_replace("record", "^[\r\n]+", "")
    rows = rows.withColumn("text", text).withColumn("next_1", F.lead("record", 1).over(in_order)).withColumn("next_2", F.lead("record", 2).over(in_order))
    fields = F.split("text", "\t", 3)
    looks = ~F.startswith("text", F.lit(COMMIT_MARK)) & (F.size(fields) == 3)
    rows = rows.withColumn("fields", fields).withColumn("looks", looks).withColumn("renames", looks & (F.try_element_at("fields", F.lit(3)) == ""))
    # The two records after a rename are paths, whatever they look like; a rename among those isn't one, so runs of
    # records that look like renames are counted through: of such a run the first is one, the fourth is the next.
    before = F.last(F.when(~F.col("renames"), F.col("at")), ignorenulls=True).over(in_order)
    place = F.when(F.col("renames"), (F.col("at") - F.coalesce(before, F.lit(-1)) - 1) % 3)
    rows = rows.withColumn("true_rename", F.coalesce(place == 0, F.lit(False)))
    eaten = F.coalesce(F.lag("true_rename", 1).over(in_order), F.lit(False)) | F.coalesce(F.lag("true_rename", 2).over(in_order), F.lit(False))
    rows = rows.withColumn("eaten", eaten).where(~F.col("eaten") & (F.col("text") != ""))
    head = F.startswith("text", F.lit(COMMIT_MARK))
    rows = rows.withColumn("head", head).withColumn("commit_pos", F.sum(F.col("head").cast("long")).over(in_order) - 1).withColumn("commit", F.last(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(in_order))
    rows = rows.where((F.col("commit_pos") >= 0) & (F.col("head") | F.col("looks")))
    added, deleted = F.try_element_at("fields", F.lit(1)), F.try_element_at("fields", F.lit(2))
    binary = (added == "-") | (deleted == "-")
    parts = F.split(F.substring("commit", 2, 1 << 20), FIELD_MARK, -1)
    path = F.when(F.col("true_rename"), F.coalesce("next_2", F.lit(""))).otherwise(F.try_element_at("fields", F.lit(3)))
    number = lambda c: F.when(binary, F.lit(0)).otherwise(c.try_cast("long"))
    out = rows.select(
        *([F.col("log").alias(by)] if by else []),
        "commit_pos",
        parts[0].alias("hash"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("date"),
        "at",
        F.when(~F.col("head"), path).alias("path"),
        F.when(F.col("true_rename"), F.coalesce("next_1", F.lit(""))).alias("previous_path"),
        F.when(~F.col("head"), number(added)).alias("added_lines"),
        F.when(~F.col("head"), number(deleted)).alias("deleted_lines"),
        F.when(~F.col("head"), binary).alias("binary"),
        "head",
    )
    return out.where(F.col("head") | (F.col("path") != "")).withColumn("file_pos", F.col("at").cast("long")).drop("at", "head")


def changes(parsed: DataFrame) -> DataFrame:
    return parsed.where("path is not null")


def commits_read(parsed: DataFrame) -> int:
    return parsed.select("commit_pos").distinct().count()


def load(spark: SparkSession, history: History) -> DataFrame:
    return parse_log(spark.createDataFrame([(history.raw,)], "raw string"))
