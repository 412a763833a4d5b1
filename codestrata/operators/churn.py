"""Change history: renames, churn, hotspots, and files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.config import Config
from codestrata.functions import globs
from codestrata.operators import findings
from codestrata.plans import lineage

#: (commit_pos, file_pos): commits from the newest on, and changes in the order of the log.
ORDER = ["commit_pos", "file_pos"]


def current_paths(changes: DataFrame) -> DataFrame:
    """changes with ``file``: the name that the changed path has now.

    changes: commit_pos, file_pos, path, previous_path. A change's own rename counts only for changes after it in the
    log, and an older rename from the same name overrides a newer one; what a rename leads to is the name that its new
    path had when it was met. Renames form a forest: each points to the last rename before it that begins at its new
    path. Pointers are doubled until they reach the roots, so a chain of n renames takes log2 n joins.
    """
    # A struct of both positions orders as the log does.
    rows = changes.withColumn("at", F.struct(*(F.col(c).cast("long").alias(c) for c in ORDER)))
    renames = rows.where(F.col("previous_path").isNotNull() & (F.col("previous_path") != F.col("path"))).select("at", F.col("previous_path").alias("old"), F.col("path").alias("new"))
    # Events of one path in order: renames away from it set what it leads to, uses of it read that.
    sets = renames.select(F.col("old").alias("name"), F.col("at"), F.lit(1).alias("after"), F.col("at").alias("rename"))
    last = F.last("rename", ignorenulls=True).over(Window.partitionBy("name").orderBy("at", "after").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def pointing(uses: DataFrame) -> DataFrame:
        none = F.lit(None).cast(sets.schema["at"].dataType)
        both = uses.select("name", "at", F.lit(0).alias("after"), none.alias("rename")).unionByName(sets)
        return both.withColumn("parent", last).where("after = 0").select("name", "at", "parent")

    nodes = renames.join(pointing(renames.select(F.col("new").alias("name"), "at")).withColumnRenamed("name", "new"), ["new", "at"], "left").select("at", "new", "parent")
    nodes = lineage.written(nodes)
    while not nodes.where("parent is not null").isEmpty():
        up = nodes.select(F.col("at").alias("parent"), F.col("new").alias("up_new"), F.col("parent").alias("up"))
        nodes = nodes.join(up, "parent", "left").select("at", F.coalesce("up_new", "new").alias("new"), F.col("up").alias("parent"))
        nodes = lineage.written(nodes)
    ends = nodes.select(F.col("at").alias("parent"), F.col("new").alias("now"))
    uses = pointing(rows.select(F.col("path").alias("name"), "at")).withColumnRenamed("name", "path")
    named = rows.join(uses, ["path", "at"], "left").join(ends, "parent", "left")
    return named.select(*changes.columns, F.coalesce("now", "path").alias("file"))


def churn(changes: DataFrame, by: str = "file") -> DataFrame:
    """Of each file the number of its change rows, lines, and first and last date as text."""
    return changes.groupBy(by).agg(F.count("*").alias("commits"), F.sum("added_lines").alias("added_lines"), F.sum("deleted_lines").alias("deleted_lines"), F.min("date").alias("first_change"), F.max("date").alias("last_change"))


def churn_order() -> list[Column]:
    return [F.desc("commits"), F.asc("file")]


def summarize_churn(commits_scanned: int, churned: DataFrame) -> DataFrame:
    return churned.agg(F.lit(commits_scanned).cast("long").alias("commits_scanned"), F.count("*").alias("files"), F.coalesce(F.sum("added_lines"), F.lit(0)).alias("added_lines"), F.coalesce(F.sum("deleted_lines"), F.lit(0)).alias("deleted_lines"))


def hotspots(churned: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """Files by changes times their worst function's complexity; files without measures are left out."""
    worst = functions.groupBy("file").agg(F.max("cyclomatic").alias("max_cyclomatic"), F.max("cognitive").alias("max_cognitive"))
    known = files.select("file").join(worst, "file", "left")
    score = F.coalesce(F.greatest("max_cyclomatic", "max_cognitive"), F.lit(0))
    return churned.join(known, "file").withColumn("score", F.col("commits") * score)


def top_hotspots(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("file")).limit(k)


def histories(changes: DataFrame, config: Config, nodes: DataFrame | None = None) -> DataFrame:
    """(commit, file) of commits of 2 to the most files in scope; only then files that no longer exist are left out."""
    rows = changes.select("commit", "file").distinct()
    # Sizes are counted before the shuffle's end, so a commit of any size is no task's burden; then it is left out.
    fitting = rows.groupBy("commit").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= config.churn["maxFilesPerCommit"]))
    kept = rows.join(fitting, "commit", "left_semi").select("commit", "file")
    return kept if nodes is None else kept.join(nodes.select("file").distinct(), "file", "left_semi").select("commit", "file")


def in_scope(changes: DataFrame, config: Config) -> DataFrame:
    return changes.where(globs.matches_any(F.col("file"), config.include) & ~globs.matches_any(F.col("file"), config.exclude))


def co_changes(history: DataFrame, config: Config) -> DataFrame:
    """(file_a < file_b, together, commits_a, commits_b, degree) above both limits.

    A pair can't be more frequent than its rarer file, so rare files go before the self-join; a commit has few files by
    the limit on its size, which bounds the pairs of a commit.
    """
    least = config.churn["minCoChangeCommits"]
    counts = history.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    active = history.join(counts, "file").select("commit", "file", "n")
    a = active.select("commit", F.col("file").alias("file_a"), F.col("n").alias("commits_a"))
    b = active.select("commit", F.col("file").alias("file_b"), F.col("n").alias("commits_b"))
    pairs = a.join(b, "commit").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("together"), F.first("commits_a").alias("commits_a"), F.first("commits_b").alias("commits_b"))
    degree = F.col("together") / F.least("commits_a", "commits_b")
    return pairs.where(F.col("together") >= least).withColumn("degree", degree).where(F.col("degree") >= config.churn["minCoChangeDegree"])


def linked_pairs(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with ``linked``: a path of at most two imports either way, or a shared module of types.

    Only the edges of files in a pair take part, and each way to be linked is an equi-join on the pair.
    """
    ab = pairs.select("file_a", "file_b").distinct()
    both = ab.select(F.col("file_a").alias("x"), F.col("file_b").alias("y"), "file_a", "file_b").union(ab.select(F.col("file_b").alias("x"), F.col("file_a").alias("y"), "file_a", "file_b"))
    e = edges.select("src", "dst").distinct()
    out = both.join(e, both.x == e.src).select("file_a", "file_b", "y", F.col("dst").alias("middle"))
    direct = out.where("middle = y").select("file_a", "file_b")
    e2 = e.select(F.col("src").alias("middle"), F.col("dst").alias("y"))
    through = out.join(e2, ["middle", "y"]).select("file_a", "file_b")
    types = nodes.where("is_types_module").select(F.col("file").alias("dst"))
    typed = e.join(types, "dst", "left_semi")
    shared = ab.join(typed.select(F.col("src").alias("file_a"), "dst"), "file_a").join(typed.select(F.col("src").alias("file_b"), "dst"), ["file_b", "dst"]).select("file_a", "file_b")
    found = direct.union(through).union(shared).distinct().withColumn("found", F.lit(True))
    return pairs.join(found, ["file_a", "file_b"], "left").withColumn("linked", F.coalesce("found", F.lit(False))).drop("found")


def coupling_findings(pairs: DataFrame, config: Config) -> DataFrame:
    """Pairs that change together without a link; percentages are rounded half up."""
    percent = F.floor(F.col("degree") * 100 + 0.5)
    limit = F.lit(float(int(config.churn["minCoChangeDegree"] * 100 + 0.5)))
    text = F.format_string("%s changes with it in %s%% of %s commits", F.col("file_b"), percent.cast("string"), F.least("commits_a", "commits_b").cast("string"))
    return findings.make(pairs.where("not linked"), "churn", "hidden-coupling", F.col("file_a"), text, symbol=F.col("file_b"), key=F.col("file_b"), value=percent, threshold=limit)


def measurable(commits_read: int, config: Config) -> bool:
    """All commits read count, in scope or not."""
    return commits_read >= config.churn["minHistoryCommits"]
