"""Queries that run the operators on the driver's tables, and SQL for the same rows.

The tables have no source code and no history, so their columns stand in for the collections the operators work on.
STAND_INS says how, in SQL that both engines read alike; a query applies operators to those DataFrames, and its SQL
works the result out on its own from the same stand-ins.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.config import Config, resolve
from codestrata.functions import globs, specifiers
from codestrata.operators import churn, deadcode, duplication, findings, graph, imports, metrics, ratchet, slop
from codestrata.sources import gitlog

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()
STAND_INS = {
    # One function for each order line, in a file for each supplier.
    "functions": "SELECT concat('src/s', l_suppkey, '.ts') AS file, concat('fn', l_orderkey, '_', l_linenumber) AS symbol, CAST(l_linenumber AS int) AS line, CAST(l_quantity AS int) AS cyclomatic, CAST(l_quantity AS int) % 37 AS cognitive, 10 * l_linenumber AS sloc, CAST(l_quantity AS int) % 9 AS params, l_linenumber % 6 AS nesting_depth, l_linenumber % 5 AS callback_depth FROM lineitem",
    "files": "SELECT concat('src/s', s_suppkey, '.ts') AS file, CAST(s_suppkey * 13 % 900 AS int) AS sloc, 600 AS function_count FROM supplier",
    # A change for each order line: the order is the commit, the part is the file.
    "changes": "SELECT l_orderkey AS commit, concat('src/p', l_partkey, CASE WHEN l_partkey % 10 = 0 THEN '.test.ts' ELSE '.ts' END) AS file, CAST(l_quantity AS bigint) AS added_lines, CAST(l_linenumber AS bigint) AS deleted_lines, CAST(l_shipdate AS varchar(40)) AS date FROM lineitem",
    "part_files": "SELECT concat('src/p', p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '.test.ts' ELSE '.ts' END) AS file, p_size AS cyclomatic, p_size % 7 AS cognitive FROM part",
    # Hits and clones on the lines of documents.
    "sources": "SELECT concat('doc', doc_id) AS file, text FROM documents",
    "hits": "SELECT CASE event_id % 9 WHEN 0 THEN 'empty-catch' WHEN 1 THEN 'redundant-else' WHEN 2 THEN 'type-escape-any' WHEN 3 THEN 'passthrough-wrapper' ELSE 'console-only-catch' END AS rule, concat('doc', user_id) AS file, CAST(event_id % 11 + 1 AS int) AS line, CAST(event_id % 11 + 1 + event_id % 4 AS int) AS end_line, event_type AS symbol, CASE WHEN event_id % 5 = 0 THEN 'major' ELSE 'minor' END AS severity, concat('at ', event_id % 11 + 1) AS message FROM events",
    # A graph between suppliers.
    "nodes": "SELECT concat('src/s', s_suppkey, '.ts') AS file, s_suppkey % 3 = 0 AS is_types_module FROM supplier UNION ALL SELECT 'lint.config.ts', false UNION ALL SELECT 'src/.hidden.ts', false",
    "edges": "SELECT DISTINCT concat('src/s', s_suppkey, '.ts') AS src, concat('src/s', CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey - s_suppkey % 4 ELSE s_suppkey + 1 END, '.ts') AS dst FROM supplier WHERE s_suppkey % 5 <> 2 AND s_suppkey % 7 <> 3",
    # Imports written by suppliers' files.
    "refs": "SELECT concat('pkg', s_suppkey % 5, '/src/s', s_suppkey, '.ts') AS file, CASE s_suppkey % 8 WHEN 0 THEN concat('./s', s_suppkey + 5, '.js') WHEN 1 THEN concat('../../pkg', s_suppkey % 5, '/src/s', s_suppkey + 4) WHEN 2 THEN concat('lib', s_suppkey % 6, '/deep/path') WHEN 3 THEN concat('@scope/lib', s_suppkey % 6) WHEN 4 THEN 'fs/promises' WHEN 5 THEN '#internal/x' WHEN 6 THEN concat('@app/s', s_suppkey) ELSE '../../../outside' END AS specifier, CAST(s_suppkey % 20 + 1 AS int) AS line, s_suppkey % 3 = 0 AS type_only FROM supplier",
    "ref_files": "SELECT concat('pkg', s_suppkey % 5, '/src/s', s_suppkey, '.ts') AS file FROM supplier",
    # Renames and changes in the order of a log, newest first.
    "log": "SELECT CAST(p_partkey AS bigint) AS commit_pos, CAST(0 AS bigint) AS file_pos, concat('n', p_partkey * 7 % 50) AS path, CASE WHEN p_partkey % 3 = 0 THEN concat('n', p_partkey * 11 % 50) END AS previous_path FROM part",
    # Debt before and after a date.
    "debt_before": "SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'count' ELSE 'max' END AS kind, CASE l_suppkey % 4 WHEN 0 THEN 'knip' WHEN 2 THEN 'churn' ELSE 'metrics' END AS tool, CASE l_suppkey % 4 WHEN 0 THEN 'unused-export' WHEN 2 THEN 'hidden-coupling' ELSE 'function-length' END AS rule, concat('f', l_suppkey % 60, '.ts') AS file, CAST(count(*) AS double) AS value FROM lineitem WHERE l_shipdate < CAST('1995-06-01' AS date) AND l_suppkey % 11 <> 0 GROUP BY l_suppkey % 60, l_suppkey % 4, l_suppkey % 2",
    "debt_after": "SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'count' ELSE 'max' END AS kind, CASE l_suppkey % 4 WHEN 0 THEN 'knip' WHEN 2 THEN 'churn' ELSE 'metrics' END AS tool, CASE l_suppkey % 4 WHEN 0 THEN 'unused-export' WHEN 2 THEN 'hidden-coupling' ELSE 'function-length' END AS rule, concat('f', l_suppkey % 60, '.ts') AS file, CAST(count(*) AS double) AS value FROM lineitem WHERE l_shipdate >= CAST('1995-06-01' AS date) AND l_suppkey % 13 <> 0 GROUP BY l_suppkey % 60, l_suppkey % 4, l_suppkey % 2",
    "aggregates_before": "SELECT * FROM (VALUES ('erosion.fraction', 0.30), ('erosion.mass', 100.0), ('verbosity.fraction', 0.1), ('verbosity.lines', 10.0), ('cycles.count', 2.0), ('orphans.count', 1.0), ('duplication.percent', 2.0)) AS t(key, value)",
    "aggregates_after": "SELECT * FROM (VALUES ('erosion.fraction', 0.35), ('erosion.mass', 100.0), ('verbosity.fraction', 0.12), ('verbosity.lines', 12.0), ('cycles.count', 1.0), ('coupling.hidden.count', 3.0), ('duplication.percent', 2.0000005)) AS t(key, value)",
}


def _frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named stand-ins; a view is bound when a query is analysed, so views of another folder don't disturb it."""
    out = []
    for name in names:
        text = STAND_INS[name]
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        out.append(spark.sql(text))
    return out


def _with(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({STAND_INS[n]})" for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().lstrip("+")


CONFIG = Config()
LOOSE = resolve({"churn": {"minCoChangeCommits": 2, "minCoChangeDegree": 0.08}})
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, decimals: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits: shares are compared to six decimals, masses to two."""
    return df.withColumns({c: F.round(c, decimals) for c in columns})


# Measures


@_query("metrics_summary", _with("functions files", "SELECT f.*, fn.*, round(coalesce(em / nullif(tm, 0), 0), 6) AS erosion_fraction, round(tm, 2) AS total_mass, round(em, 2) AS eroded_mass FROM (SELECT count(*) AS file_count, CAST(sum(sloc) AS bigint) AS total_sloc, avg(function_count) AS functions_per_file FROM files) f, (SELECT count(*) AS function_count, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive, count(*) FILTER (WHERE cyclomatic > 10) AS over_cyclomatic, median(sloc) AS median_function_sloc, median(cyclomatic) AS median_cyclomatic FROM functions) fn, (SELECT sum(cyclomatic * sqrt(sloc)) AS tm, sum(cyclomatic * sqrt(sloc)) FILTER (WHERE cyclomatic > 10) AS em FROM functions) m").replace("SELECT f.*, fn.*, round", "SELECT file_count, total_sloc, functions_per_file, function_count, max_cyclomatic, max_cognitive, over_cyclomatic, median_function_sloc, median_cyclomatic, round"))
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, files = _frames(spark, sf_dir, "functions", "files")
    return _round(_round(metrics.summarize(files, functions, CONFIG), "erosion_fraction"), "total_mass", "eroded_mass", decimals=2)


@_query("erosion_by_file", _with("functions", "SELECT file, round(sum(cyclomatic * sqrt(sloc)), 2) AS total_mass, round(coalesce(sum(cyclomatic * sqrt(sloc)) FILTER (WHERE cyclomatic > 10), 0), 2) AS eroded_mass, round(coalesce(sum(cyclomatic * sqrt(sloc)) FILTER (WHERE cyclomatic > 10), 0) / sum(cyclomatic * sqrt(sloc)), 6) AS fraction FROM functions GROUP BY file"))
def erosion_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.erosion(_frames(spark, sf_dir, "functions")[0], 10, ["file"]), "fraction").withColumns({c: F.round(c, 2) for c in ("total_mass", "eroded_mass")})


@_query("median_by_file", _with("functions", "SELECT file, median(sloc) AS median_sloc, median(cyclomatic) AS median_cyclomatic FROM functions GROUP BY file"))
def median_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, "functions")[0].groupBy("file").agg(metrics.median_of("sloc").alias("median_sloc"), metrics.median_of("cyclomatic").alias("median_cyclomatic"))


_RULES_SQL = " UNION ALL ".join(f"SELECT file, line, symbol, '{r}' AS rule, CAST({c} AS double) AS value, CAST({CONFIG.thresholds[t]} AS double) AS threshold FROM functions WHERE {c} > {CONFIG.thresholds[t]}" for r, c, t in metrics.FUNCTION_RULES if CONFIG.is_on(r))
_LEVELS_SQL = "CASE rule " + " ".join(f"WHEN '{r}' THEN {CONFIG.report_level(r)}" for r in ("cyclomatic-complexity", "cognitive-complexity", "function-length", "file-length", "nesting-depth", "too-many-params")) + " END"
_SEVERITY_SQL = "CASE WHEN value / threshold <= 1.25 THEN 'minor' WHEN value / threshold <= 2 THEN 'major' ELSE 'critical' END"
_FINDINGS_SQL = f"+over_ AS ({_RULES_SQL} UNION ALL SELECT file, 1, NULL, 'file-length', CAST(sloc AS double), 330.0 FROM files WHERE sloc > 330), found AS (SELECT substr(sha1(concat('metrics|', rule, '|', file, '|', coalesce(symbol, ''))), 1, 12) AS id, rule, {_SEVERITY_SQL} AS severity, file, line, symbol, value, threshold, value <= {_LEVELS_SQL} AS below_report_threshold FROM over_) "
_FINDING_COLUMNS = ["id", "rule", "severity", "file", "line", "symbol", "value", "threshold", "below_report_threshold"]


def _threshold_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, files = _frames(spark, sf_dir, "functions", "files")
    return metrics.threshold_findings(files, functions, CONFIG)


@_query("threshold_findings", _with("functions files", _FINDINGS_SQL + "SELECT * FROM found"))
def threshold_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threshold_findings(spark, sf_dir).select(*_FINDING_COLUMNS)


@_query("findings_top", _with("functions files", _FINDINGS_SQL + "SELECT * FROM found WHERE NOT below_report_threshold ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END DESC, value / threshold DESC, id LIMIT 20"))
def findings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.top(findings.visible(_threshold_findings(spark, sf_dir)), 20).select(*_FINDING_COLUMNS)


@_query("findings_demoted", _with("functions files", _FINDINGS_SQL + "SELECT id, rule, file, below_report_threshold OR file IN (SELECT file FROM files WHERE sloc % 4 = 0) AS below_report_threshold FROM found"))
def findings_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = _frames(spark, sf_dir, "files")[0].where("sloc % 4 = 0")
    return findings.demote_dead(_threshold_findings(spark, sf_dir), dead, True).select("id", "rule", "file", "below_report_threshold")


@_query("debt", _with("functions files", _FINDINGS_SQL + "SELECT 'max' AS kind, 'metrics' AS tool, rule, file, max(value) AS value FROM found GROUP BY rule, file"))
def debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratchet.debt(_threshold_findings(spark, sf_dir))


# History


@_query("hotspots", _with("changes part_files", "SELECT c.file, commits, score FROM (SELECT file, count(*) AS commits FROM changes GROUP BY file) c JOIN (SELECT file, commits_score FROM (SELECT file, greatest(cyclomatic, cognitive) AS commits_score FROM part_files)) p ON c.file = p.file, LATERAL (SELECT commits * commits_score AS score) ORDER BY score DESC, c.file LIMIT 10"))
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, parts = _frames(spark, sf_dir, "changes", "part_files")
    return churn.top_hotspots(churn.hotspots(churn.churn(changes), parts, parts)).select("file", "commits", "score")


@_query("churn", _with("changes", "SELECT file, count(*) AS commits, CAST(sum(added_lines) AS bigint) AS added_lines, CAST(sum(deleted_lines) AS bigint) AS deleted_lines, min(date) AS first_change, max(date) AS last_change FROM changes GROUP BY file"))
def churn_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn(_frames(spark, sf_dir, "changes")[0])


@_query("churn_in_scope", _with("changes", "SELECT count(DISTINCT file) AS files, CAST(sum(added_lines) AS bigint) AS added_lines, CAST(sum(deleted_lines) AS bigint) AS deleted_lines, CAST(7 AS bigint) AS commits_scanned FROM changes WHERE regexp_matches(file, '^(.*/)?[^/]*\\.ts$') AND NOT regexp_matches(file, '\\.test\\.ts$')"))
def churn_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.summarize_churn(7, churn.churn(churn.in_scope(_frames(spark, sf_dir, "changes")[0], CONFIG)))


_PAIRS_SQL = "+h AS (SELECT commit, file FROM (SELECT DISTINCT commit, file, count(*) OVER (PARTITION BY commit) AS n FROM (SELECT DISTINCT commit, file FROM changes)) WHERE n BETWEEN 2 AND 20), n AS (SELECT file, count(*) AS n FROM h GROUP BY file HAVING count(*) >= 2), pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS together, na.n AS commits_a, nb.n AS commits_b, round(count(*) / least(na.n, nb.n), 6) AS degree FROM h a JOIN h b ON a.commit = b.commit AND a.file < b.file JOIN n na ON na.file = a.file JOIN n nb ON nb.file = b.file GROUP BY a.file, b.file, na.n, nb.n HAVING count(*) >= 2 AND count(*) / least(na.n, nb.n) >= 0.08) "


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.co_changes(churn.histories(_frames(spark, sf_dir, "changes")[0], LOOSE), LOOSE)


@_query("co_changes", _with("changes", _PAIRS_SQL + "SELECT * FROM pairs"))
def co_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pairs(spark, sf_dir), "degree")


@_query("coupling_findings", _with("changes", _PAIRS_SQL + "SELECT substr(sha1(concat('churn|hidden-coupling|', file_a, '|', file_b)), 1, 12) AS id, file_a AS file, file_b AS symbol, floor(degree * 100 + 0.5) AS value, CASE WHEN floor(degree * 100 + 0.5) / 8 <= 1.25 THEN 'minor' WHEN floor(degree * 100 + 0.5) / 8 <= 2 THEN 'major' ELSE 'critical' END AS severity FROM pairs"))
def coupling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _round(_pairs(spark, sf_dir), "degree").withColumn("linked", F.lit(False))
    return churn.coupling_findings(pairs, LOOSE).select("id", "file", "symbol", "value", "severity")


_NAMED_PAIRS = "SELECT DISTINCT concat('src/s', a.s_suppkey, '.ts') AS file_a, concat('src/s', b.s_suppkey, '.ts') AS file_b FROM supplier a JOIN supplier b ON b.s_suppkey BETWEEN a.s_suppkey + 1 AND a.s_suppkey + 4"


@_query("linked_pairs", _with("nodes edges", f"+ab AS ({_NAMED_PAIRS}), two AS (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src), shared AS (SELECT a.src AS x, b.src AS y FROM edges a JOIN edges b ON a.dst = b.dst JOIN nodes n ON n.file = a.dst AND n.is_types_module) SELECT ab.*, EXISTS (SELECT 1 FROM two WHERE (src = file_a AND dst = file_b) OR (src = file_b AND dst = file_a)) OR EXISTS (SELECT 1 FROM shared WHERE x = file_a AND y = file_b) AS linked FROM ab"))
def linked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _frames(spark, sf_dir, "nodes", "edges")
    return churn.linked_pairs(spark.sql(_NAMED_PAIRS), edges, nodes)


@_query("current_paths", _with("log", "+r AS (SELECT commit_pos AS pos, previous_path AS old, path AS new FROM log WHERE previous_path IS NOT NULL AND previous_path <> path), parent AS (SELECT r.pos, r.new, (SELECT max(q.pos) FROM r q WHERE q.old = r.new AND q.pos < r.pos) AS up FROM r), chain AS (WITH RECURSIVE c(pos, new, up) AS (SELECT pos, new, up FROM parent UNION ALL SELECT c.pos, p.new, p.up FROM c JOIN parent p ON p.pos = c.up) SELECT pos, new FROM c WHERE up IS NULL), used AS (SELECT log.*, (SELECT max(r.pos) FROM r WHERE r.old = log.path AND r.pos < log.commit_pos) AS by_ FROM log) SELECT commit_pos, path, coalesce(chain.new, path) AS file FROM used LEFT JOIN chain ON chain.pos = used.by_"))
def current_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.current_paths(_frames(spark, sf_dir, "log")[0]).select("commit_pos", "path", "file")


@_query("git_log", "SELECT o.o_orderkey AS log_id, CAST(0 AS bigint) AS commit_pos, concat('h', o.o_orderkey) AS hash, concat('d', o.o_custkey) AS date, CASE WHEN o.o_orderkey % 5 = 0 THEN concat('new', o.o_orderkey) ELSE concat('p\tq', o.o_custkey) END AS path, CASE WHEN o.o_orderkey % 5 = 0 THEN concat('old', o.o_orderkey) END AS previous_path, CASE WHEN o.o_orderkey % 7 = 0 THEN 0 ELSE o.o_custkey END AS added_lines, CAST(CASE WHEN o.o_orderkey % 7 = 0 THEN 0 ELSE 3 END AS bigint) AS deleted_lines, o.o_orderkey % 7 = 0 AS binary FROM orders o")
def git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    counts = F.when(key % 7 == 0, F.lit("-\t-")).otherwise(F.concat_ws("\t", who.cast("string"), F.lit("3")))
    path = F.when(key % 5 == 0, F.concat(F.lit("\t\0old"), key, F.lit("\0new"), key)).otherwise(F.concat(F.lit("\tp\tq"), who))
    record = F.concat(F.lit("\x01h"), key, F.lit("\x1fd"), who, F.lit("\0\n"), counts, path, F.lit("\0"))
    # A log of its own for each commit: one text of all would be a single row.
    logs = orders.select(key.alias("log_id"), record.alias("raw"))
    parsed = gitlog.changes(gitlog.parse_log(logs, by="log_id"))
    return parsed.select("log_id", "commit_pos", "hash", "date", "path", "previous_path", "added_lines", "deleted_lines", "binary")


_HISTORY_SQL = "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS commit_pos FROM orders), r AS (SELECT k, c, commit_pos, CAST(1 AS bigint) AS place, NULL AS path, NULL AS previous_path, CAST(NULL AS bigint) AS added_lines, CAST(NULL AS bigint) AS deleted_lines, CAST(NULL AS boolean) AS binary FROM o UNION ALL SELECT k, c, commit_pos, 2, concat('p\tq', c), NULL, CASE WHEN k % 7 = 0 THEN 0 ELSE c END, CASE WHEN k % 7 = 0 THEN 0 ELSE 3 END, k % 7 = 0 FROM o WHERE k % 11 <> 0 UNION ALL SELECT k, c, commit_pos, 3, concat('new', k), concat('old', k), 1, 2, false FROM o WHERE k % 11 <> 0 AND k % 5 = 0) "


@_query("git_histories", _HISTORY_SQL + "SELECT c AS log_id, commit_pos, place, concat('h', k) AS hash, concat('d', k) AS date, path, previous_path, added_lines, deleted_lines, r.binary FROM r")
def git_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders: a log for each customer, a commit for each order, newest first; every 11th key has no changes."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    counts = F.when(key % 7 == 0, F.lit("-\t-")).otherwise(F.concat_ws("\t", who.cast("string"), F.lit("3")))
    renamed = F.when(key % 5 == 0, F.concat(F.lit("1\t2\t\0old"), key, F.lit("\0new"), key, F.lit("\0"))).otherwise("")
    body = F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("\n"), counts, F.lit("\tp\tq"), who, F.lit("\0"), renamed))
    record = F.concat(F.lit("\x01h"), key, F.lit("\x1fd"), key, F.lit("\0"), body)
    # A log is as long as a customer has orders.
    commits = F.sort_array(F.collect_list(F.struct(key.alias("key"), record.alias("record"))), asc=False)
    logs = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(who.alias("log_id")).agg(F.array_join(commits["record"], "").alias("raw"))
    placed = gitlog.parse_log(logs, by="log_id").withColumn("place", F.row_number().over(Window.partitionBy("log_id", "commit_pos").orderBy("file_pos")).cast("long"))
    return placed.select("log_id", "commit_pos", "place", "hash", "date", "path", "previous_path", "added_lines", "deleted_lines", "binary")



@_query("window_start", "SELECT event_id, strftime(ts - INTERVAL 365 DAY, '%Y-%m-%d') AS start FROM events")
def window_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", gitlog.window_start_column(365, F.col("ts")).alias("start"))


# Lines


@_query("file_sloc", _with("sources", "SELECT file, CAST(len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\s\\x{00a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]'))) AS int) AS sloc FROM sources"))
def file_sloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_sloc(_frames(spark, sf_dir, "sources")[0])


_LINES_SQL = "+l AS (SELECT file, i AS line FROM sources, unnest(generate_series(1, len(string_split(text, chr(10))))) AS t(i) WHERE regexp_matches(string_split(text, chr(10))[i], '\\S')) "


@_query("sloc_lines", _with("sources", _LINES_SQL + "SELECT file, line FROM l"))
def sloc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sloc_lines(_frames(spark, sf_dir, "sources")[0]).withColumn("line", F.col("line").cast("long"))


_VERBOSE_SQL = ", ".join(f"'{r}'" for r in slop.VERBOSE)


@_query("verbosity", _with("sources hits", _LINES_SQL + f", c AS (SELECT DISTINCT file, i AS line FROM hits, unnest(generate_series(line, end_line)) AS t(i) WHERE rule IN ({_VERBOSE_SQL}) UNION SELECT file, line FROM l WHERE line % 10 = 0) SELECT count(*) AS verbose_lines, (SELECT count(*) FROM l) AS total_sloc, round(count(*) / (SELECT count(*) FROM l), 6) AS fraction FROM c SEMI JOIN l USING (file, line)"))
def verbosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, hits = _frames(spark, sf_dir, "sources", "hits")
    lines = metrics.sloc_lines(sources)
    return _round(slop.verbosity(hits, lines, lines.where("line % 10 = 0")), "fraction")


@_query("slop_findings", _with("hits", "SELECT substr(sha1(concat('metrics|', rule, '|', file, '|', symbol)), 1, 12) AS id, rule, file, symbol, min(line) AS line, CAST(count(*) AS double) AS value, CASE WHEN bool_or(severity = 'major') THEN 'major' ELSE 'minor' END AS severity FROM hits GROUP BY rule, file, symbol"))
def slop_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slop.slop_findings(_frames(spark, sf_dir, "hits")[0]).select("id", "rule", "file", "symbol", "line", "value", "severity")


@_query("hits_by_rule", _with("hits", "SELECT rule, count(*) AS n FROM hits GROUP BY rule"))
def hits_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slop.hits_by_rule(_frames(spark, sf_dir, "hits")[0]).select(F.explode("hits_by_rule").alias("rule", "n"))


@_query("type_escapes", _with("hits", "SELECT count(*) FILTER (WHERE rule LIKE 'type-escape-%') AS type_escapes FROM hits"))
def type_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slop.escapes(_frames(spark, sf_dir, "hits")[0])


_SILENT = "SELECT concat('doc', doc_id) AS file, concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN '  // @ts-ignore x' WHEN 1 THEN ' * @ts-nocheck' WHEN 2 THEN '// @ts-expect-error' ELSE 'x // @ts-ignore' END) AS text FROM documents"


@_query("silencing_comments", f"WITH s AS ({_SILENT}), l AS (SELECT file, i AS line, string_split(text, chr(10))[i] AS source FROM s, unnest(generate_series(1, len(string_split(text, chr(10))))) AS t(i)) SELECT 'type-escape-comment' AS rule, file, line, concat('@ts-', regexp_extract(source, '@ts-(ignore|nocheck)', 1), ' hides compile errors') AS message FROM l WHERE regexp_matches(source, '^\\s*(//|/\\*+|\\*)\\s*@ts-(ignore|nocheck)\\b')")
def silencing_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return slop.silencing_comments(spark.sql(_SILENT.replace("chr(10)", "char(10)"))).select("rule", "file", F.col("line").cast("long").alias("line"), "message")


#: Windows of three lines and runs of twenty tokens, so that invented prose has clones.
_CLONE_SIZE, _CLONE_TOKENS = 3, 20
_CLONES_SQL = """
+l AS (SELECT file, i AS line, regexp_replace(string_split(text, chr(10))[i], '^\\s+|\\s+$', '', 'g') AS s
       FROM sources, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i)),
k AS (SELECT file, line, s, row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS pos,
             len(regexp_extract_all(s, '[A-Za-z0-9_$]+|[^\\sA-Za-z0-9_$]')) AS n FROM l WHERE s <> ''),
t AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY line) AS upto FROM k),
w AS (SELECT file, pos, line, upto - n AS before, last_value(line) OVER x AS end_line, last_value(upto) OVER x AS after,
             count(*) OVER x AS c, string_agg(s, chr(10)) OVER x AS body FROM t
      WINDOW x AS (PARTITION BY file ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
g AS (SELECT body, min({'file': file, 'pos': pos}) AS first FROM w WHERE c = 3 GROUP BY body HAVING count(*) > 1),
p AS (SELECT a.file AS first_file, a.line AS first_line, a.end_line AS first_end_line, a.pos AS first_pos, w.*,
             w.pos - a.pos AS d
      FROM w JOIN g USING (body) JOIN w a ON a.file = g.first.file AND a.pos = g.first.pos
      WHERE w.c = 3 AND (w.file <> a.file OR w.pos <> a.pos)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY first_file, file, d ORDER BY pos) AS island FROM p)
SELECT first_file, min(first_line) AS first_start, max(first_end_line) AS first_end, file, min(line) AS start,
       max(end_line) AS "end", max(end_line) - min(line) + 1 AS lines, CAST(max(after) - min(before) AS bigint) AS tokens
FROM r GROUP BY first_file, file, d, island HAVING max(after) - min(before) >= 20
"""


@_query("clones", _with("sources", _CLONES_SQL))
def clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplication.clones(duplication.windows(_frames(spark, sf_dir, "sources")[0], _CLONE_SIZE), _CLONE_TOKENS)
    return found.withColumns({c: F.col(c).cast("long") for c in ("first_start", "first_end", "start", "end", "lines", "tokens")})


_CLONES = "SELECT named_struct('file', concat('doc', doc_id), 'start', CAST(doc_id % 9 + 1 AS int), 'end', CAST(doc_id % 9 + 6 AS int)) AS first, named_struct('file', concat('doc', doc_id + 1), 'start', CAST(doc_id % 5 + 1 AS int), 'end', CAST(doc_id % 5 + 6 AS int)) AS second, 6 AS lines FROM documents"


@_query("clone_lines", "WITH s AS (SELECT concat('doc', doc_id) AS file, doc_id % 9 + 1 AS a FROM documents UNION ALL SELECT concat('doc', doc_id + 1), doc_id % 5 + 1 FROM documents) SELECT DISTINCT file, a + i AS line FROM s, range(6) AS t(i)")
def clone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return duplication.covered_lines(spark.sql(_CLONES)).withColumn("line", F.col("line").cast("long"))


@_query("clone_findings", "SELECT substr(sha1(concat('jscpd|duplicate-block|', f, '|', s, ':', b)), 1, 12) AS id, f AS file, a AS line, CAST(6 AS double) AS value, 'minor' AS severity FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN concat('doc', doc_id + 1) ELSE concat('doc', doc_id) END AS f, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 1 ELSE doc_id % 9 + 1 END AS a, CASE WHEN doc_id % 3 = 0 THEN concat('doc', doc_id) ELSE concat('doc', doc_id + 1) END AS s, CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 + 1 ELSE doc_id % 5 + 1 END AS b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents))")
def clone_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.createOrReplaceTempView("documents")
    known = docs.select(F.concat(F.lit("doc"), "doc_id").alias("file"))
    kept = duplication.in_scope(spark.sql(_CLONES), known, docs.where("doc_id % 3 = 0").select(F.concat(F.lit("doc"), "doc_id").alias("file")))
    return duplication.clone_findings(kept).select("id", "file", F.col("line").cast("long").alias("line"), "value", "severity")


# Specifiers and paths


@_query("specifiers", _with("refs", "SELECT file, specifier, CASE WHEN starts_with(specifier, '.') THEN 'relative' WHEN starts_with(specifier, '/') THEN 'absolute' WHEN starts_with(specifier, 'node:') THEN 'builtin' WHEN starts_with(specifier, '#') THEN 'subpath' WHEN split_part(specifier, '/', 1) = 'fs' THEN 'builtin' ELSE 'bare' END AS kind, CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE split_part(specifier, '/', 1) END AS package, concat('@types/', CASE WHEN starts_with(specifier, '@') THEN replace(substr(array_to_string(string_split(specifier, '/')[1:2], '/'), 2), '/', '__') ELSE split_part(specifier, '/', 1) END) AS types_package FROM refs"))
def specifiers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("specifier")
    package = specifiers.package_of(s)
    return _frames(spark, sf_dir, "refs")[0].select("file", "specifier", specifiers.kind_of(s).alias("kind"), package.alias("package"), specifiers.types_package_of(package).alias("types_package"))


_PATHS = "SELECT page_id, concat('a', page_id % 3, CASE page_id % 4 WHEN 0 THEN '/b/../c' WHEN 1 THEN '/./d/' WHEN 2 THEN '/../../e' ELSE '/f/../../g' END) AS raw FROM pages"


@_query("normalized_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('a', page_id % 3, '/c') WHEN 1 THEN concat('a', page_id % 3, '/d') WHEN 2 THEN NULL ELSE 'g' END AS path FROM pages")
def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    return spark.sql(_PATHS).select("page_id", specifiers.normalize(F.col("raw")).alias("path"))


GLOBS = ["**/en/*", "*/**/1*.html", "http?://www.*.com/**"]


@_query("globs", "SELECT page_id, regexp_matches(url, '^(?:[^/]*/)*en/[^/]*$') OR regexp_matches(url, '^[^/]*/(?:[^/]*/)*1[^/]*\\.html$') OR regexp_matches(url, '^http[^/]://www\\.[^/]*\\.com/.*$') AS matched FROM pages")
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", globs.matches_any(F.col("url"), GLOBS).alias("matched"))


_RESOLVE_SQL = "+t AS (SELECT file, specifier, line, CASE WHEN starts_with(specifier, './') THEN concat(regexp_extract(file, '^(.*)/[^/]*$', 1), substr(regexp_replace(specifier, '\\.js$', ''), 2), '.ts') WHEN starts_with(specifier, '../../pkg') THEN concat(substr(specifier, 7), '.ts') WHEN starts_with(specifier, '@app/') THEN concat('pkg', CAST(substr(specifier, 7) AS int) % 5, '/src/', substr(specifier, 6), '.ts') END AS guess FROM refs), res AS (SELECT t.file, specifier, line, f.file AS target FROM t LEFT JOIN ref_files f ON f.file = guess) "


def _mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "@app/*", [f"./pkg{k}/src/*" for k in range(5)], "")], "at int, pattern string, targets array<string>, base_url string")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, files = _frames(spark, sf_dir, "refs", "ref_files")
    return imports.resolve(refs, files, _mappings(spark))


@_query("resolved_imports", _with("refs ref_files", _RESOLVE_SQL + "SELECT file, specifier, target FROM res"))
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("file", "specifier", "target")


@_query("import_edges", _with("refs ref_files", _RESOLVE_SQL + "SELECT DISTINCT file AS src, target AS dst FROM res WHERE target IS NOT NULL AND target <> file"))
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, files = _frames(spark, sf_dir, "refs", "ref_files")
    return imports.build_graph(refs, files, _mappings(spark))


@_query("unresolved_imports", _with("refs ref_files", _RESOLVE_SQL + "SELECT substr(sha1(concat('imports|unresolved-import|', file, '|', specifier)), 1, 12) AS id, file, specifier AS symbol, line, 'critical' AS severity FROM res WHERE target IS NULL AND starts_with(specifier, '.') AND NOT (starts_with(specifier, '..') AND file LIKE 'pkg0/%')"))
def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved(spark, sf_dir)
    base = specifiers.resolve_relative(F.col("file"), F.col("specifier"))
    there = resolved.where("file like 'pkg0/%' and specifier like '../../pkg%'").select(F.concat(base, F.lit("/index.json")).alias("file"))
    outside = resolved.where("not (specifier like '../../../%' and file like 'pkg0/%')")
    return imports.unresolved_findings(imports.unresolved(outside, there)).select("id", "file", "symbol", "line", "severity")


_MANIFESTS = "SELECT * FROM (VALUES ('', array('lib1', 'lib2', '@types/lib3'), array('#internal/*'), array('@app/*'), true), ('pkg1', array('@scope/lib1', '@types/scope__lib3'), array(), array(), true), ('pkg2', array(), array(), array(), false)) AS t(dir, dependencies, subpaths, aliases, trustworthy)"


@_query("governing_manifest", _with("ref_files", "SELECT file, CASE WHEN file LIKE 'pkg1/%' THEN 'pkg1' WHEN file LIKE 'pkg2/%' THEN 'pkg2' ELSE '' END AS dir FROM ref_files"))
def governing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.governing(_frames(spark, sf_dir, "ref_files")[0], spark.sql(_MANIFESTS))


@_query("undeclared_packages", _with("refs", "+p AS (SELECT *, CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE split_part(specifier, '/', 1) END AS package, CASE WHEN file LIKE 'pkg1/%' THEN 'pkg1' WHEN file LIKE 'pkg2/%' THEN 'pkg2' ELSE '' END AS dir FROM refs WHERE NOT starts_with(specifier, '.') AND specifier <> 'fs/promises'), q AS (SELECT *, CASE WHEN dir = '' THEN package IN ('lib1', 'lib2') OR starts_with(specifier, '@app/') OR starts_with(specifier, '#internal/') OR (type_only AND package = 'lib3') ELSE package = '@scope/lib1' OR (type_only AND package = '@scope/lib3') END AS declared FROM p WHERE dir <> 'pkg2') SELECT substr(sha1(concat('imports|', CASE WHEN package = 'lib4' OR (package = '@scope/lib5' AND file LIKE 'pkg3/%') THEN 'unlisted-dependency' ELSE 'unknown-dependency' END, '|', file, '|', package)), 1, 12) AS id, CASE WHEN package = 'lib4' OR (package = '@scope/lib5' AND file LIKE 'pkg3/%') THEN 'unlisted-dependency' ELSE 'unknown-dependency' END AS rule, CASE WHEN package = 'lib4' OR (package = '@scope/lib5' AND file LIKE 'pkg3/%') THEN 'major' ELSE 'critical' END AS severity, file, line, package AS symbol FROM q WHERE NOT declared"))
def undeclared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    installed = spark.createDataFrame([("", "lib4"), ("pkg3", "@scope/lib5")], "dir string, package string")
    found = imports.undeclared(_frames(spark, sf_dir, "refs")[0], spark.sql(_MANIFESTS), installed)
    return imports.undeclared_findings(found).select("id", "rule", "severity", "file", "line", "symbol")


@_query("imports_summary", _with("refs ref_files", _RESOLVE_SQL + "SELECT (SELECT count(*) FROM ref_files) AS files, (SELECT count(*) FROM (SELECT DISTINCT file, target FROM res WHERE target IS NOT NULL AND target <> file)) AS edges, (SELECT count(DISTINCT CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE split_part(specifier, '/', 1) END) FROM refs WHERE NOT starts_with(specifier, '.') AND NOT starts_with(specifier, '#') AND specifier <> 'fs/promises') AS external_packages, CAST(0 AS bigint) AS unknown, CAST(0 AS bigint) AS unlisted, count(*) FILTER (WHERE target IS NULL AND starts_with(specifier, '.')) AS unresolved FROM res"))
def imports_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, files = _frames(spark, sf_dir, "refs", "ref_files")
    resolved = imports.resolve(refs, files, _mappings(spark))
    found = resolved.where("target is null").where(specifiers.kind_of(F.col("specifier")) == "relative")
    return imports.summarize(refs, resolved, imports.unresolved_findings(found), files)


@_query("vendored", _with("refs ref_files", "SELECT dir, count(*) AS files FROM (SELECT 'pkg3' AS dir UNION ALL SELECT 'pkg4') d JOIN ref_files ON starts_with(file, concat(dir, '/')) WHERE dir NOT IN (SELECT 'pkg4' FROM refs WHERE starts_with(specifier, 'lib4') AND NOT starts_with(file, 'pkg4/')) GROUP BY dir"))
def vendored(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, files = _frames(spark, sf_dir, "refs", "ref_files")
    dirs = spark.createDataFrame([(f"pkg{k}",) for k in (0, 3, 4)], "dir string")
    names = spark.createDataFrame([("pkg4", "lib4")], "dir string, package string")
    found = imports.vendored(dirs, ["pkg0"], refs, files, names)
    left = imports.without_vendored(files, found)
    gone = files.join(left, "file", "left_anti").select(F.explode(globs.ancestors(F.col("file"))).alias("dir"))
    return gone.join(found, "dir", "left_semi").groupBy("dir").agg(F.count("*").alias("files"))


# Graph

_REACH_SQL = "+e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND dst IN (SELECT file FROM nodes)), reach AS (WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT a, b FROM r) "


@_query("components", _with("nodes edges", _REACH_SQL + "SELECT n.file, coalesce(least(n.file, min(x.b)), n.file) AS component FROM nodes n LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a) x ON x.a = n.file GROUP BY n.file"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _frames(spark, sf_dir, "nodes", "edges")
    return graph.strongly_connected(edges, nodes)


@_query("cycles", _with("nodes edges", _REACH_SQL + "SELECT component, count(*) AS size, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT r.a AS file, least(r.a, min(r.b)) AS component FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.a) GROUP BY component HAVING count(*) > 1"))
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _frames(spark, sf_dir, "nodes", "edges")
    return graph.cycles(edges, nodes).select("component", "size", F.array_join("files", ",").alias("files"))


@_query("orphans", _with("nodes edges", _REACH_SQL + "SELECT file FROM nodes WHERE file NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AND NOT regexp_matches(file, '(^|/)(\\.[^/]+|[^/]+\\.config)\\.[cm]?tsx?$') AND file NOT LIKE '%7.ts'"))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _frames(spark, sf_dir, "nodes", "edges")
    return graph.orphans(edges, nodes, nodes.where("file like '%7.ts'"))


@_query("runtime_cycles", _with("nodes edges", "+f AS (SELECT * FROM edges WHERE NOT regexp_matches(src, 's([1-5]8|[79]9)\\.ts$')), e AS (SELECT src, dst FROM f WHERE dst IN (SELECT file FROM nodes)), reach AS (WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT a, b FROM r) SELECT a AS file, least(a, min(b)) AS component FROM (SELECT r.a, r.b FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a) GROUP BY a"))
def runtime_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _frames(spark, sf_dir, "nodes", "edges")
    refs = edges.select("src", "dst", (~F.col("src").rlike("s[1-5]8\\.ts$")).alias("survives_emit"), F.when(F.col("src").rlike("s[79]9\\.ts$"), "dynamic").otherwise("import").alias("kind"))
    found = graph.cycles(graph.runtime_edges(refs, nodes), nodes)
    return found.select(F.explode("files").alias("file"), "component")


@_query("unused_files", _with("nodes edges", "+e AS (SELECT src, dst FROM edges), r AS (WITH RECURSIVE r(f) AS (SELECT file FROM nodes WHERE file LIKE '%1.ts' UNION SELECT e.dst FROM r JOIN e ON e.src = r.f) SELECT f FROM r) SELECT file FROM nodes WHERE file NOT IN (SELECT f FROM r)"))
def unused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _frames(spark, sf_dir, "nodes", "edges")
    return deadcode.unused_files(nodes, edges, nodes.where("file like '%1.ts'"))


@_query("type_modules", "SELECT concat('s', s_suppkey % 30) AS file, bool_or(s_suppkey % 2 = 0) AND NOT bool_or(s_suppkey % 9 = 0) AS is_types_module FROM supplier GROUP BY s_suppkey % 30")
def type_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('s', s_suppkey % 30) AS file", "s_suppkey % 2 = 0 AS declares_type", "s_suppkey % 9 = 0 AS emits_value")
    return imports.type_modules(rows)


# Dead code

_REPORT_JSON = "concat('noise {\"issues\":[{\"file\":\"src/p', p_partkey, '.ts\",\"files\":', CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'false' END, ',\"exports\":[{\"name\":\"e', p_size, '\",\"line\":', p_size, '},{\"line\":3},7]', CASE WHEN p_partkey % 2 = 0 THEN ',\"types\":[{\"name\":\"t\"}]' ELSE ',\"dependencies\":[{\"name\":\"d\",\"line\":1}],\"unresolved\":[{\"name\":\"u\"}]' END, '}, 5, {\"file\":\"\"}]} tail')"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(_REPORT_JSON).alias("json"))
    return deadcode.entries(deadcode.read_report(rows))


_ENTRIES_SQL = "x AS (SELECT concat('src/p', p_partkey, '.ts') AS file, p_partkey AS k, p_size AS s FROM part), e AS (SELECT file, 'unused-file' AS rule, 'major' AS severity, NULL AS name, NULL AS line FROM x WHERE k % 5 = 0 UNION ALL SELECT file, 'unused-export', 'major', concat('e', s), s FROM x UNION ALL SELECT file, 'unused-export', 'major', '#anonyme', 3 FROM x UNION ALL SELECT file, 'unused-type', 'major', 't', NULL FROM x WHERE k % 2 = 0 UNION ALL SELECT file, 'unused-dependency', 'major', 'd', 1 FROM x WHERE k % 2 = 1 UNION ALL SELECT file, 'unresolved-import', 'critical', 'u', NULL FROM x WHERE k % 2 = 1) "


@_query("dead_code_entries", "WITH " + _ENTRIES_SQL + "SELECT * FROM e")
def dead_code_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@_query("dead_code_findings", "WITH " + _ENTRIES_SQL + "SELECT substr(sha1(concat('knip|', rule, '|', file, '|', coalesce(name, ''))), 1, 12) AS id, rule, severity, file, line, name AS symbol FROM e WHERE rule <> 'unused-type' AND file LIKE '%7.ts'")
def dead_code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir)
    scope = rows.where("file like '%7.ts'").select("file")
    return deadcode.report_findings(deadcode.in_scope(rows, scope), CONFIG).select("id", "rule", "severity", "file", "line", "symbol")


@_query("dead_code_summary", "WITH " + _ENTRIES_SQL + "SELECT count(*) FILTER (WHERE rule = 'unused-file') AS unused_files, count(*) FILTER (WHERE rule = 'unused-export') AS unused_exports, count(*) FILTER (WHERE rule = 'unused-dependency') AS unused_dependencies FROM e")
def dead_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.summarize(deadcode.report_findings(_report(spark, sf_dir), CONFIG), CONFIG).drop("unused_types")


@_query("dead_code_judged", "WITH " + _ENTRIES_SQL + ", j AS (SELECT count(*) FILTER (WHERE rule = 'unused-file') >= 10 AND count(*) FILTER (WHERE rule = 'unused-file') / 10.0 > (SELECT count(*) FROM part) * 0.033 AS bad FROM e) SELECT rule, count(*) AS n FROM e, j WHERE rule <> 'unused-type' AND (NOT bad OR rule NOT IN ('unused-file', 'unused-export', 'unused-dependency')) GROUP BY rule")
def dead_code_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deadcode.report_findings(_report(spark, sf_dir), CONFIG)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    return deadcode.judged(found, parts, CONFIG)[0].groupBy("rule").agg(F.count("*").alias("n"))


@_query("export_origins", "SELECT concat('f', p_partkey % 50) AS file, concat('n', p_partkey) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'reexport' WHEN p_partkey % 4 = 1 THEN 'local-usage' WHEN p_partkey % 4 = 2 AND p_partkey % 50 % 2 = 0 THEN 'reexport' ELSE 'dead' END AS origin FROM part")
def export_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('f', p_partkey % 50) AS file", "concat('n', p_partkey) AS name", "p_partkey AS k")
    identifiers = part.where("k % 4 in (1, 3)").selectExpr("file", "name", "k % 4 = 3 AS is_name_position")
    whole = part.where("k % 50 % 2 = 0").selectExpr("file", "cast(null as string) AS name").distinct()
    return deadcode.export_origins(part, identifiers, part.where("k % 4 = 0").select("file", "name").union(whole))


# Ratchet

@_query("debt_comparison", _with("debt_before debt_after", "SELECT kind, tool, rule, file, a.value AS before, b.value AS after, CASE WHEN a.value IS NULL THEN CASE WHEN file IN (SELECT file FROM debt_before) THEN 'new-entry' ELSE 'new-file' END WHEN b.value IS NULL THEN CASE WHEN tool IN ('metrics', 'churn') THEN 'improvement' ELSE 'skipped' END WHEN b.value > a.value THEN 'increase' WHEN b.value < a.value THEN 'improvement' ELSE 'unchanged' END AS verdict FROM debt_before a FULL JOIN debt_after b USING (kind, tool, rule, file)"))
def debt_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _frames(spark, sf_dir, "debt_before", "debt_after")
    return ratchet.compare_debt(before, after, ["metrics", "churn"])


_AGGREGATE_VERDICT = "CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'skipped' WHEN b.value > a.value + 1e-6 THEN CASE WHEN key = 'erosion.fraction' THEN 'diluted' ELSE 'regression' END WHEN b.value < a.value - 1e-6 THEN 'improvement' ELSE 'unchanged' END"


def _aggregates(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [f.withColumn("value", F.col("value").cast("double")) for f in _frames(spark, sf_dir, "aggregates_before", "aggregates_after")]


@_query("aggregate_comparison", _with("aggregates_before aggregates_after", f"SELECT key, CAST(a.value AS double) AS before, CAST(b.value AS double) AS after, {_AGGREGATE_VERDICT} AS verdict FROM aggregates_before a FULL JOIN aggregates_after b USING (key)"))
def aggregate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratchet.compare_aggregates(*_aggregates(spark, sf_dir))


@_query("ratchet", _with("debt_before debt_after aggregates_before aggregates_after", "+d AS (SELECT kind, tool, rule, file, concat(tool, '|', rule, '|', file) AS key, a.value AS before, b.value AS after, kind = 'count' AND rule = 'hidden-coupling' AS unmeasured FROM debt_before a FULL JOIN debt_after b USING (kind, tool, rule, file)), v AS (SELECT kind, key, CASE WHEN before IS NULL THEN CASE WHEN file IN (SELECT file FROM debt_before WHERE NOT (kind = 'count' AND rule = 'hidden-coupling')) THEN 'new-entry' ELSE 'new-file' END WHEN after IS NULL THEN CASE WHEN tool = 'knip' THEN 'skipped' ELSE 'improvement' END WHEN after > before THEN 'increase' WHEN after < before THEN 'improvement' ELSE 'unchanged' END AS verdict FROM d WHERE NOT unmeasured UNION ALL SELECT kind, key, 'skipped' FROM d WHERE unmeasured UNION ALL SELECT 'aggregate', key, " + _AGGREGATE_VERDICT + " FROM aggregates_before a FULL JOIN aggregates_after b USING (key)) SELECT kind, verdict, count(*) AS n FROM v GROUP BY kind, verdict"))
def ratchet_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _frames(spark, sf_dir, "debt_before", "debt_after")
    a, b = _aggregates(spark, sf_dir)
    scope = {"include": [], "exclude": [], "import_rules": ratchet.IMPORT_RULES, "gitignore": True, "rules": []}
    one, two = (ratchet.Snapshot(d, g, {}, scope, "1") for d, g in ((before, a), (after, b)))
    return ratchet.compare(one, two).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@_query("findings_behind", _with("functions files", _FINDINGS_SQL + "SELECT id, rule, file FROM found WHERE rule = 'function-length' AND file LIKE '%3.ts'"))
def findings_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _threshold_findings(spark, sf_dir)
    keys = ratchet.debt(found).where("rule = 'function-length' and file like '%3.ts'")
    verdicts = keys.select(F.concat_ws("|", "tool", "rule", "file").alias("key"), F.lit("increase").alias("verdict"))
    return ratchet.findings_behind(found, verdicts).select("id", "rule", "file")


@_query("rounded", "SELECT c_custkey, floor(abs(c_acctbal) / 7 * 1000000 + 0.5) / 1000000.0 AS value FROM customer")
def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ratchet.rounded(F.abs("c_acctbal") / 7).cast("double").alias("value"))


def _severity_column() -> Column:
    return findings.severity_of(F.col("value"), F.col("threshold"))


@_query("severities", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 'critical' WHEN l_quantity / (l_linenumber % 5) <= 1.25 THEN 'minor' WHEN l_quantity / (l_linenumber % 5) <= 2 THEN 'major' ELSE 'critical' END AS severity FROM lineitem")
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"), (F.col("l_linenumber") % 5).alias("threshold"))
    return rows.select("l_orderkey", "l_linenumber", _severity_column().alias("severity"))


@_query("precision", "SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'useful' WHEN quality = 1 THEN 'exact' ELSE 'wrong' END AS verdict FROM labels) GROUP BY verdict")
def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "useful").when(F.col("quality") == 1, "exact").otherwise("wrong")
    counts = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("verdict", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row of totals


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
