"""Dead code: reports of an outside tool as findings, and native reachability from entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.config import Config
from codestrata.functions import globs, specifiers
from codestrata.operators import findings
from codestrata.plans.lineage import written

#: A report's lists, the rule and severity of their entries.
KINDS = [
    ("exports", "unused-export", "major"),
    ("types", "unused-type", "major"),
    ("dependencies", "unused-dependency", "major"),
    ("devDependencies", "unused-dependency", "major"),
    ("unlisted", "unlisted-dependency", "major"),
    ("unresolved", "unresolved-import", "critical"),
]
#: Rules that depend on where the program begins.
REACHABILITY = ["unused-file", "unused-export", "superfluous-export", "unused-type", "unused-dependency"]
ENTRY = "array<struct<name:string,line:int>>"
ISSUE = "file string, files boolean, " + ", ".join(f"{k} {ENTRY}" for k, *_ in KINDS)


def read_report(reports: DataFrame, column: str = "json") -> DataFrame:
    """Issues of tool reports, a JSON text each; what lies before the first and after the last brace isn't JSON.

    Lists that aren't lists and entries that aren't objects are passed over; ``files`` may be a flag or a list.
    """
    body = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    issues = F.from_json(body, "issues array<string>")["issues"]
    rows = reports.select(F.explode(issues).alias("issue"))
    file = F.get_json_object("issue", "$.file")
    flag = F.get_json_object("issue", "$.files")
    lists = [_entries_of(k).alias(k) for k, *_ in KINDS]
    return rows.select(file.alias("file"), F.coalesce((flag == "true") | flag.rlike(r"^\s*\[\s*[^\]\s]"), F.lit(False)).alias("files"), *lists).where("file is not null and file <> ''")


def _entries_of(key: str) -> Column:
    """Entries are read one by one, so that one of another form spoils no other."""
    raw = F.from_json(F.get_json_object("issue", f"$.{key}"), "array<string>")
    return F.transform(F.filter(raw, lambda e: F.startswith(e, F.lit("{"))), lambda e: F.from_json(e, "name string, line int"))


def entries(issues: DataFrame) -> DataFrame:
    """(file, rule, severity, name, line): an unused file, and every entry of every list."""
    whole = issues.where("files").select("file", F.lit("unused-file").alias("rule"), F.lit("major").alias("severity"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"))
    lists = F.flatten(F.array(*(F.transform(F.coalesce(k, F.array().cast(ENTRY)), _entry(rule, severity)) for k, rule, severity in KINDS)))
    return whole.unionByName(issues.select("file", F.inline(lists)))


def _entry(rule: str, severity: str):
    return lambda e: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(e["name"], F.lit("#anonyme")).alias("name"), e["line"].alias("line"))


def classify_exports(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Exports without an importer that the file itself uses are superfluous, not dead. origins: file, name, origin."""
    out = rows.join(origins.select("file", "name", "origin"), ["file", "name"], "left")
    local = (F.col("rule") == "unused-export") & (F.col("origin") == "local-usage")
    return out.withColumn("rule", F.when(local, "superfluous-export").otherwise(F.col("rule"))).withColumn("severity", F.when(local, "minor").otherwise(F.col("severity"))).drop("origin")


def export_origins(exports: DataFrame, identifiers: DataFrame, reexports: DataFrame) -> DataFrame:
    """Why an export (file, name) has no importer: the file re-exports it by name, uses it elsewhere, or it is dead.

    identifiers: (file, name, is_name_position); reexports: (file, name), name null for a whole module.
    """
    named = reexports.where("name is not null").select("file", "name").distinct().withColumn("re", F.lit(True))
    used = identifiers.where("not is_name_position").select("file", "name").distinct().withColumn("used", F.lit(True))
    mentioned = identifiers.select("file", "name").distinct().withColumn("mentioned", F.lit(True))
    whole = reexports.where("name is null").select("file").distinct().withColumn("star", F.lit(True))
    out = exports.select("file", "name").distinct().join(named, ["file", "name"], "left").join(used, ["file", "name"], "left").join(mentioned, ["file", "name"], "left").join(whole, "file", "left")
    origin = F.when(F.col("re"), "reexport").when(F.col("used"), "local-usage").when(F.col("star") & F.col("mentioned").isNull(), "reexport").otherwise("dead")
    return out.select("file", "name", origin.alias("origin"))


def _folder(path: Column) -> Column:
    return specifiers.folder_of(path)


def in_scope(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of files in scope, and of manifests whose folder has such a file below it."""
    known = files.select("file").distinct()
    direct = rows.join(known, "file", "left_semi")
    manifests = rows.join(known, "file", "left_anti").where(F.col("file").rlike("(?:^|/)package\\.json$")).withColumn("dir", _folder(F.col("file")))
    governed = known.select(F.explode(globs.ancestors_with_root(F.col("file"))).alias("dir")).distinct()
    return direct.unionByName(manifests.join(governed, "dir", "left_semi").drop("dir"))


def report_findings(rows: DataFrame, config: Config, binary_only: DataFrame | None = None) -> DataFrame:
    """Findings of a report's entries, without rules that are off and without packages that have binaries alone."""
    if binary_only is not None:
        own = rows.withColumn("dir", _folder(F.col("file")))
        denied = own.where("rule = 'unused-dependency'").join(binary_only.select("dir", "name"), ["dir", "name"], "left_semi").select("file", "name").distinct().withColumn("denied", F.lit(True))
        rows = rows.join(denied, ["file", "name"], "left").where(F.col("denied").isNull() | (F.col("rule") != "unused-dependency")).drop("denied")
    off = [r for r, on in config.rules.items() if not on]
    rows = rows.where(~F.col("rule").isin(off))
    text = F.when(F.col("rule") == "unused-file", "no file imports it").otherwise(F.concat_ws(": ", "rule", "name"))
    return findings.make(rows, "knip", F.col("rule"), F.col("file"), text, line=F.col("line"), symbol=F.col("name"), key=F.col("name"), severity=F.col("severity"))


def summarize(found: DataFrame, config: Config) -> DataFrame:
    """One row of counts; unused types are null, not 0, while their rule is off."""
    types = F.count_if(F.col("rule") == "unused-type") if config.rules["unused-type"] else F.lit(None).cast("long")
    return found.agg(F.count_if(F.col("rule") == "unused-file").alias("unused_files"), F.count_if(F.col("rule") == "unused-export").alias("unused_exports"), F.count_if(F.col("rule") == "unused-dependency").alias("unused_dependencies"), types.alias("unused_types"))


def trusted(unused_files: int, files: int, config: Config) -> bool:
    """A report that calls too large a part of the project unused has missed where the program begins."""
    share = unused_files / files if files else 0
    return unused_files < config.knip["minUnusedFiles"] or share <= config.knip["maxUnusedFileFraction"]


def judged(found: DataFrame, files: int, config: Config) -> tuple[DataFrame, bool]:
    """The findings that hold, and whether the report is trusted; one scalar goes to the driver."""
    unused = found.where("rule = 'unused-file'").count()
    ok = trusted(unused, files, config)
    return (found if ok else found.where(~F.col("rule").isin(REACHABILITY))), ok


def reachable(edges: DataFrame, entry_files: DataFrame) -> DataFrame:
    """Files (file) that imports lead to from the entries, the entries included; a join for each further step."""
    done = written(entry_files.select("file").distinct())
    front = done
    while True:
        steps = edges.join(front.withColumnRenamed("file", "src"), "src", "left_semi").select(F.col("dst").alias("file")).distinct()
        front = written(steps.join(done, "file", "left_anti"))
        if front.isEmpty():
            return done
        done = written(done.unionByName(front))


def unused_files(files: DataFrame, edges: DataFrame, entry_files: DataFrame) -> DataFrame:
    return files.select("file").distinct().join(reachable(edges, entry_files), "file", "left_anti")


def unused_exports(exports: DataFrame, imported: DataFrame) -> DataFrame:
    """Exports (file, name) that no file imports by name, ``*`` standing for all of a file's."""
    whole = imported.where("name = '*'").select("file").distinct()
    return exports.join(imported.select("file", "name").distinct(), ["file", "name"], "left_anti").join(whole, "file", "left_anti")


def unused_dependencies(declared: DataFrame, refs: DataFrame) -> DataFrame:
    """Declared (dir, package) that no file below the folder imports; the ``@types`` of a package go with it."""
    package = specifiers.package_of(F.col("specifier"))
    named = refs.where(specifiers.kind_of(F.col("specifier")) == "bare").select("file", F.explode(F.array(package, specifiers.types_package_of(package))).alias("package")).distinct()
    used = named.select(F.explode(globs.ancestors_with_root(F.col("file"))).alias("dir"), "package").distinct()
    return declared.select("dir", "package").distinct().join(used, ["dir", "package"], "left_anti")


def without_native(found: DataFrame, judged_files: DataFrame) -> DataFrame:
    """A report's unlisted packages, except on files that the native rule has judged with a trustworthy manifest."""
    unlisted = F.col("rule") == "unlisted-dependency"
    return found.where(~unlisted).unionByName(found.where(unlisted).join(judged_files.select("file").distinct(), "file", "left_anti").select(*found.columns))
