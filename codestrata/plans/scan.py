"""A whole scan: sources, history and manifests of a project to findings, aggregates and summaries.

Everything is a lazy table until something is shown; the driver only takes scalars that decide what is measured.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import __version__
from codestrata.config import Config
from codestrata.frontend.tables import Parsed
from codestrata.functions import globs, specifiers
from codestrata.operators import ambient, churn, deadcode, duplication, findings, graph, imports, metrics, ratchet, slop
from codestrata.plans.lineage import written
from codestrata.sources import files, gitlog, manifests, workspaces

#: Sources of any kind and tools' settings, which may use a declared package, and folders of output.
SOURCES = tuple(f"**/*.{e}" for e in manifests.EXTENSIONS)
SETTINGS = ("**/tsconfig*.json", "**/jsconfig*.json", "**/.*rc", "**/.*rc.*", "**/*.config.*")
OUTPUT = ("**/node_modules/**", "dist/**", "build/**", "out/**", "coverage/**", ".git/**")


@dataclass
class Report:
    """findings and aggregates (key, value); what wasn't measured is None, or has no row."""

    root: str
    config: Config
    findings: DataFrame
    aggregates: DataFrame
    file_metrics: DataFrame
    functions: DataFrame
    summary: DataFrame
    scope: dict
    hotspots: DataFrame | None = None
    churn: DataFrame | None = None
    co_changes: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    tools: dict[str, str] = field(default_factory=dict)

    def snapshot(self) -> ratchet.Snapshot:
        return ratchet.Snapshot(ratchet.debt(self.findings), self.aggregates, self.config.thresholds, self.scope, __version__, self.tools)


def _pairs(spark: SparkSession, **named: DataFrame | None) -> DataFrame:
    """(key, value) of one-row tables; the row's only column is the value."""
    out = spark.createDataFrame([], "key string, value double")
    for name, row in named.items():
        if row is not None:
            out = out.unionByName(row.select(F.lit(name.replace("__", ".")).alias("key"), F.col(row.columns[0]).cast("double").alias("value")))
    return out


def _governed(spark: SparkSession, root: str, listing: DataFrame) -> tuple[list[manifests.Manifest], list[str]]:
    """Manifests of the project's packages, and their folders. Settings are small files, which the driver reads."""
    names = [r.file for r in listing.where(F.col("file").rlike(r"(?:^|/)package\.json$") & ~F.col("file").rlike(r"(?:^|/)node_modules/")).collect()]
    dirs = sorted({posixpath.dirname(n) for n in names if manifests.is_project(Path(root) / n)} | {""})
    return [manifests.read(root, d) for d in dirs], dirs


def _with_flags(spark: SparkSession, files: DataFrame, governing: list[manifests.Manifest]) -> DataFrame:
    """Files with the settings that decide which imports are left when types are taken away, by their manifest."""
    if not any(m.verbatim or m.decorators for m in governing):
        return files
    rows = manifests.as_rows(spark, governing).select("dir", "verbatim", "decorators")
    return files.join(imports.governing(files.select("file"), rows), "file", "left").join(F.broadcast(rows), "dir", "left").drop("dir")  # a project's manifests


def _undeclared(spark: SparkSession, root: str, refs: DataFrame, governing: list[manifests.Manifest], installed: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Undeclared packages; one that seems unknown is first looked for by all that its specifier may lead to."""
    rows = manifests.as_rows(spark, governing)
    found = imports.undeclared(refs, rows, installed)
    unknown = written(found.where("rule = 'unknown-dependency'").select("dir", "file", "specifier", "package").distinct())
    asked = {r.dir for r in unknown.select("dir").distinct().collect()}
    # Nothing is read for manifests without an unknown package.
    typings = [t for m in governing if m.dir in asked for t in manifests.installed_typings(root, m, ambient.MOST_PACKAGES)]
    texts = spark.createDataFrame(typings, "dir string, package string, text string")
    leads = ambient.resolvable(unknown, ambient.patterns(texts, texts.select("dir", "package").distinct()))
    # A package's own ``@types``, installed above the file, resolve it too; subpaths are no packages.
    bare = unknown.where(specifiers.kind_of(F.col("specifier")) == "bare").select("file", "specifier", F.explode(globs.ancestors_with_root(F.col("file"))).alias("dir"), specifiers.types_package_of(F.col("package")).alias("package"))
    leads = leads.union(bare.join(installed.select("dir", "package").distinct(), ["dir", "package"], "left_semi").select("file", "specifier"))
    if resolved is not None:
        leads = leads.union(resolved.where("target is not null").select("file", "specifier"))
    return imports.undeclared(refs, rows, installed, leads)


def _vendored(spark: SparkSession, root: str, dirs: list[str], refs: DataFrame, scoped: DataFrame, notes: list[str]) -> DataFrame:
    known, reason = workspaces.globs_of(root)
    nested = [d for d in dirs if d]
    if reason:
        notes.append(f"no sub-project is taken for vendored: {reason}")
    if reason or not nested:
        return spark.createDataFrame([], "dir string")
    names = [(d, p["name"]) for d in nested if isinstance(p := manifests.read_json(Path(root) / d / "package.json"), dict) and isinstance(p.get("name"), str)]
    return imports.vendored(spark.createDataFrame([(d,) for d in nested], "dir string"), known, refs, scoped, spark.createDataFrame(names, "dir string, package string"))


def scan(spark: SparkSession, root: str, config: Config, git: bool = True, tools: bool = True, revisions: str | None = None) -> Report:
    """The full analysis. Without git, history isn't measured; without tools, clones and dead code aren't."""
    notes: list[str] = []
    texts = files.read_text(spark, root)
    listing = written(texts.select("file"))
    ignored = gitlog.read_ignored(root)
    if not ignored.available:
        notes.append(f"ignored files aren't left out: {ignored.reason}")
    dirs_out, files_out = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c, names in (("dir", ignored.directories), ("file", ignored.files)))
    scoped = files.in_scope(texts, config, dirs_out, files_out)
    governing, dirs = _governed(spark, root, listing)
    parsed = Parsed(_with_flags(spark, scoped, governing))
    refs = parsed.imports()
    outside = files.in_scope(texts, Config(include=config.include, exclude=tuple(g for g in config.exclude if not files.TEST_GLOB.search(g))), dirs_out, files_out)
    test_refs = Parsed(outside.join(scoped.select("file"), "file", "left_anti")).imports()
    vendored = written(_vendored(spark, root, dirs, refs.select("file", "specifier").union(test_refs.select("file", "specifier")), scoped, notes))
    keep = lambda df: imports.without_vendored(df, vendored)
    kept = written(keep(scoped.select("file")))

    functions, per_file = written(keep(parsed.functions())), written(keep(parsed.file_metrics()))
    summary = metrics.summarize(per_file, functions, config)
    hits = written(keep(parsed.hits(config)))
    lines = metrics.sloc_lines(scoped.join(kept, "file", "left_semi"))
    found = [metrics.threshold_findings(per_file, functions, config), slop.slop_findings(hits)]

    root_manifest = manifests.read(root)
    mappings = spark.createDataFrame([(k, p, t, root_manifest.base_url) for k, (p, t) in enumerate(root_manifest.mappings)], "at int, pattern string, targets array<string>, base_url string")
    resolved = written(imports.resolve(keep(refs), kept, mappings))
    edges = imports.edges(resolved)
    nodes = keep(parsed.nodes())
    typed = resolved.where("target is not null and target <> file").select(F.col("file").alias("src"), F.col("target").alias("dst"), F.col("static").alias("survives_emit"), "kind")
    installed = listing.select(F.regexp_extract("file", r"^(?:(.*)/)?node_modules/((?:@[^/]+/)?[^/]+)/", 1).alias("dir"), F.regexp_extract("file", r"^(?:(.*)/)?node_modules/((?:@[^/]+/)?[^/]+)/", 2).alias("package")).where("package <> ''").distinct()
    undeclared = _undeclared(spark, root, keep(refs), governing, installed, resolved)
    found += [imports.undeclared_findings(undeclared), imports.unresolved_findings(imports.unresolved(resolved, listing))]
    cycles = written(graph.cycles(graph.runtime_edges(typed, nodes), nodes))
    found.append(graph.cycle_findings(cycles))

    measured: dict[str, DataFrame | None] = {
        "erosion__fraction": summary.select("erosion_fraction"),
        "erosion__mass": summary.select("total_mass"),
        "typesafety__escapes__count": slop.escapes(hits),
        "imports__unknown__count": undeclared.agg(F.count_if(F.col("rule") == "unknown-dependency").alias("n")),
        "cycles__count": cycles.agg(F.count("*").alias("n")),
    }
    report = Report(root, config, findings.union_all(*found), _pairs(spark), per_file, functions, summary, {}, notes=notes)
    if git:
        _history(spark, report, config, revisions, edges, nodes, found, measured)
    clone_lines, dead = None, None
    if tools:
        windows = written(duplication.windows(scoped.join(kept, "file", "left_semi")))
        clones = written(duplication.clones(windows))
        sides = duplication.sides(clones)
        found.append(duplication.clone_findings(sides))
        clone_lines = written(duplication.covered_lines(sides))
        copied = written(duplication.copied_lines(clones, lines))
        measured["duplication__lines"], measured["duplication__percent"] = copied.select("lines"), copied.select("percent")
        report.tools["jscpd"] = __version__
        every = files.in_scope(texts, Config(include=SOURCES, exclude=OUTPUT), dirs_out, files_out)
        uses = refs.select("file", "specifier").union(Parsed(every.join(scoped.select("file"), "file", "left_anti")).imports().select("file", "specifier"))
        settings = files.in_scope(texts, Config(include=SETTINGS, exclude=OUTPUT), dirs_out, files_out)
        named = settings.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"""(["'])([^"'\n]+)\1"""), F.lit(2))).alias("specifier"))
        dead, own = _dead_code(spark, root, parsed, resolved, edges, kept, config, notes, dirs, uses.union(named))
        if dead is not None:
            report.tools["knip"] = __version__
            report.scope["knip_trusted"] = True
            measured["deadcode__files__count"] = dead.agg(F.count_if(F.col("rule") == "unused-file").alias("n"))
            measured["deadcode__exports__count"] = dead.agg(F.count_if(F.col("rule") == "unused-export").alias("n"))
            found = [findings.demote_dead(findings.union_all(*found), dead.where("rule = 'unused-file'"), own), dead]
    if dead is None:
        tested = imports.imported_by_tests(test_refs, kept)
        lonely = written(graph.orphans(edges, nodes, tested))
        found.append(graph.orphan_findings(lonely))
        measured["orphans__count"] = lonely.agg(F.count("*").alias("n"))
    wordy = slop.verbosity(hits, lines, clone_lines)
    measured["verbosity__fraction"], measured["verbosity__lines"] = wordy.select("fraction"), wordy.select("verbose_lines")
    report.findings = written(findings.union_all(*found).orderBy(*findings.ordering()))
    report.aggregates = written(ratchet.check_ratios(_pairs(spark, **measured)))
    report.scope |= {"include": list(config.include), "exclude": list(config.exclude), "gitignore": ignored.available, "rules": config.optional_rules_on(), "import_rules": ratchet.IMPORT_RULES, "tools_scoped": True, "vendored": sorted(r.dir for r in vendored.collect())}
    return report


def _history(spark: SparkSession, report: Report, config: Config, revisions: str | None, edges: DataFrame, nodes: DataFrame, found: list, measured: dict) -> None:
    log = gitlog.read_log(report.root, None if revisions else gitlog.window_start(config.churn["windowDays"]), revisions)
    if not log.available:
        report.notes.append(f"no history: {log.reason}")
        return
    rows = written(gitlog.load(spark, log))
    changes = written(churn.in_scope(churn.current_paths(gitlog.changes(rows)), config))
    report.churn = churn.churn(changes)
    report.hotspots = churn.hotspots(report.churn, report.file_metrics, report.functions)
    read = gitlog.commits_read(rows)
    if not churn.measurable(read, config):
        report.notes.append(f"{read} commits are too few to measure what changes together")
        return
    history = churn.histories(changes.withColumnRenamed("commit_pos", "commit"), config, nodes)
    pairs = written(churn.linked_pairs(churn.co_changes(history, config), edges, nodes))
    report.co_changes = pairs
    found.append(churn.coupling_findings(pairs, config))
    measured["coupling__hidden__count"] = pairs.agg(F.count_if(~F.col("linked")).alias("n"))


def _dead_code(spark: SparkSession, root: str, parsed: Parsed, resolved: DataFrame, edges: DataFrame, kept: DataFrame, config: Config, notes: list[str], dirs: list[str], uses: DataFrame) -> tuple[DataFrame | None, bool]:
    """Findings by reachability from the stated entry points, or None where those can't be trusted."""
    patterns, added, own = manifests.declared_entries(root, [r.file for r in kept.collect()])
    plain = [x for p in patterns for x in _alternatives(p)]
    entries = kept.where(globs.matches_any(F.col("file"), plain))
    if own or entries.isEmpty():
        notes.append(f"dead code isn't measured: {own or 'no entry point'}")
        return None, False
    unused = deadcode.unused_files(kept, edges, entries)
    asked = parsed.imported().join(resolved.select("file", "specifier", "target").distinct(), ["file", "specifier"]).where("target is not null").select(F.col("target").alias("file"), "name")
    live = parsed.exports().join(kept, "file", "left_semi").join(unused, "file", "left_anti").join(entries, "file", "left_anti")
    exports = deadcode.unused_exports(live.select("file", "name"), asked)
    origins = deadcode.export_origins(exports, parsed.identifiers(), parsed.reexports())
    lines = live.groupBy("file", "name").agg(F.min("line").cast("int").alias("line"), F.bool_and("is_type").alias("is_type"))
    rows = unused.select("file", F.lit("unused-file").alias("rule"), F.lit("major").alias("severity"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"))
    rows = rows.unionByName(exports.join(lines, ["file", "name"]).select("file", F.when(F.col("is_type"), "unused-type").otherwise("unused-export").alias("rule"), F.lit("major").alias("severity"), "name", "line"))
    spare, denied = _unused_packages(spark, root, dirs, uses)
    rows = rows.unionByName(deadcode.in_scope(spare, kept).select(*rows.columns))
    found = written(deadcode.report_findings(deadcode.classify_exports(rows, origins), config, denied))
    judged, ok = deadcode.judged(found, kept.count(), config)
    if not ok:
        notes.append(f"the dead-code report isn't trusted; {added} entry points were declared")
        return None, False
    return judged, own is not None


def _unused_packages(spark: SparkSession, root: str, dirs: list[str], uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of packages that are declared but not used, and (dir, name) of those that have binaries alone."""
    declared = manifests.declared_packages(root, dirs)
    scripts = [(manifests.inside(d, "package.json"), p) for d in dirs for p in manifests.run_by_scripts(root, d, [n for at, n, _ in declared if at == d])]
    rows = spark.createDataFrame(declared, "dir string, package string, line int")
    unused = deadcode.unused_dependencies(rows, uses.union(spark.createDataFrame(scripts, "file string, specifier string")))
    # As many as the package files declare, at most.
    left = sorted((r.dir, r.package) for r in unused.collect())
    lines = {(d, p): line for d, p, line in declared}
    entries = [(manifests.inside(d, "package.json"), "unused-dependency", "major", p, lines[d, p]) for d, p in left]
    denied = [(d, p) for d, p in left if manifests.is_binary_only(root, d, p)]
    return spark.createDataFrame(entries, "file string, rule string, severity string, name string, line int"), spark.createDataFrame(denied, "dir string, name string")


def _alternatives(pattern: str) -> list[str]:
    """Globs without braces."""
    if "{" not in pattern:
        return [pattern]
    before, rest = pattern.split("{", 1)
    inside, after = rest.split("}", 1)
    return [x for choice in inside.split(",") for x in _alternatives(before + choice + after)]


def scan_file(spark: SparkSession, root: str, file: str, config: Config) -> DataFrame:
    """Findings of one file: measures, rules, undeclared packages and imports that lead nowhere, without graph and history."""
    text = (Path(root) / file).read_text(encoding="utf-8")
    one = spark.createDataFrame([(file, text)], "file string, text string")
    parts = [posixpath.dirname(file)]
    while parts[-1]:
        parts.append(posixpath.dirname(parts[-1]))
    dirs = [d for d in parts if manifests.is_project(Path(root) / d / "package.json")] or [""]
    governing = [manifests.read(root, d) for d in dirs]
    parsed = Parsed(_with_flags(spark, one, governing))
    package = specifiers.package_of(F.col("specifier"))
    packages = {p for r in parsed.imports().select(package.alias("package"), specifiers.types_package_of(package).alias("types")).collect() for p in r}
    there = [(d, p) for d in parts for p in packages if p and (Path(root) / d / "node_modules" / p).exists()]
    undeclared = _undeclared(spark, root, parsed.imports(), governing, spark.createDataFrame(there, "dir string, package string"))
    refs = parsed.imports()
    near = refs.select(F.explode(specifiers.on_disk_candidates(specifiers.resolve_relative(F.col("file"), F.col("specifier")))).alias("file")).distinct()
    # As many places as the file's imports may mean.
    there = [(r.file,) for r in near.where("file is not null").collect() if (Path(root) / r.file).exists()]
    unresolved = imports.unresolved(refs.withColumn("target", F.lit(None).cast("string")), spark.createDataFrame(there, "file string"))
    found = findings.union_all(metrics.threshold_findings(parsed.file_metrics(), parsed.functions(), config), slop.slop_findings(parsed.hits(config)), imports.undeclared_findings(undeclared), imports.unresolved_findings(unresolved))
    return found.orderBy(*findings.ordering())
