"""Imports: what they resolve to, and packages that a project uses without declaring them.

refs: (file, specifier, kind, line, type_only); files: (file) of the scope; manifests: (dir, dependencies, subpaths,
aliases, trustworthy); installed: (dir, package) for each folder that has packages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import globs, specifiers
from codestrata.operators import findings, graph


def _first_known(rows: DataFrame, keys: list[str], candidates: Column, files: DataFrame) -> DataFrame:
    """keys and target: the first of the candidates that is a known file."""
    tried = rows.select(*keys, F.posexplode(candidates).alias("at", "candidate"))
    hits = tried.join(files.select(F.col("file").alias("candidate")).distinct(), "candidate")
    return hits.groupBy(*keys).agg(F.min_by("candidate", "at").alias("target"))


def resolve(refs: DataFrame, files: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """refs with target, null where none is known.

    Relative specifiers are tried against the scope; bare ones and subpaths by the root's mappings
    (at, pattern, targets, base_url), in their order.
    """
    named = refs.select("file", "specifier").distinct().withColumn("spec_kind", specifiers.kind_of(F.col("specifier")))
    relative = named.where("spec_kind = 'relative'").withColumn("base", specifiers.resolve_relative(F.col("file"), F.col("specifier"))).where("base is not null")
    found = _first_known(relative, ["file", "specifier"], specifiers.candidates(F.col("base")), files)
    if mappings is not None:
        other = named.where("spec_kind in ('bare', 'subpath')").select("specifier").distinct()
        # A mapping's text before its star may be anything, so the few mappings of a project are tried on each specifier.
        fits = other.join(F.broadcast(mappings), specifiers.matches_alias(F.col("pattern"), F.col("specifier")))
        tried = fits.select("specifier", "at", "pattern", "base_url", F.posexplode("targets").alias("target_at", "to"))
        tried = tried.withColumn("base", specifiers.normalize(F.concat_ws("/", "base_url", specifiers.alias_target(F.col("pattern"), F.col("to"), F.col("specifier"))))).where("base is not null")
        spread = tried.select("specifier", "at", "target_at", F.posexplode(specifiers.alias_candidates(F.col("base"))).alias("candidate_at", "candidate"))
        hits = spread.join(files.select(F.col("file").alias("candidate")).distinct(), "candidate").groupBy("specifier").agg(F.min_by("candidate", F.struct("at", "target_at", "candidate_at")).alias("target"))
        found = found.unionByName(named.where("spec_kind in ('bare', 'subpath')").join(hits, "specifier").select("file", "specifier", "target"))
    return refs.join(found, ["file", "specifier"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst), without files that import themselves."""
    return resolved.where("target is not null and target <> file").select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


def governing(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(file, dir): the nearest folder above each file that ``dirs`` has, the root being the empty name.

    Files' folders are exploded, so the longest prefix is found by an equi-join.
    """
    above = files.select("file", F.explode(globs.ancestors_with_root(F.col("file"))).alias("dir"))
    return above.join(dirs.select("dir").distinct(), "dir").groupBy("file").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def undeclared(refs: DataFrame, manifests: DataFrame, installed: DataFrame, resolvable: DataFrame | None = None) -> DataFrame:
    """refs of packages that the governing manifest lacks, with package, dir, rule and severity.

    Silent without a trustworthy manifest, and for imports of types alone whose ``@types`` package is declared. A
    package that is installed in a folder above the file is unlisted; otherwise it is unknown, unless ``resolvable``
    (file, specifier) says that the specifier leads somewhere.
    """
    own = refs.withColumn("spec_kind", specifiers.kind_of(F.col("specifier"))).where("spec_kind in ('bare', 'subpath')")
    own = own.withColumn("package", specifiers.package_of(F.col("specifier"))).withColumn("types_package", specifiers.types_package_of(F.col("package")))
    of_file = governing(own.select("file").distinct(), manifests.select("dir"))
    joined = own.join(of_file, "file").join(manifests, "dir").where("trustworthy")

    def fits(patterns: str) -> Column:
        return F.exists(patterns, lambda p: specifiers.matches_alias(p, F.col("specifier")))

    has = F.array_contains("dependencies", F.col("package")) | fits("aliases") | fits("subpaths") | (F.col("type_only") & F.array_contains("dependencies", F.col("types_package")))
    left = joined.where(~has)
    # One row for each folder above the file that the package, or its types, may be installed in.
    seen = left.select("file", "package", "types_package").distinct()
    above = seen.select("file", "package", F.explode(globs.ancestors_with_root(F.col("file"))).alias("dir"), "types_package")
    there = installed.select("dir", F.col("package").alias("found")).distinct()
    direct = above.join(there, (above["dir"] == there["dir"]) & (above["package"] == there["found"])).select("file", "package").distinct().withColumn("direct", F.lit(True))
    typed = above.join(there, (above["dir"] == there["dir"]) & (above["types_package"] == there["found"])).select("file", "package").distinct().withColumn("typed", F.lit(True))
    out = left.join(direct, ["file", "package"], "left").join(typed, ["file", "package"], "left")
    is_installed = (F.col("spec_kind") == "bare") & (F.coalesce("direct", F.lit(False)) | (F.coalesce("typed", F.lit(False)) & F.col("type_only")))
    out = out.withColumn("rule", F.when(is_installed, "unlisted-dependency").otherwise("unknown-dependency"))
    if resolvable is not None:
        leads = resolvable.select("file", "specifier").distinct().withColumn("leads", F.lit(True))
        out = out.join(leads, ["file", "specifier"], "left").where((F.col("rule") == "unlisted-dependency") | F.col("leads").isNull()).drop("leads")
    return out.withColumn("severity", F.when(F.col("rule") == "unlisted-dependency", "major").otherwise("critical")).select("file", "line", "specifier", "package", "dir", "rule", "severity")


def undeclared_findings(found: DataFrame) -> DataFrame:
    manifest = F.when(F.col("dir") == "", "package.json").otherwise(F.concat("dir", F.lit("/package.json")))
    text = F.when(F.col("rule") == "unlisted-dependency", F.format_string("package %s is installed but not in %s", "package", manifest)).otherwise(F.format_string("package %s is neither in %s nor installed", "package", manifest))
    return findings.make(found, "imports", F.col("rule"), F.col("file"), text, line=F.col("line"), symbol=F.col("package"), key=F.col("package"), severity=F.col("severity"))


def unresolved(resolved: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Relative refs without a target in scope that name nothing on disk either. on_disk: (file), all files there are."""
    left = resolved.where("target is null").where(specifiers.kind_of(F.col("specifier")) == "relative")
    named = left.select("file", "specifier").distinct().withColumn("base", specifiers.resolve_relative(F.col("file"), F.col("specifier")))
    tried = named.where("base is not null").select("file", "specifier", F.explode(specifiers.on_disk_candidates(F.col("base"))).alias("candidate"))
    there = tried.join(on_disk.select(F.col("file").alias("candidate")).distinct(), "candidate", "left_semi").select("file", "specifier").distinct()
    return left.join(there, ["file", "specifier"], "left_anti")


def unresolved_findings(found: DataFrame) -> DataFrame:
    return findings.make(found, "imports", "unresolved-import", F.col("file"), F.format_string("nothing is at %s", "specifier"), line=F.col("line"), symbol=F.col("specifier"), key=F.col("specifier"), severity=F.lit("critical"))


def summarize(refs: DataFrame, resolved: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, edges, distinct external packages, and findings by rule."""
    bare = specifiers.kind_of(F.col("specifier")) == "bare"
    packages = refs.agg(F.count_distinct(F.when(bare, specifiers.package_of(F.col("specifier")))).alias("external_packages"))
    rules = found.agg(*(F.count_if(F.col("rule") == r).alias(r.split("-")[0]) for r in ("unknown-dependency", "unlisted-dependency", "unresolved-import")))
    return files.agg(F.count_distinct("file").alias("files")).crossJoin(edges(resolved).agg(F.count("*").alias("edges"))).crossJoin(packages).crossJoin(rules)  # one row each


def without_vendored(files: DataFrame, vendored: DataFrame) -> DataFrame:
    """Files that are under none of the folders (dir)."""
    above = files.select("file", F.explode(globs.ancestors(F.col("file"))).alias("dir"))
    under = above.join(vendored.select("dir").distinct(), "dir", "left_semi").select("file").distinct()
    return files.join(under, "file", "left_anti")


def vendored(dirs: DataFrame, workspaces: list[str], refs: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """Sub-projects that are no declared workspace and that no file outside them imports, by path or by name.

    dirs: (dir) of nested projects; names: (dir, package), the names they have.
    """
    candidates = dirs.where(F.col("dir") != "").where(~globs.matches_any(F.col("dir"), workspaces)).distinct()
    under = F.col("file")
    by_path = refs.where(specifiers.kind_of(F.col("specifier")) == "relative").withColumn("base", specifiers.resolve_relative(F.col("file"), F.col("specifier"))).where("base is not null").select("file", F.explode(F.concat(F.array("base"), globs.ancestors(F.col("base")))).alias("dir"))
    by_name = refs.withColumn("package", specifiers.package_of(F.col("specifier"))).join(names, "package").select("file", "dir")
    outside = by_path.unionByName(by_name).where(~globs.is_under(F.col("dir"), under)).select("dir").distinct()
    return candidates.join(outside, "dir", "left_anti")


def imported_by_tests(test_refs: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured files that test files import."""
    return resolve(test_refs, measured).where("target is not null").select(F.col("target").alias("file")).distinct()


def type_modules(statements: DataFrame) -> DataFrame:
    """(file, is_types_module): it declares a type and no statement of it leaves a value. statements: a row each."""
    return statements.groupBy("file").agg((F.bool_or("declares_type") & ~F.bool_or("emits_value")).alias("is_types_module"))


def ranked(refs: DataFrame) -> DataFrame:
    """refs with their place in the file, by line and specifier."""
    return refs.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line", "specifier")))


def build_graph(refs: DataFrame, files: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    return graph.clean_edges(edges(resolve(refs, files, mappings)), files)
