"""Operators on small tables, against known values and plain loops."""



import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.config import Config, resolve
from codestrata.functions import globs, specifiers
from codestrata.operators import churn, deadcode, duplication, findings, graph, imports, metrics, ratchet, slop

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
CONFIG = Config()


def test_globs():
    yes = [("**/*.ts", "a.ts"), ("**/*.ts", "a/b/c.ts"), ("src/**", "src/a/b"), ("*.ts", "a.ts"), ("a?c", "abc"), ("**/__tests__/**", "x/__tests__/y"), ("a.b", "a.b"), ("node_modules/**", "node_modules/x"), ("a+(b)", "a+(b)")]
    no = [("*.ts", "a/b.ts"), ("a?c", "a/c"), ("node_modules/**", "node_modules"), ("node_modules/**", "x/node_modules/y"), ("a.b", "axb"), ("{a,b}.ts", "a.ts"), ("**/*.ts", "a.tsx")]
    assert all(globs.matches([g], p) for g, p in yes) and not any(globs.matches([g], p) for g, p in no)
    assert not globs.matches([], "a")


def test_globs_in_spark_agree_with_python(spark):
    patterns = ["**/*.ts", "src/**", "*/x?.js", "a-b (c).ts"]
    paths = ["a.ts", "src/q/r", "y/x1.js", "y/z/x1.js", "a-b (c).ts", "src", "a\\b.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", globs.matches_any(F.col("p"), patterns)).collect()
    assert {r[0]: r[1] for r in rows} == {p: globs.matches(patterns, p) for p in paths}


def test_scope_prunes_folders(spark):
    rows = spark.createDataFrame([("src/a.ts",), ("gen/b.ts",), ("x/dist/c.ts",), ("dist/d.ts",), ("a.test.ts",)], "file string")
    config = resolve({"scope": {"include": ["**/*.ts"], "exclude": ["gen", "dist/**", "**/*.test.ts"]}})
    assert [r.file for r in rows.where(globs.in_scope(F.col("file"), config.include, config.exclude)).collect()] == ["src/a.ts", "x/dist/c.ts"]


def test_specifiers(spark):
    rows = spark.createDataFrame([(s,) for s in ["./a", "/a", "node:fs", "#x", "fs/promises", "lodash/get", "@a/b/c", "sea"]], "s string")
    got = [tuple(r) for r in rows.select(specifiers.kind_of(F.col("s")), specifiers.package_of(F.col("s")), specifiers.types_package_of(specifiers.package_of(F.col("s")))).collect()]
    assert [g[0] for g in got] == ["relative", "absolute", "builtin", "subpath", "builtin", "bare", "bare", "builtin"]
    assert got[5][1:] == ("lodash", "@types/lodash") and got[6][1:] == ("@a/b", "@types/a__b")


def test_paths_that_leave_the_root_are_null(spark):
    rows = spark.createDataFrame([("a/b.ts", "../c"), ("a.ts", "../c"), ("a/b/c.ts", ".././d/"), ("a.ts", "./a/../../x"), ("a.ts", ".")], "f string, s string")
    assert [r[0] for r in rows.select(specifiers.resolve_relative(F.col("f"), F.col("s"))).collect()] == ["c", None, "a/d", None, ""]


@pytest.mark.parametrize(
    "specifier, known, expected",
    [("./b.js", ["a/b.ts", "a/b.tsx"], "a/b.ts"), ("./b.js", ["a/b.js", "a/b.ts"], "a/b.js"), ("./b", ["a/b/index.ts"], "a/b/index.ts"), ("./b", ["a/b.d.ts", "a/b.js"], "a/b.d.ts"), ("../c.mjs", ["c.mts"], "c.mts"), ("./x", [], None), ("@app/q", ["src/q.ts"], "src/q.ts"), ("@app/q.js", ["src/q/index.ts"], "src/q/index.ts"), ("bare", ["bare.ts"], None)],
)
def test_resolution(spark, specifier, known, expected):
    refs = spark.createDataFrame([("a/f.ts", specifier)], "file string, specifier string")
    files = spark.createDataFrame([(k,) for k in known], "file string")
    mappings = spark.createDataFrame([(0, "@app/*", ["./src/*"], "")], "at int, pattern string, targets array<string>, base_url string")
    assert imports.resolve(refs, files, mappings).first().target == expected


def test_finding_ids_and_severities(spark):
    rows = spark.createDataFrame([("a.ts", "f", v, t) for v, t in [(11.0, 10.0), (12.5, 10.0), (20.0, 10.0), (21.0, 10.0), (5.0, 0.0), (None, None)]], "file string, symbol string, value double, threshold double")
    got = findings.make(rows, "metrics", "r", F.col("file"), F.lit("m"), symbol=F.col("symbol"), value=F.col("value"), threshold=F.col("threshold")).collect()
    import hashlib

    assert [r.severity for r in got] == ["minor", "minor", "major", "critical", "critical", "major"]
    assert {r.id for r in got} == {hashlib.sha1(b"metrics|r|a.ts|f").hexdigest()[:12]}
    bare = findings.make(rows.limit(1), "metrics", "r", F.col("file"), F.lit("m")).first()
    assert bare.id == hashlib.sha1(b"metrics|r|a.ts|").hexdigest()[:12]


def test_finding_order(spark):
    rows = spark.createDataFrame([("c", "minor", 2.0, 1.0), ("a", "major", 3.0, 1.0), ("b", "major", 4.0, 1.0), ("d", "major", 9.0, 0.0), ("e", "critical", None, None)], "id string, severity string, value double, threshold double")
    assert [r.id for r in rows.orderBy(*findings.ordering()).collect()] == ["e", "b", "a", "d", "c"]


FUNCTIONS = "file string, line int, symbol string, cyclomatic int, cognitive int, sloc int, params int, nesting_depth int, callback_depth int"


def test_erosion_and_median(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "cyclomatic int, sloc int")
    assert metrics.erosion(rows([(20, 100), (2, 100)]), 10).first().fraction == pytest.approx(200 / 220)
    assert metrics.erosion(rows([(10, 16), (11, 16)]), 10).first().fraction == pytest.approx(44 / 84)
    assert metrics.erosion(rows([]), 10).first().fraction == 0 and metrics.erosion(rows([(5, 0)]), 1).first().fraction == 0
    assert rows([(1, 1), (2, 1), (10, 1), (11, 1)]).agg(metrics.median_of("cyclomatic")).first()[0] == 6.0
    assert rows([]).agg(metrics.median_of("cyclomatic")).first()[0] == 0


def test_thresholds_are_strict_and_reports_have_their_own(spark):
    functions = spark.createDataFrame([("a.ts", 3, "f", 10, 18, 101, 4, 3, 9), ("a.ts", 9, "g", 26, 17, 55, 5, 6, 0)], FUNCTIONS)
    files = spark.createDataFrame([("a.ts", 331), ("b.ts", 330)], "file string, sloc int")
    got = {(r.rule, r.symbol): r for r in metrics.threshold_findings(files, functions, CONFIG).collect()}
    assert set(got) == {("cognitive-complexity", "f"), ("function-length", "f"), ("cyclomatic-complexity", "g"), ("too-many-params", "g"), ("nesting-depth", "g"), ("file-length", None)}
    assert [got[k].below_report_threshold for k in (("cognitive-complexity", "f"), ("function-length", "f"), ("cyclomatic-complexity", "g"), ("too-many-params", "g"), ("nesting-depth", "g"))] == [True, False, False, True, False]
    on = resolve({"rules": {"nested-callbacks": True}})
    assert "nested-callbacks" in {r.rule for r in metrics.threshold_findings(files, functions, on).collect()}


def test_blank_lines(spark):
    rows = spark.createDataFrame([("a", "// x\n\n \t\r\nb\n﻿\n"), ("b", None)], "file string, text string")
    assert [(r.file, r.line) for r in metrics.sloc_lines(rows).collect()] == [("a", 1), ("a", 4)]
    assert sorted(map(tuple, metrics.file_sloc(rows).collect())) == [("a", 2), ("b", 0)]


CHANGES = "commit_pos long, file_pos long, path string, previous_path string, added_lines long, deleted_lines long, date string"


def plain_renames(rows):
    """The log is read from the newest change on; a rename is remembered after its own name is looked up."""
    now, out = {}, []
    for _, _, path, before in rows:
        name = now.get(path, path)
        if before:
            now[before] = name
        out.append(name)
    return out


@FEW
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["a", "b", "c", "d", None, None])), min_size=1, max_size=25))
def test_renames_as_a_loop_reads_them(spark, pairs):
    rows = [(k // 3, k % 3, p, b) for k, (p, b) in enumerate(pairs)]
    data = spark.createDataFrame(rows, "commit_pos long, file_pos long, path string, previous_path string")
    got = churn.current_paths(data).orderBy("commit_pos", "file_pos").collect()
    assert [r.file for r in got] == plain_renames(rows)


def test_a_long_chain_of_renames(spark):
    rows = [(k, 0, f"n{300 - k}", f"n{299 - k}") for k in range(300)]
    data = spark.createDataFrame(rows, "commit_pos long, file_pos long, path string, previous_path string")
    assert {r.file for r in churn.current_paths(data).collect()} == {"n300"}


def test_churn_counts_rows_and_hotspots_drop_unmeasured(spark):
    data = spark.createDataFrame([("a", 1, 2, "2026-01-02"), ("a", 3, 4, "2026-01-01"), ("b", 1, 1, "2025")], "file string, added_lines long, deleted_lines long, date string")
    got = churn.churn(data)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 4, 6, "2026-01-01", "2026-01-02"), ("b", 1, 1, 1, "2025", "2025")]
    files = spark.createDataFrame([("a",), ("c",)], "file string")
    functions = spark.createDataFrame([("a", 3, 7), ("a", 4, 1)], "file string, cyclomatic int, cognitive int")
    assert [(r.file, r.score) for r in churn.hotspots(got, files, functions).collect()] == [("a", 14)]
    assert churn.hotspots(got, files, functions.limit(0)).first().score == 0


def test_commit_size_is_tested_before_files_that_are_gone_are_left_out(spark):
    rows = [(c, f) for c in range(5) for f in ("a", "b", "gone")] + [(9, f"x{k}") for k in range(21)] + [(8, "a")]
    data = spark.createDataFrame(rows, "commit long, file string")
    nodes = spark.createDataFrame([("a",), ("b",)] + [(f"x{k}",) for k in range(21)], "file string")
    history = churn.histories(data, CONFIG, nodes)
    assert {tuple(r) for r in history.collect()} == {(c, f) for c in range(5) for f in ("a", "b")}
    assert [tuple(r) for r in churn.co_changes(history, CONFIG).collect()] == [("a", "b", 5, 5, 5, 1.0)]
    assert not churn.measurable(49, CONFIG) and churn.measurable(50, CONFIG)


def test_linked_pairs(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "i"), ("i", "d"), ("e", "x"), ("x", "y"), ("y", "f"), ("g", "t"), ("h", "t"), ("k", "u"), ("l", "u")], "src string, dst string")
    nodes = spark.createDataFrame([("t", True), ("u", False)], "file string, is_types_module boolean")
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("k", "l"), ("b", "z")], "file_a string, file_b string")
    assert {r.file_a: r.linked for r in churn.linked_pairs(pairs, edges, nodes).collect()} == {"a": True, "c": True, "e": False, "g": True, "k": False, "b": False}


def tarjan_free_components(nodes, edges):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in reach and b in reach:
                for n in nodes:
                    if a in reach[n]:
                        reach[n].add(b)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@FEW
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=22))
def test_components(spark, pairs):
    names = [f"n{k}" for k in range(8)]
    edges = [(f"n{a}", f"n{b}") for a, b in pairs]
    got = graph.strongly_connected(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in names], "file string"))
    assert {r.file: r.component for r in got.collect()} == tarjan_free_components(names, edges)


def test_cycles_orphans_and_unknown_nodes(spark):
    nodes = spark.createDataFrame([(n,) for n in ["a", "b", "c", "d", "e", "lone", "x.config.ts", "src/.rc.ts", "tested"]], "file string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("lone", "outside")], "src string, dst string")
    found = graph.cycles(edges, nodes)
    assert [(r.component, r["size"], r.files) for r in found.collect()] == [("a", 3, ["a", "b", "c"]), ("d", 1, ["d"])]
    assert [r.severity for r in graph.cycle_findings(found).orderBy("file").collect()] == ["critical", "minor"]
    tested = spark.createDataFrame([("tested",)], "file string")
    assert {r.file for r in graph.orphans(edges, nodes, tested).collect()} == {"lone", "d"}
    assert graph.summarize(found, nodes.limit(0)).first().asDict() == {"cycles": 2, "largest_cycle": 3, "orphans": 0}


def test_undeclared_packages(spark):
    refs = spark.createDataFrame([("src/a.ts", "left-pad", 1, False), ("src/a.ts", "express", 2, True), ("src/a.ts", "express", 3, False), ("src/a.ts", "@app/x", 4, False), ("src/a.ts", "#in/y", 5, False), ("src/a.ts", "ghost", 6, False), ("sub/b.ts", "left-pad", 7, False), ("bad/c.ts", "ghost", 8, False), ("src/a.ts", "fs", 9, False), ("src/a.ts", "virtual:x", 10, False)], "file string, specifier string, line int, type_only boolean")
    manifests = spark.createDataFrame([("", ["left-pad", "@types/express"], ["#in/*"], ["@app/*"], True), ("sub", [], [], [], True), ("bad", [], [], [], False)], "dir string, dependencies array<string>, subpaths array<string>, aliases array<string>, trustworthy boolean")
    installed = spark.createDataFrame([("", "left-pad"), ("", "express")], "dir string, package string")
    leads = spark.createDataFrame([("src/a.ts", "virtual:x")], "file string, specifier string")
    got = imports.undeclared(refs, manifests, installed, leads)
    assert sorted((r.line, r.rule, r.dir) for r in got.collect()) == [(3, "unlisted-dependency", ""), (6, "unknown-dependency", ""), (7, "unlisted-dependency", "sub")]


def test_unresolved_imports_look_on_disk(spark):
    refs = spark.createDataFrame([("a.ts", "./x.js", 1), ("a.ts", "./data.json", 2), ("a.ts", "./gone", 3), ("a.ts", "../out", 4), ("a.ts", "pkg", 5)], "file string, specifier string, line int")
    disk = spark.createDataFrame([("x.ts",), ("data.json",)], "file string")
    got = imports.unresolved(imports.resolve(refs, spark.createDataFrame([("a.ts",)], "file string")), disk)
    assert sorted(r.line for r in got.collect()) == [3, 4]


def test_vendored(spark):
    dirs = spark.createDataFrame([("",), ("used",), ("named",), ("ws/a",), ("alone",)], "dir string")
    refs = spark.createDataFrame([("src/a.ts", "../used/x"), ("src/a.ts", "named-pkg/y"), ("alone/b.ts", "./c"), ("alone/b.ts", "../alone/d")], "file string, specifier string")
    names = spark.createDataFrame([("named", "named-pkg")], "dir string, package string")
    files = spark.createDataFrame([("src/a.ts",), ("alone/b.ts",), ("alonely.ts",)], "file string")
    found = imports.vendored(dirs, ["ws/*"], refs, files, names)
    assert [r.dir for r in found.collect()] == ["alone"]
    assert {r.file for r in imports.without_vendored(files, found).collect()} == {"src/a.ts", "alonely.ts"}


def test_verbosity(spark):
    lines = spark.createDataFrame([("a", k) for k in range(1, 21) if k != 5], "file string, line int")
    hits = spark.createDataFrame([("empty-catch", "a", 4, 6), ("type-escape-any", "a", 9, 9), ("empty-catch", "other", 1, 9)], "rule string, file string, line int, end_line int")
    clones = spark.createDataFrame([("a", 6), ("a", 7)], "file string, line int")
    assert slop.verbosity(hits, lines).first().verbose_lines == 2
    got = slop.verbosity(hits, lines, clones).first()
    assert (got.verbose_lines, got.total_sloc) == (3, 19)
    assert slop.verbosity(hits.limit(0), lines.limit(0)).first().fraction == 0


def test_clones_of_many_copies_are_linear(spark):
    text = "\n".join(f"line {k}" for k in range(8))
    rows = spark.createDataFrame([(f"f{k:02}", f"own {k}\n{text}\nend {k}") for k in range(30)], "file string, text string")
    got = duplication.clones(duplication.windows(rows), 16).collect()
    assert len(got) == 29 and {(r.first_file, r.first_start, r.start, r.lines, r.tokens) for r in got} == {("f00", 2, 2, 8, 16)}
    assert duplication.clones(duplication.windows(rows), 17).count() == 0  # too few tokens


def test_clones_have_the_lines_of_their_files(spark):
    code = "\n".join(f"  call{k}(a, b, c, d, e, f);" for k in range(5))
    rows = spark.createDataFrame([("a", "\n" * 5 + code), ("b", "x\n\n\t\n" + code.replace("\n", "\n \n") + "\ny"), ("c", None), ("d", "")], "file string, text string")
    found = duplication.clones(duplication.windows(rows))
    assert [tuple(r) for r in found.collect()] == [("a", 6, 10, "b", 4, 12, 9, 75)]
    side = duplication.sides(found).first()
    assert (side.first.file, side.first.start, side.first.end, side.second.start, side.lines) == ("b", 4, 12, 6, 9)
    lines = metrics.sloc_lines(rows.where("text is not null"))
    copied = duplication.copied_lines(found, lines).first()
    assert copied.lines == 5 and copied.percent == 100 * 5 / 12
    assert duplication.copied_lines(found.limit(0), lines.limit(0)).first().percent == 0


def test_clones_in_scope(spark):
    side = lambda f: (f, 1, 6)
    rows = spark.createDataFrame([(side("a"), side("b"), 6), (side("v"), side("a"), 6), (side("v"), side("w"), 6), (side("a"), side("out"), 6)], "first struct<file:string,start:int,end:int>, second struct<file:string,start:int,end:int>, lines int")
    known = spark.createDataFrame([(x,) for x in "abvw"], "file string")
    kept = duplication.in_scope(rows, known, known.where("file in ('v', 'w')"))
    assert sorted((r.first.file, r.second.file) for r in kept.collect()) == [("a", "b"), ("a", "v")]


def test_dead_code_report(spark):
    report = '{"issues":[{"file":"package.json","dependencies":[{"name":"left-pad","line":12}],"devDependencies":[{"name":"tool"}]},{"file":"src/a.ts","exports":[{"name":"x"},null,{"line":4}],"types":[{"name":"T"}],"files":[]},{"file":"src/o.ts","files":["src/o.ts"]},{"file":"other/z.ts","files":true},7,{"file":""}]}'
    rows = deadcode.entries(deadcode.read_report(spark.createDataFrame([("noise " + report + " end",)], "json string")))
    assert sorted((r.file, r.rule, r.name) for r in rows.collect() if r.rule != "unused-file") == [("package.json", "unused-dependency", "left-pad"), ("package.json", "unused-dependency", "tool"), ("src/a.ts", "unused-export", "#anonyme"), ("src/a.ts", "unused-export", "x"), ("src/a.ts", "unused-type", "T")]
    assert {r.file for r in rows.where("rule = 'unused-file'").collect()} == {"src/o.ts", "other/z.ts"}
    scope = spark.createDataFrame([("src/a.ts",), ("src/o.ts",)], "file string")
    kept = deadcode.in_scope(rows, scope)
    assert kept.where("file like 'other%'").isEmpty() and kept.where("file = 'package.json'").count() == 2
    binary = spark.createDataFrame([("", "tool")], "dir string, name string")
    found = deadcode.report_findings(kept, CONFIG, binary)
    assert sorted(r.rule for r in found.collect()) == ["unused-dependency", "unused-export", "unused-export", "unused-file"]
    assert deadcode.summarize(found, CONFIG).first().unused_types is None


def test_dead_code_trust(spark):
    assert deadcode.trusted(9, 10, CONFIG) and deadcode.trusted(33, 100, CONFIG) and not deadcode.trusted(34, 100, CONFIG)
    rows = spark.createDataFrame([("unused-file",)] * 12 + [("unlisted-dependency",)], "rule string")
    kept, ok = deadcode.judged(rows, 20, CONFIG)
    assert not ok and [r.rule for r in kept.collect()] == ["unlisted-dependency"]


def test_reachable_and_unused(spark):
    edges = spark.createDataFrame([("main", "a"), ("a", "b"), ("b", "a"), ("x", "y")], "src string, dst string")
    files = spark.createDataFrame([(f,) for f in ["main", "a", "b", "x", "y"]], "file string")
    assert {r.file for r in deadcode.unused_files(files, edges, files.where("file = 'main'")).collect()} == {"x", "y"}
    exports = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "file string, name string")
    used = spark.createDataFrame([("a", "p"), ("b", "*")], "file string, name string")
    assert [tuple(r) for r in deadcode.unused_exports(exports, used).collect()] == [("a", "q")]
    declared = spark.createDataFrame([("", "l"), ("sub", "m")], "dir string, package string")
    refs = spark.createDataFrame([("sub/a.ts", "l/x"), ("b.ts", "m")], "file string, specifier string")
    assert [tuple(r) for r in deadcode.unused_dependencies(declared, refs).collect()] == [("sub", "m")]


DEBT = "kind string, tool string, rule string, file string, value double"


def test_debt_is_the_worst_or_the_number(spark):
    rows = spark.createDataFrame([("metrics", "function-length", "a", 60.0), ("metrics", "function-length", "a", 90.0), ("metrics", "empty-catch", "a", 3.0), ("metrics", "empty-catch", "a", None), ("metrics", "file-length", "b", None)], "tool string, rule string, file string, value double")
    assert sorted(map(tuple, ratchet.debt(rows).collect())) == [("count", "metrics", "empty-catch", "a", 2.0), ("max", "metrics", "file-length", "b", 0.0), ("max", "metrics", "function-length", "a", 90.0)]


def test_debt_verdicts(spark):
    before = spark.createDataFrame([("count", "metrics", "r", "same", 1.0), ("count", "metrics", "r", "up", 1.0), ("count", "metrics", "r", "down", 2.0), ("count", "metrics", "r", "gone", 1.0), ("count", "knip", "r", "off", 1.0)], DEBT)
    after = spark.createDataFrame([("count", "metrics", "r", "same", 1.0), ("count", "metrics", "r", "up", 2.0), ("count", "metrics", "r", "down", 1.0), ("count", "metrics", "other", "same", 1.0), ("count", "metrics", "r", "new", 1.0), ("count", "jscpd", "r", "new2", 1.0)], DEBT)
    got = {(r.rule, r.file): r.verdict for r in ratchet.compare_debt(before, after, ["metrics"]).collect()}
    assert got == {("r", "same"): "unchanged", ("r", "up"): "increase", ("r", "down"): "improvement", ("r", "gone"): "improvement", ("r", "off"): "skipped", ("other", "same"): "new-entry", ("r", "new"): "new-file", ("r", "new2"): "new-file"}


def aggregates(spark, **values):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in values.items()], "key string, value double")


def test_aggregate_verdicts(spark):
    before = aggregates(spark, erosion_fraction=0.3, erosion_mass=10.0, verbosity_fraction=0.1, cycles_count=2.0, orphans_count=1.0, duplication_lines=5.0)
    after = aggregates(spark, erosion_fraction=0.4, erosion_mass=10.0, verbosity_fraction=0.2, cycles_count=1.0, duplication_lines=5.0000005)
    got = {r.key: r.verdict for r in ratchet.compare_aggregates(before, after).collect()}
    assert got == {"erosion.fraction": "diluted", "erosion.mass": "unchanged", "verbosity.fraction": "regression", "cycles.count": "improvement", "orphans.count": "skipped", "duplication.lines": "unchanged"}


SCOPE = {"include": ["a"], "exclude": [], "import_rules": 3, "gitignore": True, "rules": [], "tools_scoped": True}


def snapshot(spark, scope=SCOPE, debt=(), **other):
    return ratchet.Snapshot(spark.createDataFrame(list(debt), DEBT), other.pop("aggregates", aggregates(spark, cycles_count=0.0)), other.pop("thresholds", {"maxDepth": 3}), scope, other.pop("generator", "1"), other.pop("tools", {}), **other)


@pytest.mark.parametrize(
    "before, now, word",
    [
        ({"format": 1}, {}, "format"),
        ({"generator": "0"}, {}, "version"),
        ({"thresholds": {"maxDepth": 4}}, {}, "maxDepth"),
        ({"scope": SCOPE | {"exclude": ["x"]}}, {}, "scope"),
        ({"scope": SCOPE | {"tools_scoped": None}, "tools": {"knip": "5"}}, {}, "outside"),
        ({"scope": SCOPE | {"import_rules": 2}}, {}, "import"),
        ({"scope": SCOPE | {"gitignore": None}}, {}, "ignored"),
        ({"scope": SCOPE | {"rules": None}}, {}, "older"),
        ({"scope": SCOPE | {"rules": ["unused-type"]}}, {}, "optional"),
        ({"scope": SCOPE | {"vendored": ["v"]}}, {}, "vendored"),
        ({"tools": {"knip": "5"}}, {"scope": SCOPE | {"knip_trusted": False}}, "trusted"),
        ({"tools": {"jscpd": "4"}}, {"tools": {"jscpd": "5"}}, "jscpd"),
        ({"tools": {"jscpd": "4"}}, {}, None),
    ],
)
def test_what_cannot_be_compared(spark, before, now, word):
    reason = ratchet.incompatibility(snapshot(spark, **before), snapshot(spark, **now))
    assert reason is None if word is None else word in reason


def test_rules_that_one_side_did_not_measure_are_skipped(spark):
    a = snapshot(spark, debt=[("count", "depcruise", "orphan", "x", 1.0), ("count", "metrics", "r", "x", 1.0)], aggregates=aggregates(spark, orphans_count=1.0))
    b = snapshot(spark, debt=[("count", "metrics", "r", "x", 1.0)])
    got = {r.key: r.verdict for r in ratchet.compare(a, b).collect()}
    assert got["depcruise|orphan|x"] == "skipped" and got["metrics|r|x"] == "unchanged"
    assert ratchet.regressions(ratchet.compare(a, b)).isEmpty()


def test_ratios_out_of_range_are_an_error(spark):
    assert ratchet.check_ratios(aggregates(spark, verbosity_fraction=1.0, duplication_percent=100.0)).count() == 2
    with pytest.raises(Exception, match="out of range"):
        ratchet.check_ratios(aggregates(spark, verbosity_fraction=1.2)).collect()


def test_rounding_is_half_up(spark):
    rows = spark.createDataFrame([(0.0000005,), (0.1234565,), (2.5,)], "v double")
    assert [r[0] for r in rows.select(ratchet.rounded(F.col("v"))).collect()] == [0.000001, 0.123457, 2.5]
