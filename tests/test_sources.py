"""Settings, history, manifests, workspaces, baselines, and the driver's queries against SQL."""

import json
import subprocess
from datetime import datetime, timezone

import duckdb
import pytest

import __spark_entry__ as entry
from codestrata import config
from codestrata.operators import ratchet
from codestrata.plans import proxies
from codestrata.sources import baselines, files, gitlog, manifests, workspaces


def test_settings_are_laid_over_defaults():
    c = config.resolve({"thresholds": {"maxDepth": 0}, "rules": {"unused-type": True}, "scope": {"include": ["x"]}, "churn": {"other": 3}, "unknown": 1})
    assert c.thresholds["maxDepth"] == 0 and c.thresholds["maxParams"] == 4 and c.include == ("x",) and c.exclude == config.Config().exclude
    assert c.optional_rules_on() == ["unused-type"] and c.is_on("cycle") and not c.is_on("redundant-else")
    assert c.report_level("file-length") == 600 and c.report_level("nested-callbacks") is None


@pytest.mark.parametrize("raw", [[], {"thresholds": {"maxDepth": -1}}, {"thresholds": {"maxDepth": "3"}}, {"thresholds": 1}, {"rules": {"nope": True}}, {"rules": {"unused-type": 1}}, {"reportThresholds": {"maxNestedCallbacks": 1}}, {"knip": {"x": 1}}, {"scope": {"include": "a"}}, {"churn": {"windowDays": float("inf")}}, {"scope": []}])
def test_wrong_settings_are_errors(raw):
    with pytest.raises(config.ConfigError):
        config.resolve(raw)


def test_settings_file(tmp_path):
    assert config.load(tmp_path) == config.Config()
    (tmp_path / config.FILE_NAME).write_text('{"thresholds": {"maxDepth": 5}}')
    assert config.load(tmp_path).thresholds["maxDepth"] == 5
    (tmp_path / config.FILE_NAME).write_text("{")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)


LOG = "\x01h1\x1f2026-01-02T00:00:00+01:00\0\n3\t1\tsrc/a.ts\0" + "2\t0\t\0old name.ts\0src/new.ts\0" + "-\t-\timg.png\0" + "1\t1\ta\tb.ts\0" + "\x01h2\x1f2026-01-01\0\x01h3\x1f2025\0\n0\t0\tz\0" + "4\t4\t\0p\t1\t\0q\0"


def test_log(spark):
    rows = gitlog.parse_log(spark.createDataFrame([(LOG,)], "raw string")).orderBy("commit_pos", "file_pos").collect()
    got = [(r.commit_pos, r.hash, r.path, r.previous_path, r.added_lines, r.deleted_lines, r.binary) for r in rows if r.path is not None]
    assert got == [(0, "h1", "src/a.ts", None, 3, 1, False), (0, "h1", "src/new.ts", "old name.ts", 2, 0, False), (0, "h1", "img.png", None, 0, 0, True), (0, "h1", "a\tb.ts", None, 1, 1, False), (2, "h3", "z", None, 0, 0, False), (2, "h3", "q", "p\t1\t", 4, 4, False)]
    assert gitlog.commits_read(gitlog.parse_log(spark.createDataFrame([(LOG,)], "raw string"))) == 3
    assert [r.date for r in rows if r.hash == "h2"] == ["2026-01-01"]
    assert gitlog.parse_log(spark.createDataFrame([("",)], "raw string")).count() == 0


def test_a_real_repository(spark, tmp_path):
    assert not gitlog.read_log(tmp_path / "none").available
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("one\ntwo\nthree\nfour\n")
    (tmp_path / ".gitignore").write_text("out/\n*.log\n")
    run("add", ".")
    run("commit", "-qm", "first")
    run("mv", "a.ts", "b.ts")
    run("commit", "-qm", "second")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/x").write_text("")
    (tmp_path / "y.log").write_text("")
    found = gitlog.load(spark, gitlog.read_log(tmp_path))
    assert [(r.path, r.previous_path) for r in gitlog.changes(found).where("path like '%.ts'").orderBy("commit_pos").collect()] == [("b.ts", "a.ts"), ("a.ts", None)]
    ignored = gitlog.read_ignored(tmp_path)
    assert ignored.directories == ["out"] and ignored.files == ["y.log"]


def test_window_start():
    assert gitlog.window_start(365, datetime(2026, 3, 1, 1, tzinfo=timezone.utc)) == "2025-03-01"


def test_files(spark, tmp_path):
    for name in ("src/a b+c.ts", "src/a.test.ts", "dist/x.ts", "é.ts", "gen/g.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"// {name}")
    rows = files.read_text(spark, str(tmp_path))
    assert {r.file: r.text for r in rows.collect()} == {n: f"// {n}" for n in ("src/a b+c.ts", "src/a.test.ts", "dist/x.ts", "é.ts", "gen/g.ts")}
    ignored = spark.createDataFrame([("gen",)], "dir string")
    kept = files.in_scope(rows, config.Config(), ignored)
    assert {r.file for r in kept.collect()} == {"src/a b+c.ts", "é.ts"}
    assert {r.file for r in files.test_files(rows, config.Config(), kept).collect()} == {"src/a.test.ts", "gen/g.ts"}


def test_manifests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "package.json").write_text(json.dumps({"name": "x", "dependencies": {"a": "1"}, "devDependencies": {"b": "1"}, "imports": {"#x/*": "./x/*"}}))
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base", "compilerOptions": {"verbatimModuleSyntax": true, /* c */ }, // d\n}')
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "./sub", "paths": {"@/*": ["./*"]}}}')
    (tmp_path / "sub/package.json").write_text('{"type": "module"}')
    m = manifests.read(tmp_path)
    assert (m.dependencies, m.subpaths, m.aliases, m.mappings, m.base_url, m.verbatim, m.trustworthy) == (["a", "b"], ["#x/*"], ["@/*"], [("@/*", ["./*"])], "sub", True, True)
    assert not manifests.read(tmp_path, "none").trustworthy
    assert manifests.is_project(tmp_path / "package.json") and not manifests.is_project(tmp_path / "sub/package.json")
    (tmp_path / "sub/package.json").write_text("{")
    assert manifests.is_project(tmp_path / "sub/package.json") and not manifests.read(tmp_path, "sub").trustworthy
    assert manifests.as_rows(spark, [m]).first().trustworthy


def test_entry_points(tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"scripts": {"a": "node ./src/run.ts && nodemon", "b": "jest --config=jest.json", "c": "node dist/x.js"}, "nodemonConfig": {"exec": "ts-node src/dev.ts"}}))
    (tmp_path / "jest.json").write_text(json.dumps({"rootDir": "./test", "testMatch": ["<rootDir>/**/*.e2e.ts"], "testRegex": ["\\.it\\.ts$", "("], "setupFiles": "<rootDir>/setup.ts"}))
    for f in ("src/run.ts", "src/dev.ts"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("")
    patterns, added, own = manifests.declared_entries(tmp_path, ["pkg/scripts/x/y.ts", "test/a.it.ts", "other/b.it.ts"])
    assert patterns[2:] == ["pkg/scripts/**/*.{js,mjs,cjs,jsx,ts,tsx,mts,cts}", "src/dev.ts", "src/run.ts", "test/**/*.e2e.ts", "test/a.it.ts", "test/setup.ts"] and added == 6 and own is None
    (tmp_path / "knip.json").write_text("{}")
    assert manifests.declared_entries(tmp_path, []) == ([], 0, "knip.json")


def test_binary_only(tmp_path):
    for name, about in (("tool", {"bin": "x"}), ("lib", {"bin": "x", "main": "y"})):
        (tmp_path / "node_modules" / name).mkdir(parents=True)
        (tmp_path / "node_modules" / name / "package.json").write_text(json.dumps(about))
    assert manifests.is_binary_only(tmp_path, "a/b", "tool") and not manifests.is_binary_only(tmp_path, ".", "lib") and not manifests.is_binary_only(tmp_path, "", "none")


@pytest.mark.parametrize(
    "text, globs",
    [
        ("packages:\n  - 'apps/*' # site\n  - libs/**\n\n  # c\n  - \"!**/test/**\"\nother: 1\n  - no", ["apps/*", "libs/**", "!**/test/**"]),
        ("packages: ['a/*', \"b#c\"]  # x", ["a/*", "b#c"]),
        ("packages: [\r\n  a/*, # one\r\n  'b]'\r\n  ,c\r\n]", ["a/*", "b]", "c"]),
        ("packages:\r\n- a\r\n- b\r\n", ["a", "b"]),
        ("name: x", []),
        ("packages: *anchor", None),
        ("packages: [a, b", None),
        ("packages:\n  - >-\n    a", None),
        ("packages:\n  - a: b", None),
        ("packages:\n  - !x y", None),
    ],
)
def test_workspace_yaml(text, globs):
    found, reason = workspaces.yaml_globs(text)
    assert (found == globs and reason is None) if globs is not None else (found == [] and reason)


def test_workspaces(tmp_path):
    assert workspaces.globs_of(tmp_path) == ([], None)
    (tmp_path / "package.json").write_text('{"workspaces": {"packages": ["a/*"]}}')
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - b/*\n")
    assert workspaces.globs_of(tmp_path) == (["a/*", "b/*"], None)
    (tmp_path / "package.json").write_text('{"workspaces": 3}')
    assert workspaces.globs_of(tmp_path)[1]


def test_baselines(spark, tmp_path):
    debt = spark.createDataFrame([("count", "metrics", "r", "f", 2.0)], baselines.DEBT)
    aggregates = spark.createDataFrame([("cycles.count", 1.00000049), ("orphans.count", None)], baselines.AGGREGATES)
    snapshot = ratchet.Snapshot(debt, aggregates, {"maxDepth": 3}, {"include": ["x"]}, "1", {"knip": "5"})
    baselines.write(snapshot, str(tmp_path / "b"))
    back = baselines.read(spark, str(tmp_path / "b"))
    assert [tuple(r) for r in back.debt.collect()] == [("count", "metrics", "r", "f", 2.0)]
    assert [tuple(r) for r in back.aggregates.collect()] == [("cycles.count", 1.0)]
    assert (back.thresholds, back.scope, back.generator, back.tools) == ({"maxDepth": 3}, {"include": ["x"]}, "1", {"knip": "5"})
    with pytest.raises(baselines.BaselineError):
        baselines.read(spark, str(tmp_path / "none"))
    old = spark.createDataFrame([('{"version": 2, "debtCounts": {"a|r|x|y.ts": 2}, "debtMaxima": {}}',)], "json string")
    assert [tuple(r) for r in baselines.from_json(old).collect()] == [("count", "a", "r", "x|y.ts", 2.0)]


def plain(value):
    return int(value) if isinstance(value, float) and value == int(value) else value


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(proxies.queries()))
def test_queries_give_the_rows_of_their_sql(spark, sf, duck, name):
    import decimal

    df = proxies.queries()[name](spark, sf)
    columns = sorted(df.columns)
    expected = duck.sql(proxies.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    clean = lambda v: plain(float(v) if isinstance(v, decimal.Decimal) else v)
    assert sorted(str([clean(r[c]) for c in columns]) for r in df.collect()) == sorted(str([clean(r[k]) for k in at]) for r in expected.fetchall())


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 3 and "hotspots" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
