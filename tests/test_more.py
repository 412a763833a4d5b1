"""Ambient modules, reports beside native rules, and the stream of edits."""

import json

from codestrata.config import Config
from codestrata.operators import ambient, churn, deadcode
from codestrata.plans import proxies
from codestrata.plans.scan import scan, scan_file
from codestrata.streaming import edits


def test_ambient_modules(spark):
    depends = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "package string, dependency string")
    roots = spark.createDataFrame([("a",)], "package string")
    assert {r.package for r in ambient.visited(depends, roots).collect()} == {"a", "b", "c"}
    assert ambient.visited(depends, roots, most=2).count() == 2
    typings = spark.createDataFrame([("a", "declare module 'virtual:x' {}\ndeclare  module \"*.svg\" { }"), ("b", "// declare module 'no'\n/* declare module 'never' */ declare module './rel' {}"), ("x", "declare module 'far' {}")], "package string, text string")
    declared = ambient.patterns(typings, ambient.visited(depends, roots))
    assert {r.pattern for r in declared.collect()} == {"virtual:x", "*.svg"}
    refs = spark.createDataFrame([("f", "virtual:x"), ("f", "a/b.svg"), ("f", "far")], "file string, specifier string")
    assert {r.specifier for r in ambient.resolvable(refs, declared).collect()} == {"virtual:x", "a/b.svg"}


def test_reports_give_way_to_native_rules(spark):
    found = spark.createDataFrame([("unlisted-dependency", "a"), ("unlisted-dependency", "b"), ("unused-export", "a")], "rule string, file string")
    judged = spark.createDataFrame([("a",)], "file string")
    assert sorted(map(tuple, deadcode.without_native(found, judged).collect())) == [("unlisted-dependency", "b"), ("unused-export", "a")]


def test_edits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ts").write_text("let x: any")
    edits.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), Config()).awaitTermination()
    (tmp_path / "in/b.ts").write_text("// @ts-ignore")
    edits.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), Config()).awaitTermination()
    got = {(r.batch, r.file, r.rule) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "a.ts", "type-escape-any"), (1, "b.ts", "type-escape-comment")}


def test_histories_hold_all_orders_in_their_order(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = proxies.queries()["git_histories"](spark, sf).where("path is null").collect()
    expected = {}
    for r in orders.orderBy(orders.o_orderkey.desc()).collect():
        expected.setdefault(r.o_custkey, []).append(f"h{r.o_orderkey}")
    got = {}
    for r in sorted(rows, key=lambda r: r.commit_pos):
        got.setdefault(r.log_id, []).append(r.hash)
    assert got == expected and max(r.commit_pos for r in rows) > 0


def test_pairs_of_large_commits_are_counted(spark, sf):
    changes = proxies._frames(spark, sf, "changes")[0].select("commit", "file").distinct()
    sizes = changes.groupBy("commit").count()
    large = sizes.where("count between 7 and 20").select("commit")
    assert large.count() > 0 and sizes.where("count > 20").count() == 0
    a, b = changes.join(large, "commit"), changes.join(large, "commit")
    hidden = a.withColumnRenamed("file", "file_a").join(b.withColumnRenamed("file", "file_b"), "commit").where("file_a < file_b").groupBy("file_a", "file_b").count().where("count >= 2")
    got = proxies.queries()["co_changes"](spark, sf)
    assert got.join(hidden, ["file_a", "file_b"], "left_semi").count() > 0
    kept = churn.histories(changes, proxies.LOOSE).select("commit").distinct()
    assert large.join(kept, "commit").count() == large.count()


def put(root, **files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text if isinstance(text, str) else json.dumps(text, indent=1))


def test_a_scan_reports_unused_packages(spark, tmp_path):
    declared = "used typed spare binary inscript tested plugin injs @types/used @types/node @types/spare".split()
    put(tmp_path, **{
        "package.json": {"name": "p", "scripts": {"go": "runs --x"}, "dependencies": dict.fromkeys(declared, "1"), "peerDependencies": {"peer": "1"}},
        "src/main.ts": "import 'used/x'\nimport type { T } from 'typed'\nimport './a'\n",
        "src/a.ts": "export {}\n",
        "src/a.test.ts": "import 'tested'\n",
        "tool.js": "const x = require('injs')\n",
        "tsconfig.json": {"compilerOptions": {"types": ["plugin/x"]}},
        "sub/package.json": {"name": "s", "dependencies": {"used": "1"}},
        "sub/index.ts": "export const x = 1\n",
        "src/index.ts": "import '../sub/index'\n",
        "node_modules/binary/package.json": {"name": "binary", "bin": "x"},
        "node_modules/inscript/package.json": {"name": "inscript", "bin": {"runs": "x"}, "main": "y"},
    })
    report = scan(spark, str(tmp_path), Config(), git=False)
    found = report.findings.where("rule = 'unused-dependency'").collect()
    assert {(r.file, r.symbol) for r in found} == {("package.json", "spare"), ("package.json", "@types/spare"), ("sub/package.json", "used")}
    assert report.tools["knip"] and all(r.line for r in found)


def test_declared_modules_are_no_unknown_packages(spark, tmp_path):
    put(tmp_path, **{
        "package.json": {"name": "p", "dependencies": {"preset": "1"}},
        "sub/package.json": {"name": "s", "dependencies": {}},
        "src/index.ts": "import '../sub/a'\nimport '@theme/Layout'\nimport 'virtual:x'\nimport 'ghost'\nimport 'commented'\nimport 'hastypes'\n",
        "sub/a.ts": "import 'virtual:x'\n",
        "node_modules/preset/package.json": {"name": "preset", "dependencies": {"theme": "1", "any": "1"}},
        "node_modules/theme/package.json": {"name": "theme", "exports": {".": {"import": {"types": "./t/all.d.ts"}}}},
        "node_modules/theme/t/all.d.ts": "declare module '@theme/*' {}\n/* declare module 'commented' {} */\ndeclare module \"virtual:x\" {}\n// declare module 'ghost'\n",
        "node_modules/any/package.json": {"name": "any", "types": "index.d.ts"},
        "node_modules/any/index.d.ts": "declare module '*' {}\n",
        "node_modules/@types/hastypes/package.json": {"name": "@types/hastypes"},
    })
    report = scan(spark, str(tmp_path), Config(), git=False, tools=False)
    unknown = report.findings.where("rule = 'unknown-dependency'")
    # The manifest of sub leads to no package, so what others declare is not for its files.
    assert {(r.file, r.symbol) for r in unknown.collect()} == {("src/index.ts", "ghost"), ("src/index.ts", "commented"), ("sub/a.ts", "virtual:x")}
    assert {r.key: r.value for r in report.aggregates.collect()}["imports.unknown.count"] == 3
    alone = scan_file(spark, str(tmp_path), "src/index.ts", Config()).where("rule = 'unknown-dependency'")
    assert {r.symbol for r in alone.collect()} == {"ghost", "commented"}
