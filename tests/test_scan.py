"""A small project from end to end, and the commands' exit codes."""

import json
import subprocess

import pytest

from codestrata import config
from codestrata.plans import cli
from codestrata.plans.scan import scan


@pytest.fixture
def project(tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    put("package.json", json.dumps({"name": "p", "dependencies": {"known": "1"}, "scripts": {"go": "node src/main.ts"}}))
    put("src/main.ts", "import { a } from './a.js'\nimport known from 'known'\nimport ghost from 'ghost'\nexport const run = () => a(known, ghost)\n")
    put("src/a.ts", "import { b } from './b'\nexport const a = (x: any) => b(x)\nexport const unasked = 1\n")
    put("src/b.ts", "import { a } from './a'\nexport const b = (x) => a(x) || missing()\nimport './nowhere'\n")
    put("src/dead.ts", "export const d = 1\n")
    put("src/a.test.ts", "import { d } from './dead'\n")
    put("node_modules/known/index.ts", "")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], cwd=tmp_path, check=True, capture_output=True)
    put(".gitignore", "node_modules\ncodestrata-baseline\n")
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "first")
    return tmp_path


def test_scan(spark, project):
    report = scan(spark, str(project), config.load(project))
    found = {(r.rule, r.file) for r in report.findings.collect()}
    assert {("cycle", "src/a.ts"), ("unknown-dependency", "src/main.ts"), ("unresolved-import", "src/b.ts"), ("type-escape-any", "src/a.ts"), ("unused-file", "src/dead.ts"), ("unused-export", "src/a.ts")} <= found
    assert not any(r == "orphan" for r, _ in found)
    values = {r.key: r.value for r in report.aggregates.collect()}
    assert values["cycles.count"] == 1 and values["imports.unknown.count"] == 1 and values["deadcode.files.count"] == 1
    assert "coupling.hidden.count" not in values and "orphans.count" not in values
    assert report.hotspots.where("file = 'src/b.ts'").first().commits == 1
    assert report.file_metrics.count() == 4


def test_commands(spark, project, capsys):
    call = lambda *a: cli.main([*a, "--root", str(project)], spark)
    assert call("check") == 3 and call("file") == 3 and call("nonsense") == 3
    assert call("baseline", "--no-tools", "--no-git") == 0
    (project / "src/b.ts").write_text("import { a } from './a'\nexport const b = (x: any) => a(x)\n")
    assert call("check", "--no-tools", "--no-git") == 1
    assert "type-escape-any" in capsys.readouterr().out
    assert call("file", str(project / "src/b.ts")) == 2
    (project / config.FILE_NAME).write_text('{"rules": {"x": true}}')
    assert call("scan") == 3
