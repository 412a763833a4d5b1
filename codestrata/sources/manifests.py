"""Package and compiler settings of a project as rows; entry points that it states itself."""

from __future__ import annotations

import json
import posixpath
import re
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Sections of a package file, names of other files, extensions, folders of scripts and of output.
SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
IMPORTABLE = ["main", "module", "exports", "types", "typings", "browser"]
KNIP_FILES = ["knip.json", "knip.jsonc", ".knip.json", ".knip.jsonc", "knip.ts", "knip.js", "knip.config.ts", "knip.config.js"]
EXTENSIONS = ["js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts"]
SCRIPT_DIRS = ["scripts", "bin"]
OUTPUT_DIRS = ["node_modules/", "dist/", "build/", "out/", "coverage/"]
SETUP_KEYS = ["setupFiles", "setupFilesAfterEnv", "globalSetup", "globalTeardown"]
REMOVABLE = ["dependencies", "devDependencies"]
#: Packages that serve without an import of them.
IMPLICIT = ["@types/bun", "@types/node", "knip", "typescript"]
SCHEMA = "dir string, dependencies array<string>, subpaths array<string>, aliases array<string>, mappings array<struct<pattern:string,targets:array<string>>>, base_url string, verbatim boolean, decorators boolean, trustworthy boolean, reason string"


@dataclass
class Manifest:
    dir: str = ""
    dependencies: list[str] = field(default_factory=list)
    subpaths: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    mappings: list[tuple[str, list[str]]] = field(default_factory=list)
    base_url: str = ""
    verbatim: bool = False
    decorators: bool = False
    trustworthy: bool = True
    reason: str | None = None


def inside(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas, as JSON."""
    token = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
    plain = token.sub(lambda m: m[1] or "", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)


def read_json(path: Path) -> Any:
    """None if it can't be read."""
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def _options(path: Path, seen: tuple[Path, ...] = ()) -> dict[str, Any]:
    """Compiler options along the chain of ``extends``, the nearest first; each path is relative to its own file."""
    raw = json.loads(without_comments(path.read_text(encoding="utf-8")))
    options: dict[str, Any] = {}
    extends = raw.get("extends", [])
    for base in [extends] if isinstance(extends, str) else extends:
        if base.startswith((".", "/")):
            near = (path.parent / base).resolve()
            options |= next((_options(p, (*seen, path)) for p in (near, near.with_name(near.name + ".json"), near / "tsconfig.json") if p.is_file() and p not in (*seen, path)), {})
    own = dict(raw.get("compilerOptions") or {})
    if "baseUrl" in own:
        own["baseUrl"] = str((path.parent / own["baseUrl"]).resolve())
    if "paths" in own:
        own["__paths_at"] = str(path.parent.resolve())
    return options | own


def read(root: str | Path, package_dir: str = "", config_dir: str | None = None) -> Manifest:
    """What governs a folder. An unreadable package file makes it untrustworthy; a missing compiler file does not."""
    root = Path(root).resolve()
    out = Manifest(package_dir)
    package = root / package_dir / "package.json"
    try:
        parsed = json.loads(package.read_text(encoding="utf-8"))
        if not isinstance(parsed, dict):
            raise ValueError("no object")
        out.dependencies = sorted({k for s in SECTIONS if isinstance(parsed.get(s), dict) for k in parsed[s]})
        out.subpaths = list(parsed["imports"]) if isinstance(parsed.get("imports"), dict) else []
        config = root / (package_dir if config_dir is None else config_dir) / "tsconfig.json"
        if config.is_file():
            options = _options(config)
            paths = options.get("paths") or {}
            out.aliases = list(paths)
            out.mappings = [(p, [t for t in targets if isinstance(t, str)]) for p, targets in paths.items() if isinstance(targets, list)]
            base = Path(options.get("baseUrl") or options.get("__paths_at") or config.parent)
            out.base_url = posixpath.normpath(Path(*base.parts).relative_to(root).as_posix()) if base.is_relative_to(root) else base.as_posix()
            out.base_url = "" if out.base_url == "." else out.base_url
            out.verbatim, out.decorators = options.get("verbatimModuleSyntax") is True, options.get("emitDecoratorMetadata") is True
    except (OSError, ValueError, TypeError, AttributeError) as e:
        out.trustworthy, out.reason = False, f"{inside(package_dir, 'package.json')}: {e}"
    return out


def is_project(path: Path) -> bool:
    """A package file with neither a name nor dependencies only says how modules are written; an unreadable one counts."""
    if not path.exists():
        return False
    parsed = read_json(path)
    return not isinstance(parsed, dict) or "name" in parsed or any(s in parsed for s in SECTIONS)


def as_rows(spark: SparkSession, manifests: Iterable[Manifest]) -> DataFrame:
    return spark.createDataFrame([(m.dir, m.dependencies, m.subpaths, m.aliases, m.mappings, m.base_url, m.verbatim, m.decorators, m.trustworthy, m.reason) for m in manifests], SCHEMA)


def declared_packages(root: str | Path, dirs: Iterable[str]) -> list[tuple[str, str, int | None]]:
    """(dir, package, line) of what the package files declare for use at run time or in development."""
    out = []
    for d in dirs:
        path = Path(root) / d / "package.json"
        parsed = read_json(path)
        if not isinstance(parsed, dict):
            continue
        lines = path.read_text(encoding="utf-8").splitlines()
        for name in sorted({k for s in REMOVABLE if isinstance(parsed.get(s), dict) for k in parsed[s]} - set(IMPLICIT)):
            out.append((d, name, next((k for k, line in enumerate(lines, 1) if line.lstrip().startswith(json.dumps(name) + ":")), None)))
    return out


def installed_package(root: str | Path, from_dir: str, package: str) -> tuple[Path, dict] | None:
    """(folder, package file) of the package, sought in each folder up to the root."""
    parts = [p for p in from_dir.split("/") if p not in ("", ".")]
    for depth in range(len(parts), -1, -1):
        folder = Path(root, *parts[:depth], "node_modules", package)
        if isinstance(parsed := read_json(folder / "package.json"), dict):
            return folder, parsed
    return None


def _types_of_exports(value: Any) -> str | None:
    """The first path for types, at any depth of conditions."""
    if not isinstance(value, dict):
        return None
    if isinstance(value.get("types"), str):
        return value["types"]
    return next((x for v in value.values() if (x := _types_of_exports(v)) is not None), None)


def typings_entry(folder: Path, parsed: dict) -> Path | None:
    """The declaration file of an installed package: as it states, else beside its main file."""
    named = [parsed.get("types"), parsed.get("typings"), _types_of_exports(parsed.get("exports"))]
    if isinstance(parsed.get("main"), str):
        named.append(re.sub(r"\.[cm]?js$", ".d.ts", parsed["main"]))
    paths = (folder / n for n in [*named, "index.d.ts"] if isinstance(n, str))
    return next((p for p in paths if p.name.endswith(".d.ts") and p.is_file()), None)


def installed_typings(root: str | Path, manifest: Manifest, most: int) -> list[tuple[str, str, str]]:
    """(dir, package, text) of the declarations of installed packages that a manifest leads to, the nearest first."""
    out, seen, queue = [], set(), deque(manifest.dependencies)
    while queue and len(seen) < most:
        name = queue.popleft()
        if name in seen:
            continue
        seen.add(name)
        if (found := installed_package(root, manifest.dir, name)) is None:
            continue
        if entry := typings_entry(*found):
            out.append((manifest.dir, name, entry.read_text(encoding="utf-8", errors="replace")))
        if isinstance(found[1].get("dependencies"), dict):
            queue.extend(found[1]["dependencies"])
    return out


def run_by_scripts(root: str | Path, package_dir: str, packages: Iterable[str]) -> list[str]:
    """Those of the packages that a script names, themselves or by one of their binaries."""
    parsed = read_json(Path(root) / package_dir / "package.json")
    scripts = parsed.get("scripts") if isinstance(parsed, dict) else None
    words = {w for s in scripts.values() if isinstance(s, str) for w in tokens(s)} if isinstance(scripts, dict) else set()
    out = []
    for name in packages:
        found = installed_package(root, package_dir, name) if words else None
        binaries = found[1].get("bin") if found else None
        if words & {name, name.rsplit("/", 1)[-1], *(binaries if isinstance(binaries, dict) else ())} or any(w.startswith(name + "/") for w in words):
            out.append(name)
    return out


def tokens(command: str) -> list[str]:
    words = (re.sub(r"^\./", "", re.sub(r"^['\"]|['\"]$", "", w)) for w in re.split(r"[\s;|&=]+", command))
    return [w for w in words if w]


def is_inside(path: str) -> bool:
    return not path.startswith((".", *OUTPUT_DIRS))


def own_entry_config(root: str | Path) -> str | None:
    """The first file, or section of the package file, in which a project says itself where it begins."""
    found = next((n for n in KNIP_FILES if (Path(root) / n).exists()), None)
    package = read_json(Path(root) / "package.json")
    return found or ("package.json#knip" if isinstance(package, dict) and "knip" in package else None)


def _strings(value: Any) -> list[str]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]


def declared_entries(root: str | Path, files: list[str]) -> tuple[list[str], int, str | None]:
    """(globs, how many were added to the defaults, the project's own file for them).

    Sources that scripts name, folders of scripts at any depth, and what test settings in JSON match or set up.
    """
    root = Path(root)
    if config := own_entry_config(root):
        return [], 0, config
    package = read_json(root / "package.json")
    package = package if isinstance(package, dict) else {}
    scripts = [s for s in (package.get("scripts") or {}).values() if isinstance(s, str)] if isinstance(package.get("scripts"), dict) else []
    commands = list(scripts)
    if any("nodemon" in tokens(s) for s in scripts):
        for source in (read_json(root / "nodemon.json"), package.get("nodemonConfig")):
            if isinstance(source, dict):
                commands += [source[k] for k in ("exec", "script") if isinstance(source.get(k), str)]
    named = {t for c in commands for t in tokens(c) if t.rsplit(".", 1)[-1] in EXTENSIONS and "." in t and is_inside(t) and (root / t).exists()}
    endings = "{" + ",".join(EXTENSIONS) + "}"
    folders = {d for d in SCRIPT_DIRS if (root / d).exists()}
    for file in files:
        parts = file.split("/")[:-1]
        if at := next((k + 1 for k, p in enumerate(parts) if p in SCRIPT_DIRS), 0):
            folders.add("/".join(parts[:at]))
    tests = {x for path in sorted({t for s in scripts for t in tokens(s) if t.endswith(".json") and is_inside(t) and (root / t).exists()}) for x in _test_entries(root, path, files)}
    added = sorted(named | {f"{d}/**/*.{endings}" for d in folders} | tests)
    return [f"{{index,cli,main}}.{endings}", f"src/{{index,cli,main}}.{endings}", *package_entries(root, package), *added], len(added), None


def package_entries(root: Path, package: dict) -> list[str]:
    """Sources that a package file names as what it offers: main, module, binaries, and exports at any depth."""

    def paths(value: Any) -> list[str]:
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        return [value] if isinstance(value, str) else [p for v in inner for p in paths(v)]

    stated = (posixpath.normpath(p) for k in ("main", "module", "bin", "exports") for p in paths(package.get(k)))
    return sorted({p for p in stated if p.rsplit(".", 1)[-1] in EXTENSIONS and is_inside(p) and "*" not in p and (root / p).is_file()})


def _test_entries(root: Path, path: str, files: list[str]) -> list[str]:
    config = read_json(root / path)
    if not isinstance(config, dict) or not {"testMatch", "testRegex"} & config.keys():
        return []
    folder = posixpath.dirname(path)
    if isinstance(config.get("rootDir"), str):
        folder = re.sub(r"^\./?", "", posixpath.normpath(posixpath.join(folder, config["rootDir"])))
    folder = "" if folder == "." else folder
    place = lambda p: p.replace("<rootDir>/", f"{folder}/" if folder else "", 1).replace("<rootDir>", folder, 1)
    found = [place(p) for p in (config.get("testMatch") if isinstance(config.get("testMatch"), list) else []) if isinstance(p, str)]
    for source in _strings(config.get("testRegex")):
        try:
            regex = re.compile(source)
        except re.error:
            continue
        found += [f for f in files if f.startswith(f"{folder}/" if folder else "") and regex.search(f)]
    return found + [place(p) for k in SETUP_KEYS for p in _strings(config.get(k)) if p.startswith("<rootDir>")]


def is_binary_only(root: str | Path, from_dir: str, package: str) -> bool:
    """The installed package has binaries and nothing to import; it is sought in each folder up to the root."""
    parts = [p for p in from_dir.split("/") if p not in ("", ".")]
    for depth in range(len(parts), -1, -1):
        parsed = read_json(Path(root, *parts[:depth], "node_modules", package, "package.json"))
        if isinstance(parsed, dict):
            return "bin" in parsed and not any(f in parsed for f in IMPORTABLE)
    return False
