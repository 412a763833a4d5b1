"""Workspace globs of a repository, from package files and a small part of YAML; what isn't understood is said."""

from __future__ import annotations

import re
from pathlib import Path

from codestrata.sources.manifests import read_json

#: Files that list workspaces, and what a plain YAML scalar can't begin with or have.
FILES = ["pnpm-workspace.yaml", "pnpm-workspace.yml"]
NOT_PLAIN = re.compile(r"^[>|&!%]|[:{}\[\]]")
#: Quoted text, a comment that follows white space, a closing bracket, or one other character.
PIECE = re.compile(r"""('[^']*'|"[^"]*")|((?:^|(?<=\s))#.*)|(\])|(.)""", re.S)

Declaration = tuple[list[str], str | None]


def without_comment(line: str) -> str:
    """A ``#`` inside quotes, or right after other text, begins no comment; an open quote runs to the end."""
    kept = 0
    for m in PIECE.finditer(_closed(line)):
        if m[2]:
            break
        kept = m.end()
    return line[: min(kept, len(line))]


def _closed(line: str) -> str:
    """The line with an open quote closed at its end."""
    quote = ""
    for c in line:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
    return line + quote


def _quoted(item: str) -> bool:
    return len(item) > 1 and item[0] in "'\"" and item[-1] == item[0]


def _items(items: list[str]) -> Declaration:
    odd = next((i for i in items if not _quoted(i) and NOT_PLAIN.search(i)), None)
    return ([], f"an item of an unknown form: {odd}") if odd is not None else ([i[1:-1] if _quoted(i) else i for i in items], None)


def yaml_globs(text: str) -> Declaration:
    """The list ``packages``, in block or flow form."""
    lines = re.split(r"\r?\n", text)
    at = next((k for k, line in enumerate(lines) if re.match(r"packages\s*:", line)), None)
    if at is None:
        return [], None
    value = without_comment(lines[at].split(":", 1)[1]).strip()
    if value and not value.startswith("["):
        return [], f"packages has an unknown form: {value}"
    if value:
        flow = " ".join([value, *(without_comment(line).strip() for line in lines[at + 1 :])])
        end = next((m.start() for m in PIECE.finditer(flow) if m[3]), None)
        if end is None:
            return [], "packages isn't closed"
        return _items([i for i in (x.strip() for x in flow[1:end].split(",")) if i])
    items = []
    for line in map(without_comment, lines[at + 1 :]):
        if not line.strip():
            continue
        found = re.match(r"\s*-\s+(.*)$", line)
        if not found:
            break
        if found[1].strip():
            items.append(found[1].strip())
    return _items(items)


def package_globs(root: str | Path) -> Declaration:
    path = Path(root) / "package.json"
    if not path.exists():
        return [], None
    parsed = read_json(path)
    if not isinstance(parsed, (dict, list)):
        return [], "package.json can't be read"
    declared = parsed.get("workspaces") if isinstance(parsed, dict) else None
    if declared is None:
        return [], None
    found = declared.get("packages") if isinstance(declared, dict) else declared
    if isinstance(found, list) and all(isinstance(x, str) for x in found):
        return found, None
    return [], "workspaces has an unknown form"


def globs_of(root: str | Path) -> Declaration:
    """All globs, and why some may be missing; then no sub-project can be called vendored."""
    found = [package_globs(root)]
    for name in FILES:
        path = Path(root) / name
        if path.exists():
            try:
                found.append(yaml_globs(path.read_text(encoding="utf-8")))
            except (OSError, UnicodeDecodeError) as e:
                found.append(([], f"{name}: {e}"))
    return [g for globs, _ in found for g in globs], next((r for _, r in found if r), None)
