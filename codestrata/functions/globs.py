"""Globs over POSIX paths as one regular expression that Spark and SQL engines evaluate alike."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
_AS = {"**/": "(?:[^/]*/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def to_regex(glob: str) -> str:
    """``**/`` any folders, other ``**`` anything, ``*`` and ``?`` within a name; braces and classes mean themselves."""
    return "^" + "".join(_AS.get(p) or re.sub(r"([^A-Za-z0-9_/\- ])", r"\\\1", p) for p in _PARTS.findall(glob)) + "$"


def any_regex(globs: Iterable[str]) -> str | None:
    return "|".join(f"(?:{to_regex(g)})" for g in globs) or None


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """False for an empty list."""
    regex = any_regex(globs)
    return path.rlike(regex) if regex else F.lit(False)


def matches(glob_list: Iterable[str], path: str) -> bool:
    regex = any_regex(glob_list)
    return bool(regex and re.search(regex, path, re.S))


def in_scope(path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """Included and not excluded; a folder that matches an exclude glob by itself or with a slash takes all below it."""
    return matches_any(path, include) & ~matches_any(path, exclude) & ~F.exists(ancestors(path), lambda d: matches_any(d, exclude) | matches_any(F.concat(d, F.lit("/")), exclude))


def ancestors(path: Column) -> Column:
    """Folders above a path, the nearest first, without the root."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def ancestors_with_root(path: Column) -> Column:
    return F.concat(ancestors(path), F.array(F.lit("")))


def is_under(folder: Column, path: Column) -> Column:
    return F.startswith(path, F.concat(folder, F.lit("/")))
