"""Import specifiers: their kind, the package they name, and the files they may mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modules that the runtime itself has.
BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl sea stream string_decoder sys test timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
#: Extensions that a specifier may leave out, and what a file outside the scope may end with.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"]
ON_DISK = ["", *EXTENSIONS, ".json", "/index.ts", "/index.tsx", "/index.js", "/index.mjs", "/index.cjs", "/index.json"]
JS_ENDING = r"\.(m|c)?js$"


def kind_of(spec: Column) -> Column:
    """relative, absolute, builtin, subpath or bare."""
    return (
        F.when(F.startswith(spec, F.lit(".")), "relative")
        .when(F.startswith(spec, F.lit("/")), "absolute")
        .when(F.startswith(spec, F.lit("node:")), "builtin")
        .when(F.startswith(spec, F.lit("#")), "subpath")
        .when(F.split_part(spec, F.lit("/"), F.lit(1)).isin(BUILTINS), "builtin")
        .otherwise("bare")
    )


def package_of(spec: Column) -> Column:
    """The first segment, or two for a scoped name."""
    return F.when(F.startswith(spec, F.lit("@")), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def types_package_of(package: Column) -> Column:
    """``@types/a``; a scoped ``@a/b`` has ``@types/a__b``."""
    return F.concat(F.lit("@types/"), F.when(F.startswith(package, F.lit("@")), F.regexp_replace(package.substr(F.lit(2), F.length(package)), "/", "__")).otherwise(package))


def folder_of(path: Column) -> Column:
    """Empty for a file in the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def normalize(path: Column) -> Column:
    """``.`` and ``..`` resolved; null where the path leaves the root."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("left")),
        lambda acc, s: F.when(s == "..", F.struct(F.when(F.size(acc["at"]) > 0, F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).otherwise(acc["at"]).alias("at"), (acc["left"] | (F.size(acc["at"]) == 0)).alias("left"))).otherwise(F.struct(F.concat(acc["at"], F.array(s)).alias("at"), acc["left"].alias("left"))),
    )
    return F.when(~folded["left"], F.array_join(folded["at"], "/"))


def resolve_relative(file: Column, spec: Column) -> Column:
    folder = folder_of(file)
    return normalize(F.when(folder == "", spec).otherwise(F.concat_ws("/", folder, spec)))


def _with(base: Column, endings: list[str]) -> Column:
    return F.array(*(F.concat(base, F.lit(e)) for e in endings))


def candidates(base: Column) -> Column:
    """Paths that a resolved specifier may mean; the first that is a known file is meant.

    Source written for modules names ``./x.js`` where it means ``./x.ts``.
    """
    stem = F.regexp_replace(base, JS_ENDING, "")
    renamed = F.when(stem != base, _with(stem, EXTENSIONS)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), renamed, _with(base, EXTENSIONS), _with(base, [f"/index{e}" for e in EXTENSIONS]))


def alias_candidates(base: Column) -> Column:
    """The same for the target of an alias, where the renamed stem's folder comes before the base."""
    stem, both = F.regexp_replace(base, JS_ENDING, ""), [*EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
    return F.concat(F.array(base), F.when(stem != base, _with(stem, both)).otherwise(F.array().cast("array<string>")), _with(base, both))


def on_disk_candidates(base: Column) -> Column:
    stem = F.regexp_replace(base, JS_ENDING, "")
    return F.array_distinct(F.concat(_with(base, ON_DISK), F.when(stem != base, _with(stem, ON_DISK)).otherwise(F.array().cast("array<string>"))))


def matches_alias(pattern: Column, spec: Column) -> Column:
    """A single ``*`` stands for anything; without one the pattern is the specifier."""
    before, after = F.substring_index(pattern, "*", 1), F.regexp_extract(pattern, r"\*(.*)$", 1)
    star = F.contains(pattern, F.lit("*"))
    return F.when(star, F.startswith(spec, before) & F.endswith(spec, after) & (F.length(spec) >= F.length(before) + F.length(after))).otherwise(pattern == spec)


def alias_target(pattern: Column, target: Column, spec: Column) -> Column:
    """The target with what the pattern's ``*`` stands for put in place of its own."""
    before, after = F.substring_index(pattern, "*", 1), F.regexp_extract(pattern, r"\*(.*)$", 1)
    middle = spec.substr(F.length(before) + 1, F.length(spec) - F.length(before) - F.length(after))
    return F.when(F.contains(pattern, F.lit("*")), F.concat(F.substring_index(target, "*", 1), middle, F.regexp_extract(target, r"\*(.*)$", 1))).otherwise(target)


def is_restrictive(pattern: Column) -> Column:
    """It has something besides the ``*``."""
    return F.regexp_replace(pattern, r"\*", "") != ""
