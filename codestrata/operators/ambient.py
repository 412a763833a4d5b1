"""Modules that installed packages declare for everyone, so that specifiers of them lead somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import specifiers
from codestrata.plans.lineage import written

#: Packages that are looked at, at most, and what declares a module.
MOST_PACKAGES = 600
DECLARES = r"""(?<![\w$.])(?:declare\s+)?module\s+(?:'([^'\n]+)'|"([^"\n]+)")"""
#: Strings, and comments, which declare nothing; strings go first, as ``'@a/*'`` begins no comment.
COMMENTS = r"""('[^'\n]*'|"[^"\n]*")|/\*[\s\S]*?\*/|//[^\n]*"""


def visited(dependencies: DataFrame, roots: DataFrame, most: int = MOST_PACKAGES) -> DataFrame:
    """(package) that the roots lead to by (package, dependency), the nearest first, up to the bound of the feature."""
    done = written(roots.select("package").distinct().orderBy("package").limit(most))
    front = done
    while (room := most - done.count()) > 0:
        steps = dependencies.join(front, "package", "left_semi").select(F.col("dependency").alias("package")).distinct()
        front = written(steps.join(done, "package", "left_anti").orderBy("package").limit(room))
        if front.isEmpty():
            break
        done = written(done.unionByName(front))
    return done


def patterns(typings: DataFrame, packages: DataFrame) -> DataFrame:
    """(pattern) that the typings (package, text) of the packages declare, comments aside; a star stands for anything.

    Both may have a dir, the folder of a manifest, which the patterns then have too. A star alone would fit everything
    and proves nothing.
    """
    keys = [c for c in ("dir",) if c in typings.columns]
    own = typings.join(packages, [*keys, "package"], "left_semi").select(*keys, F.regexp_replace("text", COMMENTS, "$1 ").alias("text"))
    names = F.concat(F.regexp_extract_all("text", F.lit(DECLARES), F.lit(1)), F.regexp_extract_all("text", F.lit(DECLARES), F.lit(2)))
    return own.select(*keys, F.explode(names).alias("pattern")).where("pattern not in ('', '*')").where(~F.startswith("pattern", F.lit("."))).distinct()


def resolvable(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, specifier) that a pattern, of the same dir if both have one, fits: plain names by an equi-join."""
    keys = [c for c in ("dir",) if c in declared.columns]
    named = refs.select(*keys, "file", "specifier").distinct()
    plain = named.join(declared.where("not contains(pattern, '*')").withColumnRenamed("pattern", "specifier"), [*keys, "specifier"], "left_semi")
    # Patterns with a star are few: at most as many as the bounded number of packages declares.
    starred = F.broadcast(declared.where("contains(pattern, '*')").select(*(F.col(k).alias(f"its_{k}") for k in keys), "pattern"))
    fits = specifiers.matches_alias(F.col("pattern"), F.col("specifier"))
    for k in keys:
        fits &= F.col(k) == F.col(f"its_{k}")
    return plain.select("file", "specifier").unionByName(named.join(starred, fits, "left_semi").select("file", "specifier")).distinct()
