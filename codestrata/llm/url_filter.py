"""URL filters: allow and block entries in a trie over reversed host labels and path segments; the longest match wins.

An entry is a host and a path. It fits its host and all subdomains of it, for URLs whose path starts with the entry's
(an empty path fits any). Of the entries that fit, the longest (host and path together) decides; at equal length the
longer host does, and a block entry beats an allow entry. The trie is broadcast if the entries are few enough;
otherwise the URLs' host suffixes and folders are joined with the entries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common

Entry = tuple[str, str, str]
#: Entries that a trie may have to be broadcast, and characters in them.
MOST_ENTRIES, MOST_CHARS = 200_000, 16_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rank(entry: Entry) -> tuple:
    verdict, host, path = entry
    return len(host) + len(path), len(host), verdict == "block"


class _Node:
    __slots__ = ("here", "labels", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.tails: dict[str, Entry] = {}  # beginnings of the next segment
        self.here: Entry | None = None  # entry without a path


class Trie:
    def __init__(self, entries: Iterable[Entry]):
        self.root = _Node()
        for entry in entries:
            verdict, host, path = entry
            if verdict not in ("allow", "block") or path and path[0] != "/":
                raise ValueError(f"not an entry: {entry}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, _Node())
            if not path:
                node.here = max((x for x in (node.here, entry) if x), key=rank)
                continue
            *folders, tail = path[1:].split("/")
            for segment in folders:
                node = node.segments.setdefault(segment, _Node())
            node.tails[tail] = max((x for x in (node.tails.get(tail), entry) if x), key=rank)

    def match(self, host: str, path: str) -> Entry | None:
        found = []
        segments = path[1:].split("/") if path else []
        node, labels = self.root, iter(reversed(host.split(".")))
        while node:
            if node.here:
                found.append(node.here)
            at = node
            for segment in segments:
                found += (entry for tail, entry in at.tails.items() if segment.startswith(tail)) if len(at.tails) <= len(segment) else (at.tails[segment[:k]] for k in range(len(segment) + 1) if segment[:k] in at.tails)
                if (at := at.segments.get(segment)) is None:
                    break
            node = node.labels.get(next(labels, None))
        return max(found, key=rank, default=None)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


@common.tidy
def _judged(batches: Iterator[pa.RecordBatch], trie, default: str) -> Iterator[pa.RecordBatch]:
    match = functools.lru_cache(1 << 16)(trie.value.match)
    for batch in batches:
        found = [match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        rules = pa.array([f[1] + f[2] if f else None for f in found], pa.string())
        verdicts = pa.array([f[0] if f else default for f in found], pa.string())
        yield pa.record_batch([*batch.columns, rules, verdicts], names=[*batch.schema.names, "rule", "verdict"])


def judge(df: DataFrame, entries: list[Entry], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row; without a fitting entry rule is null and verdict the default.

    Null URLs have an empty host and path, which only an entry without both fits. Repeated rows stay.
    """
    rows = common.pick(df, id=id_col, url=url_col)
    host, path = parts(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    if len(entries) > most_entries or sum(len(h) + len(p) for _, h, p in entries) > MOST_CHARS:
        return _judged_by_join(rows, df.sparkSession.createDataFrame(entries, "verdict string, rule_host string, rule_path string"), default)
    trie = df.sparkSession.sparkContext.broadcast(Trie(entries))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_judged, trie=trie, default=default), f"id {kind}, host string, path string, rule string, verdict string")


def _judged_by_join(rows: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join of host suffix and folder, for entry lists that are too large to broadcast."""
    folder = F.regexp_extract("rule_path", "^(.*/)?", 1)
    entries = entries.select(F.concat_ws(" ", "rule_host", folder).alias("key"), "verdict", "rule_host", "rule_path")
    urls = rows.select("host", "path").distinct()
    labels, segments = F.split("host", "\\.", -1), F.split("path", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels) + 1), lambda k: F.when(k > F.size(labels), "").otherwise(F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    folders = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda k: F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))))
    keys = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"), folders.alias("folders")).select("host", "path", F.explode("folders").alias("folder"), "suffix").select("host", "path", F.concat_ws(" ", "suffix", "folder").alias("key"))
    fits = keys.join(entries, "key").where(F.startswith("path", "rule_path"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
