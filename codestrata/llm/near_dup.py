"""Near-duplicates by HyperMinHash.

1. A document's set of shingle hashes gives a HyperMinHash sketch: the hash range is cut into buckets, and a register
   keeps, of the least hash in its bucket, the number of leading zeros and the mantissa bits after them.
2. Documents with equal sets form a class. Bands of registers are hashed; the classes that share a band form a bucket,
   and the least class of the bucket is its leader. A leader's group is all classes of all its buckets, so two classes
   with a common band have a common group, which is handled once however many bands they share.
3. In a group, registers give a collision-corrected estimate of each Jaccard similarity. A class stays if its estimate
   with some other one is not below the threshold by more than chance explains (one in 10**9).
4. The classes that stay are compared on their full sets, read from the texts again. A task emits the links of a
   spanning forest of its group only. A group of more than ``block`` classes, or of more shingles than
   ``block_shingles``, is cut into blocks, so that no task holds a group of any size. Each block also gets a few pivots
   of its group. Classes that its links connect with the group's anchor, the pivot most like the others, are one
   component and need not meet again: only the others meet all of the group, block by block. So a large group of near
   copies is read a few times, not once a block.
5. Connected components by alternating stars, with the links in the shared folder after each round.

A link is missed if no band agrees: with 40 bands of 5 registers about 1 in 10**7 at a similarity of 0.8, less above.
A class is known by a digest of its set's 128-bit hashes; links are confirmed on the words themselves.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, pretok, words

EMPTY = 0xFFFF
#: Rows of a list of groups or classes (some 50 bytes each) that is broadcast, at most; longer ones are joined by shuffling.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Params:
    """What is linked, and how it is sought."""

    shingle: int = 5
    percent: int = 80  # least similarity
    bands: int = 40
    rows: int = 5  # registers of a band
    mantissa: int = 10
    block: int = 1024
    block_shingles: int = 2_000_000
    pivots: int = 16  # of a group in blocks, about

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers(hashes: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """(texts, registers) of ascending hashes: leading zeros and mantissa of each bucket's least, EMPTY without any."""
    out = np.full((len(offsets) - 1, p.registers), EMPTY, np.uint16)
    if not len(hashes):
        return out
    n = np.uint64(p.registers)
    bucket = ((hashes >> np.uint64(32)) * n + (((hashes & np.uint64(0xFFFFFFFF)) * n) >> np.uint64(32))) >> np.uint64(32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])])
    rest = hashes[first] * n  # the place in the bucket, as a fraction of 2**64
    zeros = np.clip(64 - np.ceil(np.log2(rest.astype(np.float64) + 1)), 0, 62).astype(np.int64)
    zeros += ((rest << zeros.astype(np.uint64)) >> np.uint64(63) == 0) & (zeros < 62)  # rounding of the logarithm
    zeros -= (rest >> (64 - zeros).astype(np.uint64) != 0) & (zeros > 0)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - p.mantissa)
    out[text[first], bucket[first].astype(np.int64)] = zeros.astype(np.uint64) << np.uint64(p.mantissa) | mantissa
    return out


def band_keys(regs: np.ndarray, p: Params) -> np.ndarray:
    """(texts, bands) 64-bit keys; 0 for a band of empty registers."""
    cells = regs.reshape(len(regs), p.bands, p.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cells.shape[:2]).copy()
    for r in range(p.rows):
        key = pretok.mix((key ^ cells[:, :, r]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r + 1))
    key[(cells == EMPTY).all(axis=2)] = 0
    return key


def may_link(one: np.ndarray, many: np.ndarray, p: Params) -> np.ndarray:
    """Whether the estimated similarity of one sketch with each of many leaves a link possible."""
    used = (one != EMPTY) | (many != EMPTY)
    n = used.sum(axis=1)
    equal = ((one == many) & used).sum(axis=1)
    by_chance = n * 0.17 / (1 << p.mantissa)  # equal registers of different least hashes
    margin = np.sqrt(np.log(1e9) / (2 * np.maximum(n, 1)))
    return equal - by_chance >= (p.percent / 100 - margin) * n


def class_keys(high: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """Digests of whole sets of 128-bit hashes, None for empty sets."""
    edges, a, b = (8 * offsets).tolist(), high.tobytes(), low.tobytes()
    return [hashlib.blake2b(a[s:e] + b[s:e], digest_size=16).digest() if e > s else None for s, e in zip(edges, edges[1:], strict=False)]


@common.tidy
def _sketched(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            hashes, low, offsets = words.sets(common.texts(part.column("text")), p.shingle)
            regs, keys = registers(hashes, offsets, p), class_keys(hashes, low, offsets)
            sketch = [r if k else None for r, k in zip((x.tobytes() for x in regs), keys, strict=True)]
            yield pa.record_batch([part.column("id"), part.column("text_hash"), pa.array(np.diff(offsets)), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())], names=["id", "text_hash", "n_shingles", "key", "registers"])


@common.tidy
def _banded(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            regs = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, p.registers)
            bands = band_keys(regs, p)
            of, band = np.nonzero(bands)
            yield pa.record_batch([pa.array(bands[of, band].view(np.int64)), part.column("key").take(pa.array(of)), part.column("n_shingles").take(pa.array(of))], names=["band", "key", "n_shingles"])


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with the same values in the columns. Those rows have to fit a task."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        begin = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, key
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


GROUP = ["leader", "i", "j"]


@common.tidy
def _estimated(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The members of each group that some other one may be linked with."""
    for group in _runs(batches, GROUP):
        if len(group) < 2:
            continue
        regs = np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint16).reshape(-1, p.registers)
        n = group["n_shingles"].to_numpy()
        own = group["own"].to_numpy()
        across = group["i"][0].as_py() != group["j"][0].as_py()
        stays = np.zeros(len(n), bool)
        for k in range(len(n) - 1):
            rest = slice(k + 1, None)
            near = 100 * np.minimum(n[k], n[rest]) >= p.percent * np.maximum(n[k], n[rest])
            if across:
                near &= own[rest] != own[k]
            at = np.flatnonzero(near) + k + 1
            if len(at) and (hit := at[may_link(regs[k], regs[at], p)]).size:
                stays[k] = stays[hit] = True
        if stays.any():
            yield group.select([*GROUP, "key", "first"]).filter(pa.array(stays)).combine_chunks().to_batches()[0]


def linked(codes: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """For each set of numbers its component's first member, by similarities of full sets."""
    n = np.diff(offsets)
    root = np.arange(len(n))
    _, code, times = np.unique(codes, return_inverse=True, return_counts=True)
    of = np.repeat(root, n)
    shared = times[code] > 1
    # No set can be linked that has too few hashes in common with all others together.
    can = 100 * np.bincount(of, shared, len(n)) >= percent * n
    can &= n > 0
    if can.sum() < 2:
        return root
    place = np.cumsum(can) - 1
    keep = shared & can[of]
    _, column = np.unique(code[keep], return_inverse=True)
    row = place[of[keep]]
    common_ = np.zeros((int(can.sum()),) * 2, np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, total, 2048):
        s, e = np.searchsorted(column, [begin, begin + 2048])
        cells = np.zeros((len(common_), min(2048, total - begin)), np.float32)
        cells[row[s:e], column[s:e] - begin] = 1
        common_ += cells @ cells.T
    size = n[can]
    union = size[:, None] + size[None, :] - common_
    link = 100.0 * common_ >= float(percent) * union
    np.fill_diagonal(link, False)
    who, left = np.flatnonzero(can), np.ones(len(size), bool)
    for k in range(len(size)):
        if left[k]:
            front, left[k] = np.array([k]), False
            while len(front):
                front = np.flatnonzero(link[front].any(axis=0) & left)
                left[front] = False
                root[who[front]] = who[k]
    return root


@common.tidy
def _anchors(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Of each group's pivots the one that most others may be linked with."""
    for group in _runs(batches, ["leader"]):
        regs = np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint16).reshape(-1, p.registers)
        near = [int(may_link(r, regs, p).sum()) for r in regs]
        yield pa.record_batch([group["leader"].slice(0, 1).combine_chunks(), group["key"].slice(int(np.argmax(near)), 1).combine_chunks()], names=["leader", "anchor"])


@common.tidy
def _verified(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Links of each group's members with the first of their component."""
    for group in _runs(batches, GROUP):
        if len(group) < 2:
            continue
        keys = group["key"].to_pylist()
        root = linked(*words.codes(common.texts(group["text"].combine_chunks()), p.shingle), p.percent)
        moved = np.flatnonzero(root != np.arange(len(root))).tolist()
        if moved:
            pairs = [sorted((keys[k], keys[root[k]])) for k in moved]
            yield pa.record_batch([pa.array([group["leader"][0].as_py()] * len(pairs), pa.binary()), pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["leader", "a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(key, root) for the ends of links (a, b): the least key of each component, by alternating large and small stars.

    A node's links are met by a join, never gathered, so a node with very many links is dealt out like any other.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
        pairs = both.join(least, both.a == least.node)
        if large:
            out = pairs.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = pairs.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def sum_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = common.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = sum_of(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = common.written(star(star(edges, True), False))
        if (now := sum_of(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n_shingles, component, kept) for every row: the least id that links lead to, and whether it is the row's own.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is one
    shingle; null, empty and blank texts have none and are linked with nothing. Repeated rows share their component.
    Null ids are never a component's name; their rows are not kept.
    """
    rows = common.pick(df, id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sketches = common.written(rows.mapInArrow(functools.partial(_sketched, p=p), f"id {kind}, text_hash long, n_shingles long, key binary, registers binary"))
    # one: the row whose text stands for the class
    classes = common.written(sketches.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.min(F.struct("id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")))
    bands = classes.select("key", "n_shingles", "registers").mapInArrow(functools.partial(_banded, p=p), "band long, key binary, n_shingles long")
    leaders = bands.groupBy("band").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    members = common.written(bands.join(leaders, "band").select("leader", "key", "n_shingles").distinct())

    links = _links(rows, classes, members, p)
    roots = components(links)

    named = classes.select("key", "id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    of_key = named.join(least, "root").select(F.col("key").alias("of"), "component")
    out = sketches.select("id", "n_shingles", "key").join(of_key, F.col("key") == F.col("of"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", "n_shingles", component.alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def _checked(dealt: DataFrame, rows: DataFrame, classes: DataFrame, p: Params, few: bool = False) -> DataFrame:
    """Links (leader, a, b) inside the groups of dealt (leader, i, j, own, key, first), written.

    few: only some classes are expected, so that the other texts needn't be shuffled to find theirs.
    """
    sketched = dealt.join(classes.select("key", "n_shingles", "registers"), "key").select(*GROUP, "own", "key", "first", "n_shingles", "registers")
    stays = common.written(sketched.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(functools.partial(_estimated, p=p), "leader binary, i int, j int, key binary, first boolean"))
    ones = stays.select("key").distinct().join(classes.select("key", "one"), "key").select("key", F.col("one.id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    if few:
        ones = common.written(ones)
        few = ones.count() <= BROADCAST_ROWS
    found = rows.join(ones.hint("broadcast" if few else "shuffle_hash"), (rows["text_hash"] == ones["one_hash"]) & rows["id"].eqNullSafe(ones["one_id"])).select("key", "text")
    # Other texts with the row's id and hash are left out by the key, and repeated rows by the grouping.
    found = found.mapInArrow(functools.partial(_of_class, p=p), "key binary, text string").groupBy("key").agg(F.first("text").alias("text"))
    full = stays.join(found, "key").select(*GROUP, "key", "first", "text")
    full = full.repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("first")).mapInArrow(functools.partial(_verified, p=p), "leader binary, a binary, b binary")
    return common.written(full)


def _links(rows: DataFrame, classes: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) that connect what the groups' links connect. members: (leader, key, n_shingles)."""
    parts = F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum("n_shingles") / p.block_shingles)).cast("int")
    size = common.written(members.groupBy("leader").agg(parts.alias("blocks"), F.count("*").alias("n")).where("blocks > 1"))
    groups = size.count()
    small = F.broadcast if groups <= BROADCAST_ROWS else (lambda df: df)
    no = F.lit(False)
    dealt = members.join(small(size.select("leader")), "leader", "left_anti").select("leader", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "key", no.alias("first"))
    if not groups:
        return _checked(dealt, rows, classes, p).select("a", "b")

    part = lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")
    big = members.join(small(size), "leader").withColumn("own", part("blocks"))
    pivots = big.where((F.pmod(F.xxhash64("key", F.lit(1)), F.col("n")) < p.pivots) | (F.col("key") == F.col("leader")))
    sketched = pivots.join(classes.select("key", "registers"), "key").select("leader", "key", "registers")
    anchors = common.written(sketched.repartition("leader").sortWithinPartitions("leader", "key").mapInArrow(functools.partial(_anchors, p=p), "leader binary, anchor binary"))
    spread = pivots.select("leader", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")).where("at <> own").select("leader", "key", "at")
    blocks = big.select("leader", "key", F.col("own").alias("at")).unionByName(spread).join(small(anchors), "leader")
    dealt = dealt.unionByName(blocks.select("leader", F.col("at").alias("i"), F.col("at").alias("j"), F.col("at").alias("own"), "key", (F.col("key") == F.col("anchor")).alias("first")))
    inside = _checked(dealt, rows, classes, p)

    to_anchor = inside.join(small(anchors), "leader").where("anchor in (a, b)")
    held = to_anchor.select("leader", F.when(F.col("a") == F.col("anchor"), F.col("b")).otherwise(F.col("a")).alias("key"))
    held = held.unionByName(anchors.withColumnRenamed("anchor", "key")).distinct().withColumn("held", F.lit(True))
    told = common.written(members.join(small(size.select("leader")), "leader").join(held, ["leader", "key"], "left").withColumn("held", F.coalesce("held", no)))
    count = told.groupBy("leader", "held").agg(parts.alias("blocks"))
    left = common.written(count.where("not held").select("leader", F.col("blocks").alias("u")).join(count.where("held").select("leader", F.col("blocks").alias("h")), "leader"))
    if left.isEmpty():
        return inside.select("a", "b")
    told = told.join(small(left), "leader")
    free = told.where("not held").withColumn("own", part("u"))
    # Blocks of what the anchor doesn't hold meet each other, and each block of what it holds.
    among = free.select("leader", "key", "own", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("other")).select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key")
    across = free.select("leader", "key", "own", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("q")).select("leader", F.col("own").alias("i"), (-1 - F.col("q")).alias("j"), "own", "key")
    met = told.where("held").withColumn("q", part("h")).select("leader", "key", "q", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("i")).select("leader", "i", (-1 - F.col("q")).alias("j"), F.lit(-1).alias("own"), "key")
    between = _checked(among.unionByName(across).unionByName(met).withColumn("first", no), rows, classes, p, few=True)
    return inside.select("a", "b").union(between.select("a", "b"))


@common.tidy
def _of_class(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", words.BATCH_BYTES):
            found = class_keys(*words.sets(common.texts(part.column("text")), p.shingle))
            yield part.select(["key", "text"]).filter(pa.array([a == b for a, b in zip(found, part.column("key").to_pylist(), strict=True)]))


#: The contract's parameters.
CONTRACT = Params(shingle=4)


def contract(documents: DataFrame) -> DataFrame:
    return clusters(documents, p=CONTRACT).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
