"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A task turns its documents into one or a few chunks. A chunk holds its distinct words once, and its documents as
sequences of positions in that list. The words go, hashed into buckets, to the task that encodes each distinct word of
the corpus once; the ids go back to the chunk, and the chunk puts its documents together by position. What moves are
blocks of distinct words and packed positions, never a row for every token, and a word that holds a third of all
tokens is still one word a chunk.

Chunks are built twice from the same input, for the words and for the positions, so the input has to give the same rows
in the same order both times: a table or checkpoint does. A checksum guards this.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, pretok, vocab

WORDS = "chunk long, bucket int, payload binary"
#: Ids decoded at once; bounds the arrays of a task.
DECODED_AT_ONCE = 300_000
#: The bucket that stands for a chunk's checksum.
GUARD = -1
PLACES = "chunk long, part int, payload binary, counts binary, ids binary, guard binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(payload: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def unpack_words(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)).tolist()
    return [raw[s:e] for s, e in zip([4 + 4 * n, *ends], ends, strict=False)]


class _Chunk:
    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.place: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, list]] = []
        self.chars = 0

    def add(self, ids: list, texts: list[str], with_words: bool) -> None:
        pieces, of = [], []
        for i, text in enumerate(texts):
            for piece in pretok.cut(text) if len(text) > pretok.BATCH_CHARS else (text,):
                pieces.append(piece)
                of.append(i)
        words = pretok.split(pieces)
        codes, unique = words.distinct()
        place = self.place
        local = np.fromiter((place.setdefault(w, len(place)) for w in unique), np.int64, len(unique))
        if not with_words:
            counts = np.bincount(np.array(of, np.int64), np.diff(words.offsets), len(texts))
            self.parts.append((local[codes], counts, ids))
        self.chars += len(words.big)

    def order(self) -> tuple[list[bytes], np.ndarray, np.ndarray, bytes]:
        """The words, their order by bucket, their buckets in that order, and a checksum of the list."""
        words = [w.encode("utf-8") for w in self.place]
        bucket = np.fromiter((zlib.crc32(w) % self.buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        return words, order, bucket[order], hashlib.sha256(b"\0".join([*words, str(len(words)).encode()])).digest()

    def word_rows(self) -> Iterator[tuple]:
        words, order, bucket, guard = self.order()
        if not len(order):
            return
        yield self.number, GUARD, guard
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            yield self.number, int(bucket[s]), pack_words([words[k] for k in order[s:e].tolist()])

    def place_rows(self) -> Iterator[tuple]:
        _, order, _, guard = self.order()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for part, (local, counts, ids) in enumerate(self.parts):
            yield self.number, part, pack(rank[local]), pack(counts), ids, guard


def _ipc(array: pa.Array) -> bytes:
    """An array of ids of any type, as bytes."""
    batch = pa.record_batch([array], ["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@common.tidy
def _chunked(batches: Iterator[pa.RecordBatch], with_words: bool, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())]) if with_words else pa.schema([("chunk", pa.int64()), ("part", pa.int32()), *((n, pa.binary()) for n in ("payload", "counts", "ids", "guard"))])
    number = TaskContext.get().partitionId() << 24
    chunk = _Chunk(number, buckets)

    def rows(done: _Chunk) -> Iterator[pa.RecordBatch]:
        for row in done.word_rows() if with_words else done.place_rows():
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for part in common.slices(batch, "text", pretok.BATCH_CHARS):
            chunk.add(_ipc(part.column("id")), common.texts(part.column("text")), with_words)
            if chunk.chars >= limit:
                yield from rows(chunk)
                chunk = _Chunk(chunk.number + 1, buckets)
    yield from rows(chunk)


@common.tidy
def _encoded(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    """Ids of each block's words. Blocks come by bucket, so a bucket's words are kept only while it lasts."""
    encode, bucket, known = vocab.word_encoder(ranks.value), None, {}
    for batch in batches:
        for chunk, own, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own == GUARD:
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([own], pa.int32()), pa.array([payload], pa.binary())], names=["chunk", "bucket", "payload"])
                continue
            if own != bucket:
                bucket, known = own, {}
            ids = []
            for word in unpack_words(payload):
                if (found := known.get(word)) is None:
                    known[word] = found = encode(word.decode("utf-8"))
                ids.append(found)
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([own], pa.int32()), pa.array([pack(np.concatenate([[len(ids)], sizes, flat]))], pa.binary())], names=["chunk", "bucket", "payload"])


def _joined(replies: pa.Table, places: pa.Table, id_type: pa.DataType) -> pa.Table:
    """The documents of a chunk: ids of its words by position."""
    schema = pa.schema([("id", id_type), ("ids", pa.list_(pa.int32()))])
    sizes, flats, guards = [], [], set(places["guard"].to_pylist())
    for bucket, payload in sorted(zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist(), strict=True)):
        if bucket == GUARD:
            guards.add(payload)
            continue
        values = unpack(payload)
        sizes.append(values[1 : 1 + values[0]])
        flats.append(values[1 + values[0] :])
    size, pool = (np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int64) for x in (sizes, flats))
    start = np.cumsum(size) - size
    if len(guards) > 1 or len(size) and not len(places):
        raise RuntimeError("the input gave other rows when it was read again; write it before encoding")
    out = []
    for _, payload, counts, ids in sorted(zip(*(places[c].to_pylist() for c in ("part", "payload", "counts", "ids")), strict=True)):
        at, count = unpack(payload).astype(np.int64), unpack(counts).astype(np.int64)
        tokens = size[at]
        ends = np.concatenate([[0], np.cumsum(tokens)])[np.concatenate([[0], np.cumsum(count)])]
        flat = pool[pretok.ragged(start[at], tokens)].astype(np.int32)
        own = pa.ipc.open_stream(ids).read_all()["id"].combine_chunks()
        out.append(pa.table([own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, chunk_chars: int = 16_000_000, buckets: int | None = None) -> DataFrame:
    """(id, ids array<int>) for every row, in no special order.

    Each match of the pattern is encoded separately by the ranks of the .tiktoken file, without special tokens. Null
    and empty texts have no ids; repeated rows give repeated rows; a null id stays null. Other columns are not read.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(vocab.load_ranks(vocab_path or vocab.default_path("byte_bpe_50k.tiktoken")))  # a vocabulary file's size
    buckets = buckets or 2 * max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = common.pick(df, id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_field, id_type = rows.schema["id"].dataType, to_arrow_type(rows.schema["id"].dataType)
    made = functools.partial(_chunked, buckets=buckets, limit=chunk_chars)
    blocks = rows.mapInArrow(functools.partial(made, with_words=True), WORDS)
    ids = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(functools.partial(_encoded, ranks=ranks), WORDS)
    places = rows.mapInArrow(functools.partial(made, with_words=False), PLACES)
    joined = functools.partial(_joined, id_type=id_type)
    return ids.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(lambda a, b: joined(a, b), f"id {id_field.simpleString()}, ids array<int>")


@common.tidy
def _decoded(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    blob, sizes = table.value
    starts = np.cumsum(sizes) - sizes
    for batch in batches:
        counts = np.asarray(batch.column("ids").value_lengths().fill_null(0), np.int64)
        for begin, end in pretok.batches(counts.tolist(), DECODED_AT_ONCE):
            rows = batch.slice(begin, end - begin)
            ids = np.asarray(rows.column("ids").flatten())  # null lists have none
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            size = sizes[ids]
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts[begin:end])])]
            raw = blob[pretok.ragged(starts[ids], size)]
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - begin, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.record_batch([rows.column("id"), rows.column("ids"), out], names=["id", "ids", "decoded"])


def decode(encoded: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """Adds decoded (binary) to rows of (id, ids): each id joins the token-byte table, whose size is a vocabulary's.

    Null and empty ids decode to no bytes; an id that the vocabulary lacks is an error.
    """
    ranks = vocab.load_ranks(vocab_path or vocab.default_path("byte_bpe_50k.tiktoken"))
    top = max(ranks.values()) + 1
    tokens = {i: t for t, i in ranks.items()}
    sizes = np.array([len(tokens[i]) if i in tokens else 0 for i in range(top)], np.int64)
    blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(top)), np.uint8)
    shared = encoded.sparkSession.sparkContext.broadcast((blob, sizes))
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(functools.partial(_decoded, table=shared), f"id {kind}, ids array<int>, decoded binary")


def digests(documents: DataFrame) -> DataFrame:
    """Encodes and decodes every text; the contract's columns."""
    rows = decode(encode(documents))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
