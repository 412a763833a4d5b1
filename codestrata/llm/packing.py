"""Packing into training sequences: vector bin packing with the dot-product heuristic.

An item needs tokens, one segment and loss-bearing tokens, and a sequence has a limit for each. One sequence is open at
a time; it takes, of all items at hand that fit, the one whose needs have the greatest dot product with what the
sequence has left, both as shares of the limits. Where cutting is allowed, an item is cut to fill the rest, so that a
sequence is closed full. A task packs its own rows and holds a window of items at most, so nothing is shuffled; what
is left at a task's end becomes sequences whose lengths are powers of two.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, pretok, token_counts, vocab


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Packer:
    """place() takes items as (key, start, length, loss) and gives (key, start, length, sequence, offset).

    Loss-bearing tokens are the last of an item, as an answer follows its prompt. An item that exceeds a limit alone
    is an error unless it may be cut.
    """

    limits: Limits
    may_cut: bool
    window: int = 2048
    sequence: int = 0
    items: list = field(default_factory=list)

    def place(self, key, start: int, length: int, loss: int) -> Iterator[tuple]:
        most = self.limits
        if not self.may_cut and (length > most.tokens or loss > most.loss):
            raise ValueError(f"an item of {length} tokens, {loss} with loss, fits no sequence")
        while self.may_cut and length >= most.tokens and most.segments and loss == length and most.loss >= most.tokens:
            yield key, start, most.tokens, self.sequence, 0
            self.sequence += 1
            start, length, loss = start + most.tokens, length - most.tokens, loss - most.tokens
        if length:
            self.items.append((key, start, length, loss))
        if len(self.items) >= 2 * self.window:
            yield from self._pack(self.window)

    def _pack(self, keep: int) -> Iterator[tuple]:
        """Closes sequences until at most keep items are left; with keep 0 all items are placed."""
        most, items = self.limits, self.items
        limit = np.array([most.tokens, most.segments, most.loss], np.float64)
        need = np.array([[i[2], 1, i[3]] for i in items], np.float64).reshape(-1, 3)
        share, open_, left = need / np.maximum(limit, 1), np.ones(len(items), bool), len(items)
        last: list[tuple] = []
        while left > keep or (keep == 0 and left):
            room, at, taken = limit.copy(), 0, []
            while left:
                fits = open_ & (need <= room).all(axis=1)
                score = np.where(fits, share @ (room / np.maximum(limit, 1)), -1)
                k = int(score.argmax())
                if score[k] < 0:
                    break
                taken.append((k, items[k][1], items[k][2], at))
                at += items[k][2]
                room -= need[k]
                open_[k], left = False, left - 1
            if self.may_cut and left and room[0] >= 1 and room[1] >= 1 and room[2] >= 1:
                # The item with the most tokens gives its first ones; those that bear no loss come first.
                k = int(np.where(open_, need[:, 0], -1).argmax())
                key, start, length, loss = items[k]
                part = int(min(room[0], length - loss + room[2], length - 1))
                if part > 0:
                    taken.append((k, start, part, at))
                    at += part
                    items[k] = (key, start + part, length - part, min(loss, length - part))
                    need[k] = items[k][2], 1, items[k][3]
                    share[k] = need[k] / np.maximum(limit, 1)
            if not taken:
                raise ValueError("an item fits no sequence")
            if left or at == most.tokens or not self.may_cut:
                for k, start, length, offset in taken:
                    yield items[k][0], start, length, self.sequence, offset
                self.sequence += 1
            else:
                last = [(items[k][0], start, length) for k, start, length, _ in taken]
        self.items = [items[k] for k in np.flatnonzero(open_).tolist()]
        total = sum(length for *_, length in last)
        while total:  # what is left, in sequences of the powers of two that it is the sum of
            size, at = 1 << (total.bit_length() - 1), 0
            while at < size:
                key, start, length = last.pop(0)
                part = min(length, size - at)
                yield key, start, part, self.sequence, at
                at += part
                if part < length:
                    last.insert(0, (key, start + part, length - part))
            self.sequence += 1
            total -= size

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)


@common.tidy
def _packed(batches: Iterator[pa.RecordBatch], ranks, limits: Limits, end_id: int, special: str | None, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    store = vocab.shared_store(ranks)
    packer = Packer(limits, may_cut=True, sequence=TaskContext.get().partitionId() << 40)
    held: dict[int, list] = {}  # number of a document that is not wholly placed: id, ids, tokens not placed
    names, kinds = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"], [id_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
    number = 0

    def rows(placed: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for key, start, length, sequence, offset in placed:
            doc = held[key]
            for column, value in zip(out, (doc[0], start, length, doc[1][start : start + length].tobytes(), len(doc[1]), sequence, offset), strict=True):
                column.append(value)
            doc[2] -= length
            if not doc[2]:
                del held[key]
        if out[0]:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    for batch in batches:
        for part in common.slices(batch, "text", pretok.BATCH_CHARS):
            pieces, last, split = [], [], []  # last: it ends its document; split: a special string follows
            for text in common.texts(part.column("text")):
                sections = text.split(special) if special and special in text else [text]
                for j, section in enumerate(sections):
                    own = list(pretok.cut(section)) if len(section) > pretok.BATCH_CHARS else [section]
                    pieces += own
                    last += [False] * (len(own) - 1) + [j == len(sections) - 1]
                    split += [False] * (len(own) - 1) + [j < len(sections) - 1]
            flat, edge = store.encode_all(pieces)
            ends = edge[1:]
            add = np.flatnonzero(np.array(last) | np.array(split))
            flat = np.insert(flat, ends[add], np.where(np.array(last)[add], end_id, vocab.SPECIAL_ID).astype(np.uint32))
            ends = (ends + np.cumsum(np.array(last, int) + np.array(split, int)))[np.array(last, bool)]

            def placed(ids=part.column("id").to_pylist(), flat=flat.astype("<u4"), ends=ends) -> Iterator[tuple]:
                nonlocal number
                start = 0
                for own, end in zip(ids, ends.tolist(), strict=True):
                    held[number] = [own, flat[start:end].copy(), end - start]  # not a view: the batch may go
                    yield from packer.place(number, 0, end - start, end - start)
                    number, start = number + 1, end

            yield from rows(placed())
    yield from rows(packer.finish())


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """Pieces (id, start, length, ids binary of little-endian 32-bit numbers, doc_tokens, sequence_id, offset).

    A document's tokens are the vocabulary's ids of its whole text, special strings inside it being one token, and
    end_id. All tokens bear loss and documents may be cut. Null and empty texts are end_id alone; repeated rows are
    packed as often as they come.
    """
    path = vocab_path or vocab.default_path("byte_bpe_50k.json")
    ranks = df.sparkSession.sparkContext.broadcast(vocab.load_json_ranks(path))  # a vocabulary file's size
    rows = common.pick(df, id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    run = functools.partial(_packed, ranks=ranks, limits=limits, end_id=end_id, special=vocab.SPECIAL, id_type=to_arrow_type(kind))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


@common.tidy
def _examples(batches: Iterator[pa.RecordBatch], limits: Limits, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits, may_cut=False, sequence=TaskContext.get().partitionId() << 40)
    schema = pa.schema([("id", id_type), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def rows(placed) -> Iterator[pa.RecordBatch]:
        if got := list(placed):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*((k, n, s, o) for k, _, n, s, o in got), strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        yield from rows(x for i, n, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in packer.place(i, 0, n or 0, min(loss or 0, n or 0)))
    yield from rows(packer.finish())


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """(id, length, sequence_id, offset) of examples that are never cut, by their tokens and loss-bearing tokens.

    Examples of no (or null) tokens are left out; one that exceeds a limit alone is an error.
    """
    rows = common.pick(df, id=id_col, tokens=tokens_col, loss=loss_col).select("id", F.col("tokens").cast("long"), F.col("loss").cast("long"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    return rows.mapInArrow(functools.partial(_examples, limits=limits, id_type=to_arrow_type(kind)), f"id {kind.simpleString()}, length long, sequence_id long, offset long")


def place_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """(id, length, sequence_id, offset, reason) of all examples, packed as by pack_examples.

    One that can't be packed has no sequence and offset, and a reason: ``empty``, ``tokens`` or ``loss``, the limit that
    it exceeds alone.
    """
    n = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    reason = F.when(n <= 0, "empty").when(n > limits.tokens, "tokens").when(F.least(F.coalesce(F.col("loss").cast("long"), F.lit(0)), n) > limits.loss, "loss")
    rows = common.pick(df, id=id_col, tokens=tokens_col, loss=loss_col).withColumn("reason", reason)
    packed = pack_examples(rows.where("reason is null"), "id", "tokens", "loss", limits).withColumn("reason", F.lit(None).cast("string"))
    none = F.lit(None).cast("long")
    return packed.unionByName(rows.where("reason is not null").select("id", F.col("tokens").cast("long").alias("length"), none.alias("sequence_id"), none.alias("offset"), "reason"))


def conversation_examples(conversations: DataFrame, assistant: str = "assistant", vocab_path: str | None = None) -> DataFrame:
    """(conv_id, tokens, loss): the tokens of each conversation's turns, and of those that the assistant says.

    Turns of null texts have no tokens; a null role bears no loss; turns without a conv_id form one conversation.
    """
    rows = common.pick(conversations, conv_id="conv_id", role="role", text="text")
    rows = rows.select(F.struct("conv_id", (F.coalesce("role", F.lit("")) == assistant).alias("said")).alias("turn"), "text")
    counted = token_counts.count_tokens(rows, id_col="turn", vocab_path=vocab_path)
    said = F.when(F.col("id.said"), F.col("n_tokens")).otherwise(0)
    return counted.groupBy(F.col("id.conv_id").alias("conv_id")).agg(F.sum("n_tokens").alias("tokens"), F.sum(said).alias("loss"))


def pieces(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack_documents(documents).select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
