"""Token counts of whole texts; huge texts are encoded in overlapping chunks and put together where both chunks agree.

Scanning for pre-tokens looks only forward. So, if a chunk that is known to be in step and the next chunk both begin a
pre-token at some place, the next chunk is in step from there on: such a place is a proven boundary, and the counts are
spliced there. Where the overlap has none, it is widened; at worst the next chunk begins at the last proven boundary.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, pretok, vocab

#: Characters before a chunk's end whose pre-tokens the cut may have changed: more than the longest contraction.
EDGE = 8

Encoded = tuple[np.ndarray, np.ndarray]


def spliced(text: str, encode: Callable[[str], Encoded], chunk_chars: int, overlap: int) -> int:
    """Tokens of one text. encode(piece) gives where the piece's pre-tokens begin and how many tokens each has."""
    n, total, done = len(text), 0, 0  # done: a proven boundary, all tokens before it are in total
    begin, end = 0, min(n, chunk_chars)
    starts, counts = encode(text[:end])
    while end < n:
        wide = overlap
        while True:
            after = max(done, end - wide)
            size = chunk_chars if after > done else 2 * max(chunk_chars, end - done)
            after_end = min(n, max(after + size, end + 1))
            next_starts, next_counts = encode(text[after:after_end])
            both = np.intersect1d(starts + begin, next_starts + after, assume_unique=True)
            both = both[(both >= done) & (both <= max(done, end - EDGE))]
            if len(both):
                break
            wide *= 2
        cut = int(both[-1])
        mine = (starts + begin >= done) & (starts + begin < cut)
        total += int(counts[mine].sum())
        done, begin, end, starts, counts = cut, after, after_end, next_starts, next_counts
    return total + int(counts[starts + begin >= done].sum())


@common.tidy
def _counted(batches: Iterator[pa.RecordBatch], ranks, chunk_chars: int, overlap: int, special: str | None) -> Iterator[pa.RecordBatch]:
    store = vocab.shared_store(ranks)

    def encode(piece: str) -> Encoded:
        words = pretok.split([piece])
        at = store.look_up(words)
        return words.starts, store.sizes[at]

    for batch in batches:
        for part in common.slices(batch, "text", pretok.BATCH_CHARS):
            texts = common.texts(part.column("text"))
            counts = np.zeros(len(texts), np.int64)
            pieces, of = [], []
            for i, text in enumerate(texts):
                sections = text.split(special) if special and special in text else [text]
                counts[i] += len(sections) - 1  # a special string in the text is one token, and what is around it stands alone
                for section in sections:
                    if len(section) > chunk_chars:
                        counts[i] += spliced(section, encode, chunk_chars, overlap)
                    else:
                        pieces.append(section)
                        of.append(i)
            words = pretok.split(pieces)
            at = store.look_up(words)
            before = np.concatenate([[0], np.cumsum(store.sizes[at])])
            np.add.at(counts, of, np.diff(before[words.offsets]))
            yield pa.record_batch([part.column("id"), part.column("n_bytes"), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, chunk_chars: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row, as the vocabulary's library counts, without begin or end tokens.

    Special strings inside texts are one token each, the library's default. Null and empty texts have 0 tokens and
    bytes; repeated rows stay; null ids stay. Texts of more than chunk_chars characters go in overlapping chunks.
    """
    path = vocab_path or vocab.default_path("byte_bpe_50k.json")
    ranks = df.sparkSession.sparkContext.broadcast(vocab.load_json_ranks(path))  # a vocabulary file's size
    rows = common.pick(df, id=id_col, text=text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_counted, ranks=ranks, chunk_chars=chunk_chars, overlap=overlap, special=vocab.SPECIAL), f"id {kind}, n_bytes long, n_tokens long")


def over_limit(documents: DataFrame, limit: int = 512) -> DataFrame:
    return count_tokens(documents).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
