"""Media columns: payloads stored as baseline JPEG files, and dimensions and thumbnail hashes read from such files."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common, jpeg

#: Bytes of a unit: an MCU of three components, a block of 64 coefficients each.
UNIT = 192
#: MCUs that a file may have across or down.
MOST = 65535 // 8
#: Bytes handled at once.
BATCH_BYTES = 2_000_000


def padded(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def shape_of(units: int) -> tuple[int, int]:
    """MCUs across and down: the rectangle of just so many that is nearest to a square, else one with some to spare."""
    side = math.isqrt(units)
    for high in range(side, 0, -1):
        if units % high == 0:
            if units // high <= MOST:
                return units // high, high
            break
    wide = math.isqrt(units - 1) + 1
    return wide, -(-units // wide)


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload of whole units; a byte is a coefficient: 0..127 as -128..-1, 128..255 as 1..128.

    No byte is stored as 0, so blocks that only fill the rectangle are all zeros. An MCU is a restart interval.
    """
    shapes, starts, numbers, total = [], [], [], 0
    for p in payloads:
        units = len(p) // UNIT
        wide, high = shape_of(units)
        if max(wide, high) > MOST:
            raise ValueError("a payload of more than 12 GB")
        shapes.append((wide, high))
        starts.append(total)
        numbers.append(np.arange(wide * high))
        total += wide * high
    if not payloads:
        return []
    values = np.zeros((total, UNIT), np.int16)
    for p, start in zip(payloads, starts, strict=True):
        raw = np.frombuffer(p, np.uint8).astype(np.int16)
        values[start : start + len(p) // UNIT] = (raw - 128 + (raw >= 128)).reshape(-1, UNIT)
    data, begin = jpeg.entropy_code(values.reshape(-1, 64), 3, np.concatenate(numbers))
    ends = [*(int(begin[s]) for s in starts[1:]), len(data)]
    out = []
    for p, (wide, high), start, end in zip(payloads, shapes, starts, ends, strict=True):
        out.append(jpeg.header(8 * wide, 8 * high, 3, 1, b"payload %d" % len(p)) + data[int(begin[start]) : end].tobytes() + b"\xff\xd9")
    return out


def read_payload(image: jpeg.Image, coefficients: np.ndarray) -> bytes:
    name, size = image.comment.split()
    if name != b"payload":
        raise ValueError("not a stored payload")
    values = coefficients.reshape(-1)[: int(size)]
    return (values + 128 - (values > 0)).astype(np.uint8).tobytes()


def feature(image: jpeg.Image, coefficients: np.ndarray) -> str:
    return f"{image.width}x{image.height}:{jpeg.average_hash(jpeg.thumbnail(image, coefficients))}"


@common.tidy
def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", BATCH_BYTES):
            texts = common.texts(part.column("text"))
            files = store_payloads([padded(t) for t in texts])
            yield pa.record_batch([part.column("id"), part.column("n_bytes"), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as UTF-8, with spaces up to a positive multiple of 192 bytes, in a JPEG file.

    Null and empty texts are 192 spaces; repeated rows stay; equal texts give equal files.
    """
    rows = common.pick(df, id=id_col, text=text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(_stored, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


@common.tidy
def _described(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "media", BATCH_BYTES):
            media = part.column("media").to_pylist()
            parsed, images, errors = {}, {}, {}
            for i, m in enumerate(media):
                try:
                    if m is not None:
                        parsed[i] = jpeg.parse(m)
                except (ValueError, KeyError, IndexError) as e:
                    errors[i] = str(e)
            try:
                images = dict(zip(parsed, jpeg.decode([media[i] for i in parsed], list(parsed.values())), strict=True))
            except (ValueError, KeyError, IndexError):  # a damaged scan spoils only its own row
                for i in parsed:
                    try:
                        images[i] = jpeg.decode([media[i]])[0]
                    except (ValueError, KeyError, IndexError) as e:
                        errors[i] = str(e)
            found = [images.get(i) for i in range(len(media))]
            columns = [
                pa.array([x and x[0].width for x in found], pa.int32()),
                pa.array([x and x[0].height for x in found], pa.int32()),
                pa.array([x and jpeg.average_hash(jpeg.thumbnail(*x)) for x in found], pa.string()),
                pa.array([errors.get(i) for i in range(len(media))], pa.string()),
                pa.array([read_payload(*x) if payload and x else None for x in found], pa.binary()),
            ]
            yield pa.record_batch([*part.columns, *columns], names=[*part.schema.names, "width", "height", "thumbnail_hash", "error", "payload"])


def describe(rows: DataFrame, payload: bool = False) -> DataFrame:
    """Adds width, height, thumbnail_hash, error and payload (null unless asked for) to rows with a binary ``media``.

    Null media give nulls; what is not a baseline JPEG gives nulls and the reason in error. Other columns stay, so they
    must not have these names.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(functools.partial(_described, payload=payload), f"{schema}, width int, height int, thumbnail_hash string, error string, payload binary")


def stored_features(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = describe(store(documents), payload=True)
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 15, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )
