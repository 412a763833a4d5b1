"""JPEG: exact round trips, a plain decoder, and damaged files."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from codestrata.llm import jpeg, media
from tests.llm import util


def plain_decode(image, file):
    """One symbol at a time."""
    tables = {}
    for key, t in image.tables.items():
        code, at, table = 0, 16, {}
        for length in range(1, 17):
            for s in t[at : at + t[length - 1]]:
                table[length, code] = s
                code += 1
            at += t[length - 1]
            code <<= 1
        tables[key] = table
    wide, high, blocks = image.layout
    at, bits, out = image.data, [], []

    def fill():
        nonlocal at
        byte = file[at]
        at += 2 if byte == 0xFF else 1
        bits.extend(byte >> k & 1 for k in range(7, -1, -1))

    def bit():
        if not bits:
            fill()
        return bits.pop(0)

    def symbol(table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError

    def value(size):
        v = 0
        for _ in range(size):
            v = v << 1 | bit()
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    before = [0] * len(image.scan)
    for m in range(wide * high):
        if image.interval and m and m % image.interval == 0:
            bits.clear()
            assert file[at] == 0xFF and 0xD0 <= file[at + 1] <= 0xD7
            at += 2
            before = [0] * len(image.scan)
        for c in blocks:
            block = [0] * 64
            before[c] += value(symbol(tables[image.scan[c][1]]))
            block[0], k = before[c], 1
            while k < 64:
                s = symbol(tables[0x10 | image.scan[c][2]])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            out.append(block)
    return np.array(out).reshape(-1, len(blocks), 64)


def sparse(n, seed):
    random.seed(seed)
    blocks = np.zeros((n, 64), np.int16)
    for r in range(n):
        for _ in range(random.choice([0, 1, 5, 60])):
            blocks[r, random.randint(0, 63)] = random.choice([1, -1, 7, -300, 1023, -1023])
    return blocks


@pytest.mark.parametrize("components", [1, 3])
def test_any_blocks_come_back(components):
    blocks = sparse(36, components)
    n = 36 // components
    data, _ = jpeg.entropy_code(blocks, components, np.arange(n))
    file = jpeg.header(8 * n, 8, components, 1, b"x") + data.tobytes() + b"\xff\xd9"
    image, got = jpeg.decode([file])[0]
    assert (got.reshape(-1, 64) == blocks).all()
    assert (plain_decode(image, file) == got).all()


def without_restarts(blocks, components=1):
    """The same blocks by a plain writer: DC differences, no restart intervals."""
    (dc, dn), (ac, an) = jpeg.codes_of(*jpeg.DC_TABLE), jpeg.codes_of(*jpeg.AC_TABLE)
    bits, before = "", 0

    def extra(v, size):
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for block in blocks.tolist():
        size = abs(block[0] - before).bit_length()
        bits += format(int(dc[size]), f"0{int(dn[size])}b") + extra(block[0] - before, size)
        before, run = block[0], 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits += format(int(ac[0xF0]), f"0{int(an[0xF0])}b")
                run -= 16
            size = abs(v).bit_length()
            s = run << 4 | size
            bits, run = bits + format(int(ac[s]), f"0{int(an[s])}b") + extra(v, size), 0
        if run:
            bits += format(int(ac[0]), f"0{int(an[0])}b")
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    return jpeg.header(8 * len(blocks), 8, components, 0, b"x") + raw + b"\xff\xd9"


def test_files_without_restart_intervals():
    blocks = [sparse(n, n) // 2 for n in (1, 5, 9)]
    files = [without_restarts(b) for b in blocks]
    for b, (image, got) in zip(blocks, jpeg.decode(files), strict=True):
        assert image.interval == 0 and (got.reshape(-1, 64) == b).all()


def test_thumbnail_is_the_mean_of_each_block():
    level = np.array([[0, 100], [200, 255]])
    blocks = np.zeros((4, 64), np.int16)
    blocks[:, 0] = (level.reshape(-1) - 128) * 8
    data, _ = jpeg.entropy_code(blocks, 1, np.arange(4))
    image, got = jpeg.decode([jpeg.header(16, 16, 1, 1, b"x") + data.tobytes() + b"\xff\xd9"])[0]
    assert (jpeg.thumbnail(image, got) == level).all()
    assert jpeg.average_hash(np.eye(8) * 255) == "8040201008040201"


def test_luminance_of_subsampled_colour():
    """Four luminance blocks and two of colour in an MCU."""
    values = np.arange(2 * 6).reshape(2, 6) * 8 - 40
    bits, before = "", [0, 0, 0]
    (dc, dn), (ac, an) = jpeg.codes_of(*jpeg.DC_TABLE), jpeg.codes_of(*jpeg.AC_TABLE)
    for mcu in values.tolist():
        for c, v in zip([0, 0, 0, 0, 1, 2], mcu, strict=True):
            d = v - before[c]
            before[c], size = v, abs(d).bit_length()
            bits += format(int(dc[size]), f"0{int(dn[size])}b") + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "") + format(int(ac[0]), f"0{int(an[0])}b")
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = jpeg.header(32, 16, 3, 0, b"x")
    file = head.replace(bytes([1, 0x11, 0, 2, 0x11]), bytes([1, 0x22, 0, 2, 0x11])) + raw + b"\xff\xd9"
    image, got = jpeg.decode([file])[0]
    assert image.layout == (2, 1, [0, 0, 0, 0, 1, 2])
    assert (got[:, :, 0] == values).all()
    assert jpeg.thumbnail(image, got).tolist() == [[128 + v // 8 for v in (*values[0][:2], *values[1][:2])], [128 + v // 8 for v in (*values[0][2:4], *values[1][2:4])]]


def test_stored_features(spark, sf):
    texts = util.texts(spark, sf)
    rows = media.stored_features(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > 0 and r.feature


def test_awkward_rows_and_equal_texts(spark):
    rows = media.stored_features(util.awkward(spark)).collect()
    assert len(rows) == len(util.AWKWARD)
    assert len({tuple(r)[1:] for r in rows if r.doc_id == 4}) == 1
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.stored_features(util.empty(spark)).count() == 0


def test_damaged_media_spoil_only_their_own_row(spark):
    good = media.store_payloads([media.padded("some text")])[0]
    rows = spark.createDataFrame([(1, good), (2, None), (3, b"no image"), (4, good[:-200]), (5, good[:40]), (6, b"")], "id long, media binary")
    got = {r.id: r for r in media.describe(rows, payload=True).collect()}
    assert bytes(got[1].payload) == media.padded("some text") and got[1].width == 8
    assert got[2].width is None and got[2].error is None
    assert all(got[k].width is None and got[k].error for k in (3, 5, 6))
