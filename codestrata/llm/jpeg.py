"""Baseline JPEG in numpy: parse markers, Huffman-decode scans, rebuild luminance thumbnails from DC coefficients.

Restart intervals are independent of each other, so all intervals of all images at hand are decoded in lockstep, one
symbol of each a step. Coefficients are kept as stored (quantised, in zigzag order), which is the format's lossless
unit: bytes written as coefficients are read back exactly.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

#: Codes of a Huffman table: symbols by length, from the most frequent on. Built by the rule below, not a standard table.
SIZES_DC, RUN_SIZES = 12, 10


def _huffman_lengths(weights: list[int]) -> list[int]:
    """Code lengths of at most 16 bits by Huffman's construction, with one code left unused as JPEG asks."""
    import heapq

    while True:
        heap = [(w, i, (i,)) for i, w in enumerate([*weights, 0])]  # the last stands for the code of all ones
        heapq.heapify(heap)
        depth = [0] * (len(weights) + 1)
        count = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], count, a[2] + b[2]))
            count += 1
        if max(depth) <= 16:
            return depth[:-1]
        weights = [w // 2 + 1 for w in weights]


def _table(symbols: list[int], weights: list[int]) -> tuple[list[int], list[int]]:
    """(number of codes by length 1..16, symbols in the order of their codes)."""
    lengths = _huffman_lengths(weights)
    order = sorted(range(len(symbols)), key=lambda i: (lengths[i], symbols[i]))
    return [lengths.count(n) for n in range(1, 17)], [symbols[i] for i in order]


#: Weights: sizes near 5 bits, as bytes of text have, are frequent; runs of zeros are rare.
DC_TABLE = _table(list(range(SIZES_DC)), [1 + (1 << max(0, 9 - 2 * abs(s - 6))) for s in range(SIZES_DC)])
AC_TABLE = _table([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, RUN_SIZES + 1))], [64, 2, *(1 + ((1 << max(0, 14 - 2 * abs(s - 5))) >> 7 * min(r, 2)) for r in range(16) for s in range(1, RUN_SIZES + 1))])


def codes_of(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, at, codes, lengths = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            codes[symbol], lengths[symbol] = code, length
            code += 1
        at += n
        code <<= 1
    return codes, lengths


#: Flags of lookup_of's entries.
PUT, END, LONG, BAD = 1 << 10, 1 << 11, 1 << 12, 1 << 13


@functools.lru_cache(maxsize=16)
def lookup_of(table: bytes, dc: bool) -> np.ndarray:
    """By the next 16 bits: bits used (6), zeros before the value (4), flags, and the value from bit 16 on.

    LONG: the extra bits reach beyond the 16; the value's place has their number then, and the bits used are the code's.
    """
    counts, symbols = list(table[:16]), table[16:]
    out, at, place = np.full(1 << 16, BAD, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            run, size = (0, symbol) if dc else (symbol >> 4, symbol & 15)
            wide = 1 << (16 - length)
            here = slice(place, place + wide)
            if size == 0:
                out[here] = length | run << 6 | (PUT if dc else 0 if run == 15 else END)
            elif length + size > 16:
                out[here] = length | run << 6 | PUT | LONG | size << 16
            else:
                extra = np.arange(wide, dtype=np.int32) >> (16 - length - size)
                value = np.where(extra < 1 << (size - 1), extra - (1 << size) + 1, extra)
                out[here] = length + size | run << 6 | PUT | value << 16
            place += wide
        at += n
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int, components: int, interval: int, comment: bytes) -> bytes:
    out = b"\xff\xd8" + segment(0xFE, comment) + segment(0xDB, bytes([0] + [1] * 64))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, components) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(components)))
    for kind, (counts, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE)):
        out += segment(0xC4, bytes([kind, *counts, *symbols]))
    out += segment(0xDD, struct.pack(">H", interval))
    return out + segment(0xDA, bytes([components, *(x for i in range(components) for x in (i + 1, 0)), 0, 63, 0]))


@functools.cache
def _value_codes(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Code with its extra bits, and their length, of each value from -2047 on without zeros before it."""
    codes, lengths = codes_of(*(AC_TABLE if kind else DC_TABLE))
    value = np.arange(-2047, 2048)
    size = np.where(value == 0, 0, np.floor(np.log2(np.maximum(np.abs(value), 1))).astype(np.int64) + 1)
    extra = np.where(value < 0, value + (np.int64(1) << size) - 1, value).astype(np.uint64)
    return codes[size] << size.astype(np.uint64) | extra, lengths[size] + size


def _coded(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, their lengths, and how many codes each block has."""
    n = len(blocks)
    flat = blocks.reshape(-1)
    (ac_codes, ac_sizes), (dc_codes, dc_sizes) = _value_codes(1), _value_codes(0)
    at = flat.astype(np.int64) + 2047
    if flat.all():  # as stored payloads are
        code, length = ac_codes[at], ac_sizes[at]
        code[::64], length[::64] = dc_codes[at[::64]], dc_sizes[at[::64]]
        return code, length, np.full(n, 64)
    index = np.flatnonzero((flat != 0) | (np.arange(n * 64) % 64 == 0))
    k, block = index % 64, index // 64
    gap = np.where(k == 0, 0, k - np.concatenate([[0], k[:-1]]) - 1)
    at = at[index]
    code, length = np.where(k == 0, dc_codes[at], ac_codes[at]), np.where(k == 0, dc_sizes[at], ac_sizes[at])
    plain, lengths = codes_of(*AC_TABLE)
    if (far := np.flatnonzero(gap % 16)).size:  # zeros before the value: another symbol, the same extra bits
        size = ac_sizes[at[far]] - lengths[(own := _size_of(at[far] - 2047))]
        symbol = (gap[far] % 16) << 4 | own
        code[far] = plain[symbol] << size.astype(np.uint64) | code[far] & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))
        length[far] = lengths[symbol] + size
    last = np.concatenate([block[1:] != block[:-1], [True]]) & (k != 63)
    times = 1 + gap // 16 + last
    own = np.cumsum(times) - times + gap // 16
    codes, sizes = np.full(int(times.sum()), plain[0xF0]), np.full(int(times.sum()), lengths[0xF0])
    codes[own], sizes[own] = code, length
    codes[own[last] + 1], sizes[own[last] + 1] = plain[0], lengths[0]
    return codes, sizes, np.bincount(block, times, n).astype(np.int64)


def _size_of(values: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(np.abs(values), 1))).astype(np.int64) + 1


def entropy_code(blocks: np.ndarray, components: int, intervals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman-codes blocks (n, 64), a restart interval being one MCU of ``components`` blocks.

    intervals numbers each MCU within its image, for the restart markers; number 0 has none before it. Returns the
    stuffed bytes of all MCUs with their markers, and where each MCU begins (with its marker). DC prediction starts
    anew with each interval, and each component has one block, so differences are the values themselves.
    """
    count = len(blocks) // components
    code, length, codes = _coded(blocks)
    of_mcu = codes.reshape(-1, components).sum(axis=1)
    edge = np.cumsum(of_mcu) - of_mcu
    bits = np.add.reduceat(length, edge)
    sizes = (bits + 7) // 8
    begin = np.cumsum(sizes) - sizes
    offset = np.cumsum(length)
    offset -= length
    offset += np.repeat(begin * 8 - (np.cumsum(bits) - bits), of_mcu)
    # Each code lies in one or two 32-bit words; the codes of a word set different bits, and its last may reach over.
    placed = code << (64 - (offset & 31) - length).astype(np.uint64)
    word = offset >> 5
    heads = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    sums = np.add.reduceat(placed, heads)
    words = np.zeros(int(sizes.sum()) // 4 + 3, np.uint64)
    words[word[heads]] = sums >> np.uint64(32)
    words[word[heads] + 1] += sums & np.uint64(0xFFFFFFFF)
    raw = words.astype(">u4").view(np.uint8)[: int(sizes.sum())]
    raw[begin + sizes - 1] |= ((1 << (sizes * 8 - bits)) - 1).astype(np.uint8)  # ones up to the byte's end
    full = np.flatnonzero(raw == 0xFF)
    marked = np.flatnonzero(intervals > 0)
    markers = np.stack([np.full(len(marked), 0xFF), 0xD0 + (intervals[marked] - 1) % 8], 1).reshape(-1)
    out = np.insert(raw, np.concatenate([full + 1, np.repeat(begin[marked], 2)]), np.concatenate([np.zeros(len(full), np.int64), markers]).astype(np.uint8))
    before = 2 * (np.cumsum(intervals > 0) - (intervals > 0))
    return out, begin + np.searchsorted(full, begin) + before


@dataclass
class Image:
    """What the markers of a file say."""

    width: int
    height: int
    comment: bytes
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    scan: list[tuple[int, int, int]]  # component, DC table, AC table
    quantisation: dict[int, np.ndarray]
    tables: dict[int, bytes]
    interval: int
    data: int  # where the scan's data begin
    end: int

    @property
    def layout(self) -> tuple[int, int, list[int]]:
        """MCUs across and down, and for each block of an MCU its place in ``scan``."""
        if len(self.scan) == 1:
            _, h, v, _ = self.components[self.scan[0][0]]
            most = self.sampling
            wide, high = -(-self.width * h // (8 * most[0])), -(-self.height * v // (8 * most[1]))
            return wide, high, [0]
        h, v = self.sampling
        blocks = [i for i, (c, _, _) in enumerate(self.scan) for _ in range(self.components[c][1] * self.components[c][2])]
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), blocks

    @property
    def sampling(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)


def parse(file: bytes) -> Image:
    """Markers up to the only scan. Raises ValueError for what is not a baseline JPEG with one scan."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, comment, frame, interval, quantisation, tables = 2, b"", None, 0, {}, {}
    while at + 4 <= len(file):
        if file[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = file[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", file, at + 2)[0]
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment += body
        elif marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                quantisation[key] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("not 8 bits a sample")
            frame = width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            if not frame:
                raise ValueError("no frame before the scan")
            ids = [c[0] for c in frame[2]]
            scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(scan) != len(ids):
                raise ValueError("more than one scan")
            return Image(*frame[:2], comment, frame[2], scan, quantisation, tables, interval, at, len(file))
        elif marker == 0xD9:
            break
    raise ValueError("no scan")


def decode(files: list[bytes], images: list[Image] | None = None) -> list[tuple[Image, np.ndarray]]:
    """Each image with its coefficients, shaped (MCUs, blocks of an MCU, 64), quantised and in zigzag order.

    Images with the same tables and components are decoded together. images: what parse() gave, if it is known.
    """
    images = images or [parse(f) for f in files]
    out: list = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        key = tuple(sorted(image.tables.items())), tuple(image.scan), tuple(image.layout[2])
        groups.setdefault(key, []).append(i)
    for own in groups.values():
        for i, coefficients in zip(own, _decode_group([images[i] for i in own], [files[i] for i in own]), strict=True):
            out[i] = images[i], coefficients
    return out


def _decode_group(images: list[Image], files: list[bytes]) -> list[np.ndarray]:
    parts = [np.frombuffer(f, np.uint8)[i.data : i.end] for i, f in zip(images, files, strict=True)]
    # Four bytes apart: what follows the last marker of one file is not taken for data of the next.
    raw = np.concatenate([x for p in parts for x in (p, np.zeros(4, np.uint8))])
    edges = np.cumsum([0, *(len(p) + 4 for p in parts)])
    follows = np.concatenate([raw[1:], [0]])
    is_marker = (raw == 0xFF) & (follows != 0) & (follows != 0xFF)
    restart = is_marker & (follows >= 0xD0) & (follows <= 0xD7)
    stuffing = np.concatenate([[False], (raw[:-1] == 0xFF) & (raw[1:] == 0)])
    skip = stuffing | is_marker | np.concatenate([[False], is_marker[:-1]])
    place = np.cumsum(~skip) - ~skip  # of each raw byte among those kept
    data = np.concatenate([raw[~skip], np.full(12, 0xFF, np.uint8)]).astype(np.uint64)
    window = data[:-8]
    for j in range(1, 5):
        window = window << np.uint64(8) | data[j : j + len(window)]
    at_restart = np.flatnonzero(restart)
    begins, mcus, of = [], [], []
    for i, image in enumerate(images):
        wide, high, _ = image.layout
        total, step = wide * high, image.interval or wide * high
        marks = at_restart[np.searchsorted(at_restart, edges[i]) : np.searchsorted(at_restart, edges[i + 1])]
        n = -(-total // step)
        if len(marks) < n - 1:
            raise ValueError("restart markers are missing")
        begins.append(place[np.concatenate([[edges[i]], marks[: n - 1] + 2])])
        mcus.append(np.full(n, step))
        mcus[-1][-1] = total - step * (n - 1)
        of.append(total)
    position = np.concatenate(begins).astype(np.int64) * 8
    count = np.concatenate(mcus)
    first = np.cumsum(count) - count  # each interval's first MCU
    blocks = images[0].layout[2]
    result = np.zeros((int(count.sum()), len(blocks), 64), np.int16)
    limit = (len(window) - 1) * 8
    order = np.argsort(-count, kind="stable")  # those with more MCUs first: the active ones are always a prefix
    position, first, count = position[order], first[order], count[order]
    predicted = np.zeros((len(images[0].scan), len(position)), np.int64)

    def next_of(pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries, and values."""
        np.minimum(pos, limit, out=pos)
        w, shift = window[pos >> 3], (24 - (pos & 7)).astype(np.uint64)
        entry = table[((w >> shift) & np.uint64(0xFFFF)).astype(np.int64)]
        value = entry >> 16
        pos += entry & 63
        if (entry & (LONG | BAD)).any():
            if (entry & BAD).any():
                raise ValueError("a code that no table has")
            long = np.flatnonzero(entry & LONG)
            size = value[long].astype(np.int64)
            at = pos[long]
            extra = ((window[np.minimum(at, limit) >> 3] >> (40 - (at & 7) - size).astype(np.uint64)).astype(np.int64)) & ((1 << size) - 1)
            value[long] = np.where(extra < 1 << (size - 1), extra - (1 << size) + 1, extra)
            pos[long] += size
        return entry, value

    for m in range(int(count.max(initial=0))):
        active = int(np.searchsorted(-count, -m, "left"))
        row = first[:active] + m
        pos = position[:active].copy()
        for b, component in enumerate(blocks):
            _, dc_key, ac_key = images[0].scan[component]
            dc, ac = lookup_of(images[0].tables[dc_key], True), lookup_of(images[0].tables[0x10 | ac_key], False)
            predicted[component, :active] += next_of(pos, dc)[1]
            result[row, b, 0] = predicted[component, :active]
            step = 1
            while step < 64:  # as long as no block has zeros, all stand at the same coefficient
                saved = pos.copy()
                entry, value = next_of(pos, ac)
                if ((entry & (15 << 6 | PUT)) != PUT).any():
                    pos = saved
                    break
                result[row, b, step] = value
                step += 1
            k, who = np.full(active, step), np.arange(active) if step < 64 else np.zeros(0, np.int64)
            while len(who):  # those whose block has not ended
                here = pos[who]
                entry, value = next_of(here, ac)
                pos[who] = here
                at = k[who] + ((entry >> 6) & 15)
                put, ends = (entry & PUT) > 0, (entry & END) > 0
                if (at[~ends] > 63).any():
                    raise ValueError("a block of more than 64 coefficients")
                result[row[who[put]], b, at[put]] = value[put]
                k[who] = np.where(ends, 64, at + 1)
                who = who[k[who] < 64]
        position[:active] = pos
    cuts = np.cumsum(of)[:-1]
    return np.split(result, cuts)


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance, a pixel for each block of the first component, from DC coefficients alone: their mean sample."""
    wide, high, blocks = image.layout
    _, h, v, table = image.components[image.scan[0][0]]
    n = blocks.count(0)
    dc = coefficients[:, :n, 0].astype(np.int64) * int(image.quantisation[table][0])
    level = np.clip(128 + np.round(dc / 8), 0, 255).astype(np.uint8)
    if n == 1:
        return level.reshape(high, wide)
    return level.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)


@functools.lru_cache(maxsize=4096)
def _cells(n: int, side: int) -> np.ndarray:
    """(side, n): which of n pixels each of side cells covers; with fewer pixels than cells they are used again."""
    edge = np.linspace(0, n, side + 1)
    low = np.minimum(edge[:-1].astype(int), n - 1)
    high = np.maximum(np.ceil(edge[1:]).astype(int), low + 1)
    at = np.arange(n)
    return ((at >= low[:, None]) & (at < high[:, None])).astype(np.float64)


def average_hash(pixels: np.ndarray, side: int = 8) -> str:
    """Hex bits of a side x side picture: which of its cells are at least as light as their mean."""
    down, across = _cells(pixels.shape[0], side), _cells(pixels.shape[1], side)
    cells = (down @ pixels.astype(np.float64) @ across.T) / np.outer(down.sum(1), across.sum(1))
    return np.packbits((cells >= cells.mean()).reshape(-1)).tobytes().hex()
