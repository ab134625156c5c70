"""Media columns: payloads kept in baseline JPEG and read back.

Writing: the format's unit is the quantised coefficient. Each payload byte b is the
coefficient of category 8 whose eight additional bits are b, so entropy coding keeps
it without loss; the quantisation table is all ones, there is a restart marker after
each block (the DC predictor starts anew), and 64 bytes make a block. A picture is 9
blocks wide and at most 8191 blocks high; a longer payload is stored as several
pictures, one after another.

Reading: markers are parsed, the Huffman tables of the file are built, and the scan is
decoded in lockstep: all restart intervals of many pictures advance one symbol at a
time in numpy. Any baseline, Huffman-coded, 8-bit JPEG with one scan can be read, with
sampling factors and any tables. The luminance DC values alone, times their
quantiser, over 8 plus 128, give a thumbnail of one pixel per block; the stored
feature is the picture's size and a 64-bit average hash of the thumbnail.

Defined results: a null text is an empty one, and an empty text has a payload of 576
bytes 255; equal texts give equal values; null or repeated doc_ids pass through, one
row out per row in; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_weight

UNIT = 576
WIDE = 9
HIGH = 8191


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (n - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4, 1] + [0] * 15 + [symbol]))


_BEFORE = b"\xff\xd8" + _segment(0xDB, bytes([0]) + b"\x01" * 64)
_AFTER = _one_code_table(0, 8) + _one_code_table(1, 8) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def write_picture(payload: np.ndarray) -> bytes:
    """A multiple of 576 bytes, at most 9 * 8191 blocks, as one baseline JPEG."""
    blocks = payload.reshape(-1, 64)
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)
    scan = np.empty((len(blocks), 74), np.uint8)
    scan[:, :72] = np.packbits(bits.reshape(len(blocks), 576), axis=1)
    scan[:, 72] = 0xFF
    scan[:, 73] = 0xD0 + np.arange(len(blocks)) % 8
    stuffed = scan == 0xFF
    stuffed[:, 72] = False
    flat = scan.reshape(-1)[:-2]
    out = np.insert(flat, np.flatnonzero(stuffed.reshape(-1)[:-2]) + 1, 0)
    frame = struct.pack(">BHHBBBB", 8, 8 * len(blocks) // WIDE, 8 * WIDE, 1, 1, 0x11, 0)
    return _BEFORE + _segment(0xC0, frame) + _AFTER + out.tobytes() + b"\xff\xd9"


def write_media(payload: bytes) -> bytes:
    data, step = np.frombuffer(payload, np.uint8), WIDE * HIGH * 64
    return b"".join(write_picture(data[at : at + step]) for at in range(0, len(data), step))


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    interval: int = 0
    parts: list = field(default_factory=list)  # (id, h, v, quantiser) of each component
    order: list = field(default_factory=list)  # (component, DC table, AC table) of each block of an MCU
    quantisers: dict = field(default_factory=dict)
    data: np.ndarray | None = None  # the scan without stuffing or restart markers
    starts: np.ndarray | None = None  # byte offsets of the restart intervals
    mcus: int = 0
    across: int = 0
    end: int = 0


def parse(raw: bytes, at: int = 0) -> Picture:
    """The markers of the picture that begins at `at`, and its scan without stuffing."""
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG begins here")
    pic, tables, at = Picture(), {}, at + 2
    while True:
        while raw[at + 1] == 0xFF:
            at += 1
        mark, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                pic.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[65 + 64 * bool(wide) :]
        elif mark == 0xC0:
            bits, pic.height, pic.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are baseline")
            pic.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            pic.interval = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if len(chosen) != len(pic.parts):
        raise ValueError("one scan must hold all components")
    one = len(pic.parts) == 1
    wide, high = (1, 1) if one else (max(p[1] for p in pic.parts), max(p[2] for p in pic.parts))
    pic.across = -(-pic.width // (8 * wide))
    pic.mcus = pic.across * -(-pic.height // (8 * high))
    for k, (name, h, v, _) in enumerate(pic.parts):
        pair = tables[chosen[name] >> 4], tables[0x10 | chosen[name] & 15]
        pic.order += [(k, *pair)] * (1 if one else h * v)
    scan = np.frombuffer(raw, np.uint8, offset=at)
    after_ff = np.flatnonzero(scan[:-1] == 0xFF)
    follows = scan[after_ff + 1]
    restart = (follows >= 0xD0) & (follows <= 0xD7)
    ends = after_ff[(follows != 0) & ~restart & (follows != 0xFF)]
    stop = int(ends[0])
    pic.end = at + stop + 2
    inside = after_ff < stop
    after_ff, follows, restart = after_ff[inside], follows[inside], restart[inside]
    keep = np.ones(stop, bool)
    keep[after_ff[follows == 0] + 1] = False
    marks = after_ff[restart]
    keep[marks], keep[marks + 1] = False, False
    pic.data = scan[:stop][keep]
    gone = np.cumsum(~keep)
    pic.starts = np.concatenate([[0], marks - gone[marks] + 1]).astype(np.int64)
    return pic


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may come next: the symbol and its code's length (0: no code)."""
    symbol, length, code, k = np.zeros(65536, np.int64), np.zeros(65536, np.int64), 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            at = slice(code << (16 - bits), (code + 1) << (16 - bits))
            symbol[at], length[at] = table[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def decode(pics: list[Picture]) -> list[np.ndarray]:
    """Coefficients of each picture, (MCUs, blocks of an MCU, 64) in zigzag order.
    Pictures with equal tables go in lockstep."""
    out: list[np.ndarray] = [None] * len(pics)  # type: ignore[list-item]
    alike = defaultdict(list)
    for i, p in enumerate(pics):
        alike[tuple(p.order)].append(i)
    for order, chosen in alike.items():
        luts = {t: _lookup(t) for _, *pair in order for t in pair}
        sizes = [len(pics[i].data) for i in chosen]
        base = np.concatenate([[0], np.cumsum(sizes)])
        data = np.concatenate([*(pics[i].data for i in chosen), np.full(8, 255, np.uint8)]).astype(np.uint32)
        ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        pos, first, count = [], [], []
        mcus = np.concatenate([[0], np.cumsum([pics[i].mcus for i in chosen])])
        for j, i in enumerate(chosen):
            p = pics[i]
            step = p.interval or p.mcus
            begin = np.arange(0, p.mcus, step)
            if len(begin) != len(p.starts):
                raise ValueError("restart markers are missing")
            pos.append((p.starts + base[j]) * 8)
            first.append(mcus[j] + begin)
            count.append(np.minimum(step, p.mcus - begin))
        pos, first, count = np.concatenate(pos), np.concatenate(first), np.concatenate(count)
        coefs = np.zeros((int(mcus[-1]) * len(order), 64), np.int16)
        before = np.zeros((len(pos), 1 + max(k for k, *_ in order)), np.int64)

        def symbols(at: np.ndarray, lut: tuple[np.ndarray, np.ndarray], ahead=ahead) -> tuple[np.ndarray, np.ndarray]:
            window = ((ahead[at >> 3] << (at & 7).astype(np.uint32)) >> 16).astype(np.int64)
            size = lut[1][window]
            if not size.all():
                raise ValueError("a code is in no table")
            return lut[0][window], size

        def extra(at: np.ndarray, size: np.ndarray, ahead=ahead) -> np.ndarray:
            window = ((ahead[at >> 3] << (at & 7).astype(np.uint32)) >> 8).astype(np.int64)
            bits = window >> (24 - size)
            return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)

        for m in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > m)
            for b, (part, dc, ac) in enumerate(order):
                row, at = (first[on] + m) * len(order) + b, pos[on]
                size, used = symbols(at, luts[dc])
                at += used
                before[on, part] += extra(at, size)
                at += size
                coefs[row, 0] = before[on, part]
                go, k = np.arange(len(on)), np.ones(len(on), np.int64)
                while len(go):
                    here = at[go]
                    sym, used = symbols(here, luts[ac])
                    run, size = sym >> 4, sym & 15
                    here += used
                    value = extra(here, size)
                    at[go] = here + size
                    to = k[go] + run
                    has = size > 0
                    if has.all():
                        coefs[row[go], to] = value
                        k[go] = to = to + 1
                        go = go[to < 64]
                    else:
                        coefs[row[go[has]], to[has]] = value[has]
                        k[go] = np.where(has | (run == 15), to + 1, 64)  # EOB ends the block, ZRL skips 16
                        go = go[k[go] < 64]
                pos[on] = at
        for j, i in enumerate(chosen):
            out[i] = coefs[mcus[j] * len(order) : mcus[j + 1] * len(order)].reshape(-1, len(order), 64)
    return out


def thumbnail(pic: Picture, coefs: np.ndarray) -> np.ndarray:
    """One luminance pixel per block, from the DC values of the first component."""
    _, h, v, q = pic.parts[0]
    h, v = (1, 1) if len(pic.parts) == 1 else (h, v)
    dc = coefs[:, : h * v, 0].astype(np.int64) * pic.quantisers[q][0]
    grid = dc.reshape(-1, pic.across, v, h).transpose(0, 2, 1, 3).reshape(-1, pic.across * h)
    grid = grid[: -(-pic.height // 8), : -(-pic.width // 8)]
    return np.clip((grid + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 reduction are above their mean."""
    r, c = (np.arange(8) * n // 8 for n in pixels.shape)
    r1, c1 = (np.maximum((np.arange(8) + 1) * n // 8, np.arange(8) * n // 8 + 1) for n in pixels.shape)
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    cells = (sums[r1][:, c1] - sums[r][:, c1] - sums[r1][:, c] + sums[r][:, c]) / ((r1 - r)[:, None] * (c1 - c)[None, :])
    return np.packbits(cells > cells.mean()).tobytes().hex()


def read_media(stored: list[bytes], at_once: int = 8_000_000) -> list[tuple[bytes, str]]:
    """Payload and feature of each stored form. Pictures are decoded together up to about
    `at_once` bytes of scans; a long text's pictures come one after another."""
    data: list[list[bytes]] = [[] for _ in stored]
    features: list[list[str]] = [[] for _ in stored]
    held: list[tuple[int, Picture]] = []

    def flush() -> None:
        for (i, pic), coefs in zip(held, decode([p for _, p in held]), strict=True):
            v = coefs.reshape(-1)
            data[i].append(np.where(v < 0, v + 255, v).astype(np.uint8).tobytes())
            features[i].append(f"{pic.width}x{pic.height}:{average_hash(thumbnail(pic, coefs))}")
        held.clear()

    size = 0
    for i, raw in enumerate(stored):
        at = 0
        while at < len(raw):
            held.append((i, parse(raw, at)))
            at = held[-1][1].end
            size += len(held[-1][1].data)
            if size > at_once:
                flush()
                size = 0
    flush()
    return [(b"".join(d), " ".join(f)) for d, f in zip(data, features, strict=True)]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(docs: DataFrame, chunk_bytes: int, columns: Callable, schema: str) -> DataFrame:
    """doc_id and what `columns` makes of texts (as bytes), stored forms, payloads and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in by_weight([n + UNIT for n in pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()], chunk_bytes):
                part = b.slice(s.start, s.stop - s.start)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                stored = [write_media(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(texts, stored, read_media(stored))], [x.split()[0] for x in schema.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def media_files(docs: DataFrame, chunk_bytes: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, the stored form, its feature."""
    columns = lambda texts, stored, back: [pa.array(stored, pa.binary()), pa.array([f for _, f in back], pa.string())]
    return _stored(docs, chunk_bytes, columns, "doc_id long, media binary, feature string")


def media_columns(docs: DataFrame, chunk_bytes: int = 2_000_000) -> DataFrame:
    """One row per document; see the module's text."""

    def columns(texts: list[bytes], stored: list[bytes], back: list[tuple[bytes, str]]) -> list[pa.Array]:
        rows = [(len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), f) for t, raw, (p, f) in zip(texts, stored, back, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return _stored(docs, chunk_bytes, columns, SCHEMA)
