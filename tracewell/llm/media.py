"""Media columns: AVI files of motion JPEG.

`frames_of` parses RIFF chunks, the headers and the index (idx1, or the movi list where the index is
missing or damaged).  `Jpeg` decodes intra frames: baseline sequential DCT with any Huffman and
quantisation tables, sampling factors and restart intervals.  Huffman codes depend on all
bits before them, so one stream can't be cut; but restart intervals, and frames, start afresh, and
all of those at hand are decoded in step, one symbol of each at a time, as arrays.  `shots`
compares the luminance histograms of neighbouring frames and cuts where the difference is well
above what is usual around there (an adaptive threshold), which yields timed clip rows.

The other direction stores bytes in motion JPEG without loss: JPEG's own units, the quantised
coefficients of 8 x 8 blocks, carry one byte each (64 bytes a block, in scan order); with
quantisation by 1 the decoder gets the very coefficients back.  All sums are exact in integers or
in whole doubles, so equal bytes give equal media and equal features everywhere.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices, texts_of

BLOCK, SIDE = 64, 64
#: Bytes that one frame of SIDE x SIDE samples carries.
FRAME = SIDE * SIDE
#: Blocks of one restart interval.
INTERVAL = SIDE // 8
RATE = 25
#: What a coefficient of 0 stands for: text has its letters near it, so that coefficients are small.
CENTRE = 96
BINS = 64


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient of the scan: diagonals, each against the one before."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@lru_cache(maxsize=1)
def inverse_basis() -> np.ndarray:
    """64 x 64: samples of each coefficient of the scan, in whole units of 2**-13."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    one[:, 0] /= np.sqrt(2)
    both = np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)
    return np.rint(both[zigzag()] * 8192)


@lru_cache(maxsize=1)
def own_tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """Code lengths and symbols of this writer's Huffman tables: (bits by length, symbols) for DC and AC.

    DC: the 12 sizes in 4 bits each.  AC: sizes 1 to 10 without a run and the end of block in 4 bits,
    all others (run and size, or 16 zeros) in 9.
    """
    dc = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
    short = [*range(1, 11), 0]
    long = [run << 4 | size for run in range(1, 16) for size in range(1, 11)] + [0xF0]
    return dc, ([0, 0, 0, len(short), 0, 0, 0, 0, len(long)] + [0] * 7, short + long)


def codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), by the canonical rule: codes of a length count on from those before."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for s in table[1][at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(table: tuple[list[int], list[int]]) -> np.ndarray:
    """For every 16 bits: length << 8 | symbol of the code they start with; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(table).items():
        start = code << (16 - length)
        out[start : start + (1 << (16 - length))] = length << 8 | symbol
    return out


def size_of(values: np.ndarray) -> np.ndarray:
    """Bits of each magnitude (0 for 0)."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def frame_head() -> bytes:
    dc, ac = own_tables()
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"AVI1" + bytes(10)),
            segment(0xDB, b"\0" + b"\1" * 64),
            segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + bytes(dc[0]) + bytes(dc[1])),
            segment(0xC4, b"\x10" + bytes(ac[0]) + bytes(ac[1])),
            segment(0xDD, struct.pack(">H", INTERVAL)),
            segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
    )


@lru_cache(maxsize=1)
def code_arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    out = []
    for table in own_tables():
        c, n = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, (code, length) in codes(table).items():
            c[s], n[s] = code, length
        out += [c, n]
    return tuple(out)


def scans(blocks: np.ndarray) -> list[bytes]:
    """Entropy-coded data of coefficients (n, 64): one piece of bytes per INTERVAL blocks, stuffed."""
    n = len(blocks)
    dc_code, dc_len, ac_code, ac_len = code_arrays()
    values = blocks.astype(np.int64)
    dc = values[:, 0].copy()
    dc[1:] -= np.where(np.arange(1, n) % INTERVAL, values[:-1, 0], 0)
    values[:, 0] = 1  # always coded
    row, col = np.nonzero(values)
    values[:, 0] = dc
    value = values[row, col]
    first = col == 0
    run = np.where(first, 0, np.diff(col, prepend=0) - 1)
    size = size_of(value)
    symbol = np.where(first, size, (run & 15) << 4 | size)
    code = np.where(first, dc_code[symbol], ac_code[symbol])
    length = np.where(first, dc_len[symbol], ac_len[symbol])
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    code, length = code << size | bits, length + size
    zeros = run >> 4  # runs of 16 zeros have a code of their own
    last = np.append(first[1:], True) & (col != 63)  # then comes the end of the block
    copies = 1 + zeros + last
    at = np.cumsum(copies) - copies
    total = int(copies.sum())
    all_code, all_len = np.full(total, ac_code[0xF0]), np.full(total, ac_len[0xF0])
    all_code[at + zeros], all_len[at + zeros] = code, length
    ends = (at + zeros + 1)[last]
    all_code[ends], all_len[ends] = ac_code[0], ac_len[0]
    interval = np.repeat(row // INTERVAL, copies)
    k = -(-n // INTERVAL)
    bits_of = np.bincount(interval, all_len, k).astype(np.int64)
    bytes_of = (bits_of + 7) // 8
    # Intervals end on bytes; what is missing is filled with ones.
    fill = np.flatnonzero(bytes_of * 8 > bits_of)
    all_code = np.concatenate([all_code, (1 << (bytes_of - bits_of // 8)[fill] * 0 + (bytes_of * 8 - bits_of)[fill]) - 1])
    all_len = np.concatenate([all_len, (bytes_of * 8 - bits_of)[fill]])
    order = np.argsort(np.concatenate([interval, fill]), kind="stable")
    all_code, all_len = all_code[order], all_len[order]
    start = np.cumsum(all_len) - all_len
    words = np.zeros(int(bytes_of.sum()) // 4 + 3)
    place, shift = start >> 5, 64 - (start & 31) - all_len
    wide = all_code << shift  # within 64 bits: at most 31 + 26
    words += np.bincount(place, (wide >> 32) & 0xFFFFFFFF, len(words))
    words += np.bincount(place + 1, wide & 0xFFFFFFFF, len(words))
    data = words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(bytes_of.sum())]
    # A byte of ones is followed by a zero.
    ones = data == 0xFF
    ends = np.cumsum(bytes_of)
    stuffed = np.zeros(len(data) + int(ones.sum()), np.uint8)
    moved = np.arange(len(data)) + np.cumsum(ones) - ones
    stuffed[moved] = data
    raw = stuffed.tobytes()
    cut = np.concatenate([[0], ends + np.cumsum(ones)[ends - 1]])
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], note: bytes) -> bytes:
    """An AVI file of JPEG frames with an index, and `note` as its comment."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", note))
    at, index, parts = 4, [], []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(chunk(b"00dc", f))
        at += len(parts[-1])
    body = b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as an AVI file; its size stands in the comment."""
    counts = [max(1, -(-len(p) // FRAME)) for p in payloads]
    blocks = np.full((sum(counts) * BLOCK, 64), CENTRE, np.uint8)  # blank blocks are zero coefficients
    flat, at = blocks.reshape(-1), 0
    for p, n in zip(payloads, counts, strict=True):
        flat[at : at + len(p)] = np.frombuffer(p, np.uint8)
        at += n * FRAME
    pieces = scans((blocks - np.uint8(CENTRE)).view(np.int8))
    out, at, per = [], 0, BLOCK // INTERVAL
    for p, n in zip(payloads, counts, strict=True):
        frames = []
        for _ in range(n):
            own = pieces[at : at + per]
            at += per
            frames.append(frame_head() + b"".join(x + bytes([0xFF, 0xD0 + i % 8]) for i, x in enumerate(own[:-1])) + own[-1] + b"\xff\xd9")
        out.append(avi(frames, b"payload_bytes=%d" % len(p)))
    return out


def riff(data: bytes, start: int, end: int):
    """(name, start, end) of the chunks within a range; a chunk that passes the end is cut there."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield name, start + 8, min(start + 8 + size, end)
        start += 8 + size + (size & 1)


def frames_of(data: bytes) -> tuple[list[bytes], int, bytes]:
    """Video frames in order, microseconds a frame, and the comment.  Not an AVI file: no frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return [], 0, b""
    micros, note, movi, index = 1_000_000 // RATE, b"", None, []
    for name, a, b in riff(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n, c, _ in riff(data, a + 4, b):
                micros = struct.unpack_from("<I", data, c)[0] if n == b"avih" else micros
        elif name == b"LIST" and kind == b"INFO":
            note = next((data[c:d] for n, c, d in riff(data, a + 4, b) if n == b"ICMT"), note)
        elif name == b"LIST" and kind == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, i) for i in range(a, b - 15, 16)]
    if movi is None:
        return [], micros, note
    video = [x for x in index if x[0][2:] in (b"dc", b"db")]
    # Offsets count from the list's kind, or, in some files, from the start of the file.
    base = movi[0] if video and data[movi[0] + video[0][2] :][:4] == video[0][0] else 0
    if video and all(data[base + at : base + at + 4] == n and base + at + 8 + size <= len(data) for n, _, at, size in video):
        return [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in video], micros, note

    def walk(start: int, end: int):
        for n, c, d in riff(data, start, end):
            if n == b"LIST":
                yield from walk(c + 4, d)
            elif n[2:] in (b"dc", b"db"):
                yield data[c:d]

    return list(walk(movi[0] + 4, movi[1])), micros, note


@dataclass(frozen=True)
class Shape:
    """What the headers of a frame say; frames of equal shape are decoded together."""

    height: int
    width: int
    parts: tuple[tuple[int, int, int, int, int, int], ...]  # id, across, down, quantiser, DC table, AC table
    interval: int
    tables: tuple  # (class and number, bits, symbols)
    quantisers: tuple


def read_head(data: bytes) -> tuple[Shape, int] | None:
    """The shape of a JPEG frame and where its scan starts; None if it is not baseline."""
    at, frame, interval, tables, quantisers = 2, None, 0, {}, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = struct.unpack(">64H" if wide else "64B", body[1 : 65 + 64 * wide])
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            frame = struct.unpack_from(">BHHB", body)
            own = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(frame[3])}
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None or frame[0] != 8:
                return None
            parts = tuple((body[1 + 2 * i], *own[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            return Shape(frame[1], frame[2], parts, interval, tuple(sorted(tables.items())), tuple(sorted(quantisers.items()))), at
        elif 0xC2 <= marker <= 0xCF:
            return None
    return None


def coefficients(shape: Shape, streams: list[bytes]) -> list[np.ndarray]:
    """Quantised coefficients (frames, blocks, 64) of each component, in scan order of blocks."""
    parts = shape.parts
    single = len(parts) == 1
    most_x, most_y = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = (-(-shape.width // 8), -(-shape.height // 8)) if single else (-(-shape.width // (8 * most_x)), -(-shape.height // (8 * most_y)))
    units = across * down  # of the scan: blocks, or groups of all components' blocks
    per = [1] if single else [p[1] * p[2] for p in parts]
    sequence = np.repeat(np.arange(len(parts)), per)
    interval = shape.interval or units
    lanes_per = -(-units // interval)
    # Lanes: all restart intervals of all frames, without stuffing.
    lanes: list[bytes] = []
    for s in streams:
        own = _intervals(s)[:lanes_per]
        lanes += own + [b""] * (lanes_per - len(own))
    size = np.array([len(x) for x in lanes])
    start = np.cumsum(size + 8) - size - 8
    raw = np.frombuffer(b"".join(x + bytes(8) for x in lanes) + bytes(8), np.uint8).astype(np.int64)
    windows = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]
    tables = dict(shape.tables)
    looks = np.stack([lookup(tables[cls << 4 | p[4 + cls]]) for p in parts for cls in (0, 1)]).reshape(-1)
    in_lane = np.minimum(interval, units - np.arange(lanes_per) * interval)
    todo = np.tile(in_lane, len(streams)) * len(sequence)
    lane_cap = interval * len(sequence)
    out = np.zeros((len(lanes) * lane_cap, 64), np.int32)
    flat = out.reshape(-1)
    live = np.flatnonzero(todo)
    bit, end = start * 8, (start + size) * 8
    pos, block = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    b, p, n, e, t, base = bit[live], pos[live], block[live], end[live], todo[live], live * lane_cap
    while len(b):
        byte, off = b >> 3, b & 7
        window = windows[byte]
        which = (sequence[n % len(sequence)] * 2 + (p > 0)) << 16
        entry = looks[which + ((window >> (24 - off)) & 0xFFFF)]
        length, symbol = entry >> 8, entry & 255
        run, bits = symbol >> 4, symbol & 15
        amount = (window >> (40 - off - length - bits)) & ((1 << bits) - 1)
        value = np.where(amount < (1 << bits) >> 1, amount - (1 << bits) + 1, amount)
        k = p + run
        set_ = (bits > 0) & (k < 64)
        flat[((base + n) * 64 + k)[set_]] = value[set_]
        over = (p > 0) & (symbol == 0)  # end of block
        p = np.where(over, 64, k + 1)
        b = b + length + bits
        full = p >= 64
        n = n + full
        p = np.where(full, 0, p)
        going = (n < t) & (length > 0) & (b < e + 8)
        if not going.all():
            b, p, n, e, t, base = b[going], p[going], n[going], e[going], t[going], base[going]
    blocks = out.reshape(len(lanes), lane_cap, 64)
    found = []
    for i in range(len(parts)):
        own = blocks.reshape(len(lanes), interval, len(sequence), 64)[:, :, sequence == i].reshape(len(lanes), -1, 64)
        own[:, :, 0] = np.cumsum(own[:, :, 0], axis=1)  # DC values are differences within an interval
        own = own.reshape(len(streams), -1, 64)[:, : units * per[i]]
        found.append(own)
    return found


def _intervals(data: bytes) -> list[bytes]:
    """The scan's restart intervals without stuffing, up to its end marker."""
    out, held, at = [], [], 0
    while (i := data.find(b"\xff", at)) >= 0 and i + 1 < len(data):
        mark = data[i + 1]
        if mark == 0:
            held.append(data[at : i + 1])
        elif 0xD0 <= mark <= 0xD7:
            held.append(data[at:i])
            out.append(b"".join(held))
            held = []
        elif mark != 0xFF:
            held.append(data[at:i])
            at = len(data)
            break
        else:
            held.append(data[at:i])
            at = i + 1
            continue
        at = i + 2
    held.append(data[at:])
    return [*out, b"".join(held)]


@dataclass
class Decoded:
    coefs: np.ndarray  # of the first component, (blocks, 64), not quantised
    histogram: np.ndarray  # BINS counts of luminance


def decode(frames: list[bytes]) -> list[Decoded | None]:
    """Every frame's luminance; None for what is not a baseline JPEG."""
    out: list[Decoded | None] = [None] * len(frames)
    groups: dict[Shape, list[tuple[int, int]]] = {}
    for i, f in enumerate(frames):
        if f[:2] == b"\xff\xd8" and (got := read_head(f)):
            groups.setdefault(got[0], []).append((i, got[1]))
    for shape, own in groups.items():
        for at in range(0, len(own), 256):
            part = own[at : at + 256]
            coefs = coefficients(shape, [frames[i][start:] for i, start in part])[0]
            quantiser = np.array(dict(shape.quantisers)[shape.parts[0][3]], np.float64)
            samples = (coefs.reshape(-1, 64) * quantiser) @ inverse_basis()  # whole doubles: exact in any order
            luma = np.clip((samples.astype(np.int64) + 4096 >> 13) + 128, 0, 255)
            bins = luma.reshape(len(part), -1) * BINS >> 8
            hist = np.bincount((bins + np.arange(len(part))[:, None] * BINS).reshape(-1), minlength=len(part) * BINS).reshape(len(part), BINS)
            for j, (i, _) in enumerate(part):
                out[i] = Decoded(coefs[j], hist[j])
    return out


def shots(histograms: np.ndarray, window: int = 8, factor: int = 3, least: float = 0.10) -> list[tuple[int, int]]:
    """(first, last + 1) of each shot: cuts before frames whose difference from the one before is
    over `least` of all samples and over `factor` times the mean of the `window` differences before."""
    n = len(histograms)
    if n == 0:
        return []
    difference = np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(axis=1) // 2
    sums = np.concatenate([[0], np.cumsum(difference)])
    cuts = [0]
    for i, d in enumerate(difference.tolist()):
        first = max(cuts[-1], i - window)
        before, k = int(sums[i] - sums[first]), i - first
        if d > least * histograms[i].sum() and (k == 0 or d * k > factor * before):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def encode_texts(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add `n_bytes` and the AVI file of every text's payload (null: empty text).  A text of any
    length is stored whole; rows are worked off a few MB at a time."""
    keep = [c for c in df.columns if c not in (out, "n_bytes", text)]
    rows = df.select(*keep, F.col(text))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 19):
                texts = texts_of(batch.column(text))
                media = store([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", out])

    return rows.mapInArrow(run, schema)


CLIP = T.ArrayType(T.StructType([T.StructField("first_frame", T.IntegerType()), T.StructField("n_frames", T.IntegerType()), T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType())]))


def analyse(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace an AVI column by what is in it: n_frames, n_decoded, clips (timed rows of shots), and of
    stored payloads payload_bytes, payload_sha256 and tail_crc32, with media_bytes and media_sha256.

    A null or foreign file has no frame and null payload columns.  Frames that are not baseline JPEG
    count in n_frames only.
    """
    keep = [c for c in df.columns if c != media]
    extra = [("n_frames", T.IntegerType()), ("n_decoded", T.IntegerType()), ("clips", CLIP), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())]
    keep = [c for c in keep if c not in dict(extra)]
    rows = df.select(*keep, media)
    schema = T.StructType([*rows.select(*keep).schema.fields, *[T.StructField(n, k) for n, k in extra]])
    clip_type = pa.list_(pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    kinds = [pa.int32(), pa.int32(), clip_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, media, 1 << 20):
                files = [x or b"" for x in batch.column(media).to_pylist()]
                parsed = [frames_of(x) for x in files]
                decoded = iter(decode([f for frames, _, _ in parsed for f in frames]))
                found = []
                for data, (frames, micros, note) in zip(files, parsed, strict=True):
                    good = [d for d in (next(decoded) for _ in frames) if d is not None]
                    clips = [{"first_frame": a, "n_frames": b - a, "start_ms": a * micros / 1000, "end_ms": b * micros / 1000} for a, b in shots(np.array([d.histogram for d in good]))]
                    payload = (None, None, None)
                    if note.startswith(b"payload_bytes="):
                        n = int(note.rstrip(b"\0")[14:])
                        raw = (np.concatenate([d.coefs for d in good]).astype(np.int8).view(np.uint8) + np.uint8(CENTRE)).tobytes()[:n]
                        payload = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
                    found.append((len(frames), len(good), clips, *payload, len(data), hashlib.sha256(data).hexdigest()))
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *[n for n, _ in extra]])

    return rows.mapInArrow(run, schema)


def clip_rows(analysed: DataFrame, *keys: str) -> DataFrame:
    """One row per shot: the keys, clip (from 0), first_frame, n_frames, start_ms and end_ms."""
    return analysed.select(*keys, F.posexplode("clips").alias("clip", "c")).select(*keys, "clip", "c.*")


def feature(analysed: DataFrame) -> F.Column:
    """frames, shots and the shots' lengths as a text (a digest of the lengths, which may be many)."""
    lengths = F.array_join(F.transform("clips", lambda c: c["n_frames"].cast("string")), ",")
    return F.concat_ws("|", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("shots="), F.size("clips")), F.concat(F.lit("lengths="), F.substring(F.sha2(lengths, 256), 1, 16)))
