"""Media columns: AVI motion-JPEG.

Reading: RIFF chunks and the idx1 index give the frames; baseline JPEG frames are decoded in numpy, all frames of a batch in step,
a Huffman symbol of each at a time; cuts between shots are where the histogram difference stands out from those around it.

Storing a payload losslessly: a sample is the level of an 8 by 8 block. Its transform has only a DC coefficient, eight times the
level; quantised by eight, that is the byte less 128. A frame has 8 by 8 blocks, so 64 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.common import batched, fresh

SIDE, FPS, UNIT = 64, 25, 64

# The format's default tables, which motion-JPEG frames may leave out (code counts by length, then symbols).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
AC_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9"
    "aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)


def _zigzag() -> np.ndarray:
    """Row-major places of the coefficients, diagonal by diagonal, every other one reversed."""
    cells = sorted(((y + x, (y if (y + x) % 2 else x), 8 * y + x) for y in range(8) for x in range(8)))
    return np.array([c for *_, c in cells])


ZIGZAG = _zigzag()


def codes(counts, symbols) -> list[tuple[int, int, int]]:
    """Canonical codes: code, length, symbol."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def lookup(counts: tuple[int, ...], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: none) and symbol of the code that any 16 bits begin with."""
    length, symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    for code, n, s in codes(counts, symbols):
        length[code << 16 - n : code + 1 << 16 - n], symbol[code << 16 - n : code + 1 << 16 - n] = n, s
    return length, symbol


# ------------------------------------------------------------------ writing


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(data) + 2) + data


FRAME_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, 8]) + b"\x01" * 63) + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


@lru_cache(1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Of a block with DC difference d - 255: its bits and how many; the block's end included."""
    dc = {s: (c, n) for c, n, s in codes(DC_COUNTS, bytes(range(12)))}
    end, end_bits = next((c, n) for c, n, s in codes(AC_COUNTS, AC_SYMBOLS) if s == 0)
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        low = d if d > 0 else d + (1 << size) - 1
        value[d + 255], bits[d + 255] = ((code << size | low) << end_bits) | end, n + size + end_bits
    return value, bits


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of rows of 64 samples."""
    value, bits = _block_codes()
    n, width = len(samples), 160
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    out, at = np.zeros(n * width, np.uint8), np.arange(n) * (width * 8)
    for k in range(UNIT):
        d = diff[:, k]
        word = value[d] << (32 - (at & 7) - bits[d]).astype(np.uint32)
        first = at >> 3
        for j in range(4):
            out[first + j] |= (word >> np.uint32(24 - 8 * j)).astype(np.uint8)
        at += bits[d]
    rest = -at & 7  # the last byte is filled with ones
    out[(at - 1) >> 3] |= ((1 << rest) - 1).astype(np.uint8)
    size, data = ((at + 7) >> 3) - np.arange(n) * width, out.tobytes()
    return [FRAME_HEAD + data[k * width : k * width + s].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for k, s in enumerate(size.tolist())]


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file with one video stream of JPEG frames and its index."""
    chunk = lambda tag, data: tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", image))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(c := chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", head) + chunk(b"LIST", b"".join(movie)) + chunk(b"idx1", b"".join(index)))


# ------------------------------------------------------------------ reading


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames by the index (or, where it is missing, by the chunks themselves)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    micros, movie, index, walked, end = 1_000_000 // FPS, 0, [], [], len(data)

    def walk(at: int, last: int) -> None:
        nonlocal micros, movie
        while at + 8 <= last:
            tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if tag == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movie = at + 8
                walk(at + 12, min(at + 8 + size, last))
            elif tag == b"avih":
                micros = int.from_bytes(data[at + 8 : at + 12], "little") or micros
            elif tag == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + size // 16 * 16]))
            elif tag[2:] in (b"dc", b"db") and not index:
                walked.append((at, size))
            at += 8 + size + size % 2

    walk(12, end)
    base = movie if index and index[0][2] < movie else 0
    places = [(base + o, n) for tag, _, o, n in index if tag[2:] in (b"dc", b"db")] if index else walked
    return 1_000_000 / micros, [data[o + 8 : o + 8 + n] for o, n in places]


class _Head:
    """What stands before a frame's scan."""

    def __init__(self, data: bytes) -> None:
        self.quant, self.tables, self.restart = {}, {(0, k): (DC_COUNTS, bytes(range(12))) for k in (0, 1)} | {(1, k): (AC_COUNTS, AC_SYMBOLS) for k in (0, 1)}, 0
        at = 2
        while at + 4 <= len(data):
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1:], ">u2" if wide else "u1", 64).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    n = sum(counts)
                    self.tables[body[0] >> 4, body[0] & 15] = counts, body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("only baseline frames")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                break
            at += 2 + size
        if len(self.parts) == 1:  # a scan of one component is not interleaved
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.order = [k for k, p in enumerate(self.parts) for _ in range(p[1] * p[2])]


def _scan_start(frame: bytes) -> int:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")


_heads = lru_cache(256)(_Head)


def decode_blocks(head: _Head, scans: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Quantised DC coefficients (frames by blocks in scan order) and the others as (frame, block, place, value)."""
    if head.restart:
        raise ValueError("restart intervals are not supported")
    n, blocks = len(scans), len(head.order) * head.mcus[0] * head.mcus[1]
    width = max(map(len, scans)) + 8
    data = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in scans), np.uint8)
    dc_of, ac_of = zip(*(head.scan[p[0]] for p in head.parts), strict=True)
    order = np.array(head.order)
    dc_tables, ac_tables = ([lookup(*head.tables[c, t]) for t in of] for c, of in ((0, dc_of), (1, ac_of)))
    dc_len, dc_sym, ac_len, ac_sym = (np.stack([t[k] for t in tables]).ravel() for tables, k in ((dc_tables, 0), (dc_tables, 1), (ac_tables, 0), (ac_tables, 1)))
    dc, rest = np.zeros((n, blocks), np.int32), []
    predicted = np.zeros((n, len(head.parts)), np.int32)
    lane, bit, block, place = np.arange(n), np.arange(n, dtype=np.int64) * (width * 8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    limit = (np.arange(n, dtype=np.int64) + 1) * (width * 8) - 40

    def peek(at: np.ndarray) -> np.ndarray:
        first = at >> 3
        word = data[first].astype(np.uint32) << 24 | data[first + 1].astype(np.uint32) << 16 | data[first + 2].astype(np.uint32) << 8 | data[first + 3]
        return (word << (at & 7).astype(np.uint32)) >> np.uint32(16)

    def magnitude(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = (peek(at) >> (16 - size).astype(np.uint32)).astype(np.int32)
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)

    while len(lane):
        part = order[block % len(order)] if len(head.parts) > 1 else np.zeros(len(lane), np.int64)
        first = place == 0
        if first.all():
            at = part * 65536 + peek(bit)
            bit += dc_len[at]
            size = dc_sym[at].astype(np.int64)
            predicted[lane, part] += magnitude(bit, size)
            dc[lane, block] = predicted[lane, part]
            bit += size
            place[:] = 1
            at = part * 65536 + peek(bit)
            end = (ac_sym[at] == 0) & (ac_len[at] > 0)  # mostly the block ends here
            bit += np.where(end, ac_len[at], 0)
            place[end] = 64
        else:
            key = part * 65536 + peek(bit)
            length, symbol = np.where(first, dc_len[key], ac_len[key]), np.where(first, dc_sym[key], ac_sym[key]).astype(np.int64)
            bit += length
            size = np.where(first, symbol, symbol & 15)
            v = magnitude(bit, size)
            bit += size
            f = np.flatnonzero(first)
            predicted[lane[f], part[f]] += v[f]
            dc[lane[f], block[f]] = predicted[lane[f], part[f]]
            run = symbol >> 4
            over = ~first & (size == 0) & (run < 15)
            place = np.where(first, 1, np.where(over, 64, place + run + 1))
            some = np.flatnonzero(~first & (size > 0) & (place <= 64))
            if len(some):
                rest.append((lane[some], block[some], place[some] - 1, v[some]))
        done = place >= 64
        block += done
        place[done] = 0
        if (bit > limit[lane]).any():
            raise ValueError("a frame ends too early")
        if (block >= blocks).any():
            go = block < blocks
            lane, bit, block, place = lane[go], bit[go], block[go], place[go]
    return dc, rest


@lru_cache(1)
def _cosines() -> np.ndarray:
    u, x = np.arange(8)[None, :], np.arange(8)[:, None]
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, 0.5**0.5, 1) / 2


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Luma of baseline JPEG frames, height by width. Frames with equal heads are decoded in step."""
    groups: dict[bytes, list[int]] = {}
    starts = [_scan_start(f) for f in frames]
    for k, f in enumerate(frames):
        groups.setdefault(f[: starts[k]], []).append(k)
    out: list = [None] * len(frames)
    for prefix, own in groups.items():
        head = _heads(prefix)
        for k, picture in zip(own, _luma(head, [_unstuffed(frames[k], starts[k]) for k in own]), strict=True):
            out[k] = picture
    return out


def _unstuffed(frame: bytes, start: int) -> bytes:
    return frame[start : frame.rfind(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")


def _luma(head: _Head, scans: list[bytes]) -> np.ndarray:
    dc, rest = decode_blocks(head, scans)
    h, v, quant = head.parts[0][1], head.parts[0][2], head.quant[head.parts[0][3]]
    own = np.flatnonzero(np.tile(np.array(head.order) == 0, head.mcus[0] * head.mcus[1]))
    n, wide, high = len(scans), head.mcus[0] * h, head.mcus[1] * v
    # the places of luma blocks: MCUs row by row, in each its blocks row by row
    k = np.arange(len(own))
    mcu, inner = k // (h * v), k % (h * v)
    row, col = mcu // head.mcus[0] * v + inner // h, mcu % head.mcus[0] * h + inner % h
    if not rest:
        level = np.clip(np.rint(dc[:, own] * quant[0] / 8) + 128, 0, 255).astype(np.uint8)
        grid = np.zeros((n, high, wide), np.uint8)
        grid[:, row, col] = level
        return np.repeat(np.repeat(grid, 8, axis=1), 8, axis=2)[:, : head.height, : head.width]
    coefficients = np.zeros((n, len(own), 64), np.float64)
    coefficients[:, :, 0] = dc[:, own] * quant[0]
    rank = np.full(dc.shape[1], -1)
    rank[own] = k
    for lane, block, place, value in rest:
        ok = rank[block] >= 0
        coefficients[lane[ok], rank[block[ok]], ZIGZAG[place[ok]]] = value[ok] * quant[place[ok]]
    c = _cosines()
    pixels = np.einsum("yu,nbuv,xv->nbyx", c, coefficients.reshape(n, -1, 8, 8), c)
    grid = np.zeros((n, high, 8, wide, 8), np.uint8)
    grid[:, row, :, col, :] = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8).transpose(1, 0, 2, 3)
    return grid.reshape(n, high * 8, wide * 8)[:, : head.height, : head.width]


def stored_samples(frames: list[bytes]) -> np.ndarray:
    """The 64 samples of each frame that encode_frames made: the levels of its blocks."""
    scans = [_unstuffed(f, len(FRAME_HEAD)) for f in frames]
    dc, rest = decode_blocks(_heads(FRAME_HEAD), scans)
    if rest or any(not f.startswith(FRAME_HEAD) for f in frames):
        raise ValueError("frames of another make")
    return (dc + 128).astype(np.uint8)


def histograms(levels: np.ndarray, bins: int = 16) -> np.ndarray:
    """Of frames by samples: shares of the levels."""
    n = len(levels)
    if not n:
        return np.zeros((0, bins))
    key = np.arange(n)[:, None] * bins + (levels.reshape(n, -1) // (256 // bins))
    return np.bincount(key.ravel(), minlength=n * bins).reshape(n, bins) / levels[0].size


def shots(hist: np.ndarray, around: int = 8, factor: float = 2.5, least: float = 0.25) -> np.ndarray:
    """First frames of the shots. A cut is where the difference to the frame before is a local maximum, over `least`, and over
    the mean of the differences within `around` frames by `factor` of their deviations."""
    if not len(hist):
        return np.zeros(0, np.int64)
    d = np.concatenate([[0.0], np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2])
    n = len(d)
    s1, s2 = np.concatenate([[0.0], np.cumsum(d)]), np.concatenate([[0.0], np.cumsum(d * d)])
    lo, hi = np.maximum(np.arange(n) - around, 0), np.minimum(np.arange(n) + around + 1, n)
    count = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - d) / count
    deviation = np.sqrt(np.maximum((s2[hi] - s2[lo] - d * d) / count - mean * mean, 0))
    top = (d >= np.concatenate([[0.0], d[:-1]])) & (d > np.concatenate([d[1:], [0.0]]))
    cut = np.flatnonzero((d > least) & (d > mean + factor * deviation + 1e-9) & top)
    return np.unique(np.concatenate([[0], cut]))


# ------------------------------------------------------------------ columns


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def store_media(docs: DataFrame, text_col: str = "text", media: str = "media") -> DataFrame:
    """All rows and columns of docs, text_col replaced by a binary column: an AVI file of the text's UTF-8, filled up with bytes 0
    to a positive multiple of 64. Null text is empty. Equal texts give equal files; rows are independent. A column of the name
    `media` is replaced."""
    others = [f for f in docs.schema.fields if f.name not in (text_col, media)]
    (spare,) = fresh(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [payload(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            first = 0
            for part in _parts([len(d) for d in data]):
                own = data[first : first + part]
                frames = encode_frames(np.frombuffer(b"".join(own), np.uint8).reshape(-1, UNIT))
                files, at = [], 0
                for d in own:
                    files.append(write_avi(frames[at : at + len(d) // UNIT]))
                    at += len(d) // UNIT
                yield pa.RecordBatch.from_arrays([*(c.slice(first, part) for c in batch.columns[:-1]), pa.array(files, pa.binary())], names=[*batch.schema.names[:-1], media])
                first += part

    chosen = docs.select(*(docs[f"`{f.name}`"] for f in others), docs[f"`{text_col}`"].alias(spare))
    return batched(chosen).mapInArrow(run, T.StructType([*others, T.StructField(media, T.BinaryType())]))


def _parts(sizes: list[int], most: int = 1 << 20) -> Iterator[int]:
    """How many rows to take at a time for about `most` bytes."""
    n = total = 0
    for s in sizes:
        n, total = n + 1, total + s
        if total >= most:
            yield n
            n = total = 0
    if n:
        yield n


CLIPS = "clips array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,level:double>>"
CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64())]))


def read_media(docs: DataFrame, media: str = "media") -> DataFrame:
    """All rows and columns of docs plus `clips`, the timed shots with their mean level, `payload`, the samples read back, and
    `media_error`.

    Files of store_media give all of their samples as payload. Other AVI files of baseline motion-JPEG give clips of their luma and
    a null payload. A file that cannot be read (broken, no AVI, progressive frames or frames with restart intervals, which are
    not supported) gives nulls and the reason, and stops no other; null media gives nulls and no reason. Columns of these names
    are replaced.
    """
    kind = T._parse_datatype_string(f"payload binary, {CLIPS}, media_error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, first = batch.column(media).to_pylist(), 0
            for part in _parts([len(f or b"") for f in files], 4 << 20):
                rows = _read(files[first : first + part])
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), CLIP_TYPE, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, part) for c in batch.columns), *arrays], names=[*batch.schema.names, "payload", "clips", "media_error"])
                first += part

    docs = docs.drop("payload", "clips", "media_error")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *kind.fields]))


def clip_rows(read: DataFrame) -> DataFrame:
    """A row for each clip of read_media's result: its other columns, then clip, first_frame, last_frame, start_s, end_s, level.
    Columns of these names are replaced; files without clips give no row."""
    names = [f.name for f in CLIP_TYPE.value_type]
    (held,) = fresh(read, "clip")
    rest = [c for c in read.columns if c not in ("payload", "clips", "media_error", *names)]
    return read.select(*(F.col(f"`{c}`") for c in rest), F.explode("clips").alias(held)).select(*(F.col(f"`{c}`") for c in rest), f"{held}.*")


def _read(files: list[bytes | None]) -> list[tuple[bytes | None, list[dict] | None, str | None]]:
    """payload, clips, error of each file; the frames that store_media has made are decoded together."""
    out: list = [(None, None, None)] * len(files)
    own: list[tuple[int, float, list[bytes]]] = []
    for k, f in enumerate(files):
        if f is None:
            continue
        try:
            fps, frames = read_avi(f)
            if all(x.startswith(FRAME_HEAD) for x in frames):
                own.append((k, fps, frames))
            else:
                out[k] = None, _clips(*_looked_at(frames), fps), None
        except Exception as e:  # noqa: BLE001
            out[k] = None, None, f"{type(e).__name__}: {e}"
    try:
        levels = stored_samples([x for _, _, frames in own for x in frames]) if any(x[2] for x in own) else np.zeros((0, UNIT), np.uint8)
    except Exception as e:  # noqa: BLE001
        if len(own) > 1:  # one of them is broken
            for k, _, _ in own:
                out[k] = _read([files[k]])[0]
        else:
            out[own[0][0]] = None, None, f"{type(e).__name__}: {e}"
        return out
    hist, means, at = histograms(levels), levels.mean(axis=1), 0
    for k, fps, frames in own:
        to = at + len(frames)
        out[k] = levels[at:to].tobytes(), _clips(hist[at:to], means[at:to], fps), None
        at = to
    return out


def _looked_at(frames: list[bytes], pixels: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Histograms and mean levels of frames, decoded a few at a time."""
    hist, means, k, step = [], [], 0, 1
    while k < len(frames):
        for picture in (some := decode_frames(frames[k : k + step])):
            hist.append(histograms(picture.reshape(1, -1))[0])
            means.append(picture.mean())
        k, step = k + step, max(1, pixels // some[-1].size)
    return np.array(hist), np.array(means)


def _clips(hist: np.ndarray, means: np.ndarray, fps: float) -> list[dict]:
    starts = shots(hist).tolist()
    return [{"clip": k, "first_frame": s, "last_frame": e - 1, "start_s": s / fps, "end_s": e / fps, "level": float(np.mean(means[s:e]))} for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(hist)], strict=True))]
