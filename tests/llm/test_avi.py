import hashlib
import zlib

import numpy as np
from helpers import awkward, empty

from lodeseam.llm import avi, queries
from tests.conftest import SF


def slow_bits(data, n):
    return "".join(f"{b:08b}" for b in data)[:n]


def test_frames_round_trip_and_pixels():
    rng = np.random.default_rng(2)
    levels = np.concatenate([rng.integers(0, 256, (40, 64)), np.zeros((1, 64)), np.full((1, 64), 255), np.tile([0, 255], (1, 32))]).astype(np.uint8)
    frames = avi.encode_frames(levels)
    assert (avi.stored_samples(frames) == levels).all()
    for f, x in zip(avi.decode_frames(frames), levels, strict=True):
        assert f.shape == (64, 64) and (f == np.repeat(np.repeat(x.reshape(8, 8), 8, 0), 8, 1)).all()
    fps, back = avi.read_avi(avi.write_avi(frames))
    assert fps == 25 and back == frames
    data = avi.write_avi(frames)
    assert avi.read_avi(data[: data.rindex(b"idx1")])[1] == frames


def foreign_frame(seed, mean=0):
    """A frame of three components, 2 by 1 luma, with AC coefficients, coded here the slow way, and its luma coefficients."""
    rng = np.random.default_rng(seed)
    dc = {s: f"{c:0{n}b}" for c, n, s in avi.codes(avi.DC_COUNTS, bytes(range(12)))}
    ac = {s: f"{c:0{n}b}" for c, n, s in avi.codes(avi.AC_COUNTS, avi.AC_SYMBOLS)}
    low = lambda v: "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    bits, pred, luma = "", [0, 0, 0], []
    for _ in range(2):  # two MCUs
        for part in (0, 0, 1, 2):
            z = np.zeros(64, int)
            z[0] = mean + rng.integers(-60, 60)
            for k in rng.choice(np.arange(1, 64), 4, replace=False):
                z[k] = rng.integers(-9, 10)
            d, pred[part] = int(z[0]) - pred[part], int(z[0])
            bits += dc[abs(d).bit_length()] + low(d)
            run = 0
            last = max((k for k in range(1, 64) if z[k]), default=0)
            for k in range(1, last + 1):
                if not z[k]:
                    run += 1
                    continue
                while run > 15:
                    bits += ac[0xF0]
                    run -= 16
                bits += ac[run << 4 | abs(int(z[k])).bit_length()] + low(int(z[k]))
                run = 0
            if last < 63:
                bits += ac[0]
            if part == 0:
                luma.append(z)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    import struct

    head = b"\xff\xd8" + avi._segment(0xDB, bytes([0, *range(3, 67)])) + avi._segment(0xC0, struct.pack(">BHHB9B", 8, 8, 32, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0)) + avi._segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    return head + scan + b"\xff\xd9", luma


def test_general_baseline_frame():
    frame, luma = foreign_frame(4)
    got = avi.decode_frames([frame] * 2)[1]
    for k, z in enumerate(luma):
        c = np.zeros(64)
        c[avi.ZIGZAG] = z * np.arange(3, 67)
        c = c.reshape(8, 8)
        want = [[sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for x in range(8)] for y in range(8)]
        assert np.abs(got[:, 8 * k : 8 * k + 8] - np.clip(want, 0, 255)).max() <= 0.51


def test_shots():
    rng = np.random.default_rng(1)
    scene = lambda a, n: np.clip(rng.normal(a, 10, (n, 64)), 0, 255).astype(np.uint8)
    levels = np.concatenate([scene(40, 30), scene(200, 20), scene(100, 25)])
    assert avi.shots(avi.histograms(levels)).tolist() == [0, 30, 50]
    assert avi.shots(avi.histograms(scene(90, 50))).tolist() == [0]
    assert avi.shots(avi.histograms(levels[:0])).tolist() == []


def test_op6_query(spark):
    got = {r.doc_id: r for r in queries.op6_avi(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = r.text.encode()
        padded, x = data + bytes(-len(data) % 64), got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = avi.write_avi(avi.encode_frames(np.frombuffer(padded, np.uint8).reshape(-1, 64)))
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and x.feature


def test_files_of_other_makes(spark):
    """Foreign frames give clips of their luma, broken files a reason; neither stops the files beside them."""
    dark, light = ([foreign_frame(k, m)[0] for k in range(n)] for m, n in ((-250, 20), (250, 12)))
    good = avi.write_avi(avi.encode_frames(np.zeros((3, 64), np.uint8)))
    broken = bytearray(good)
    at = good.index(b"\xff\xda")
    broken[at + 10 : at + 14] = b"\xff\xff\xff\xff"
    rows = [(1, avi.write_avi(dark + light)), (2, b"RIFFnothing"), (3, good), (4, good[: len(good) // 2]), (5, None), (6, b""), (7, bytes(broken)), (8, good)]
    read = avi.read_media(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1))
    got = {r.doc_id: r for r in read.collect()}
    assert [(c.first_frame, c.last_frame) for c in got[1].clips] == [(0, 19), (20, 31)] and got[1].payload is None and got[1].clips[0].level < 100 < got[1].clips[1].level
    assert all(bytes(got[k].payload) == bytes(192) and got[k].media_error is None for k in (3, 8)) and (got[5].clips, got[5].media_error) == (None, None)
    assert got[2].media_error or got[2].clips == []
    assert all(got[k].payload is None or bytes(got[k].payload) != bytes(192) for k in (2, 4, 6)) and len(got) == 8
    clips = avi.clip_rows(read).where("doc_id = 1").orderBy("clip").collect()
    assert [(r.clip, r.start_s, r.end_s) for r in clips] == [(0, 0.0, 20 / 25), (1, 20 / 25, 32 / 25)]


def test_awkward(spark):
    rows = avi.read_media(avi.store_media(awkward(spark, more=("pos", "payload", "media", "text2")))).collect()
    assert len(rows) == 10 and {bytes(r.payload) for r in rows if r.doc_id in (1, 2)} == {bytes(64)}
    assert avi.read_media(avi.store_media(empty(spark))).count() == 0
