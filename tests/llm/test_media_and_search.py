"""The AVI round trip, and the threshold algorithm against a full scan."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.llm import media, mjpeg, topk


@pytest.mark.parametrize("payload", [b"\0" * 64, bytes(range(256)), b"\xff" * 640, os.urandom(64 * 37)])
def test_avi_round_trip(payload):
    data = mjpeg.write_avi(payload)
    assert mjpeg.read_payload(data)[0] == payload
    frame = mjpeg.read_avi(data).frames[0]
    assert (mjpeg.decode_coefficients(frame)[0] == mjpeg._decode_general(frame)[0]).all()


@pytest.mark.parametrize("wrapped", [False, True])
def test_avi_without_index(wrapped):
    data = mjpeg.write_avi(bytes(range(256)) * 40)
    frames = mjpeg.read_avi(data).frames
    plain = data[: data.rindex(b"idx1")]
    if wrapped:  # frames in a list of their own, after a chunk of sound
        at = plain.index(b"movi")
        inner = mjpeg._chunk(b"01wb", b"abc") + mjpeg._chunk(b"LIST", b"rec " + plain[at + 4 :])
        plain = plain[: at - 8] + mjpeg._chunk(b"LIST", b"movi" + inner)
    assert len(frames) > 1 and mjpeg.read_avi(plain).frames == frames
    assert mjpeg.clip_rows(plain) == mjpeg.clip_rows(data)
    assert mjpeg.read_avi(plain[:-5]).frames[:-1] == frames[:-1]  # the file ends within a frame


def test_clips(spark):
    flat, noisy = b"\x80" * 1024 * 6, os.urandom(1024 * 6)
    rows = [(1, mjpeg.write_avi(flat + noisy)), (2, None), (3, b"RIFFxxxx"), (4, b"")]
    got = media.clips(spark.createDataFrame(rows, "id int, media binary")).collect()
    assert sum(r.id == 1 for r in got) >= 1 and {r.id for r in got if r.error} == {2, 3, 4}
    own = sorted((r.start_s, r.end_s) for r in got if r.id == 1)
    assert own[0][0] == 0 and own[-1][1] == pytest.approx(12 / mjpeg.FPS)
    assert mjpeg.shots(np.array([[1.0, 0]] * 5 + [[0, 1.0]] * 5)) == [(0, 5), (5, 10)]


@pytest.mark.parametrize("block", [8192, 64])
def test_threshold_algorithm_is_exact(spark, block, monkeypatch):
    """Against all scores, by one block and by many: repeated ids, null, short, empty and non-finite vectors, ties."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAST_BLOCK", min(block, topk.LEAST_BLOCK))
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(400)]
    rows += [(5, [9.0] * 6), (50, [1.0, 2.0]), (None, [1.0] * 6), (9000, [float("nan")] * 6), (9001, None), (9002, []), (9050, [0.0] * 6), (9003, [1.0, None])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, vector array<double>, rank int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 7).collect()
    valid = [(i, np.array((v + [0.0] * 6)[:6])) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for at, (q, x) in enumerate(valid):
        if q % 50 == 0:
            best = sorted((-float(x @ y), i) for j, (i, y) in enumerate(valid) if j != at)[:7]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0


def test_threshold_stops_early_on_skewed_lists():
    """Where few dimensions decide, reading stops long before the lists end."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(4000, 8)) * np.array([1000.0, 300, 3, 2, 1, 1, 1, 1]))
    rows = np.arange(4000)
    found = topk.threshold_top(rows, rows, x, rows[:20], x[:20], 5, np.full(20, -np.inf))
    for q, (at, scores, depth, scored) in enumerate(found):
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(-scores) == sorted(-s)[:5] and (at == sorted(range(4000), key=lambda i: (-s[i], i))[:5]).all()
    assert np.mean([scored for *_, scored in found]) < 1500


def test_digests_of_the_query(spark, tmp_path):
    """Each column of op5_media against hashlib and zlib, over the AVI that holds the text."""
    texts = [None, "", "a" * 64, "é\n" * 100, "x" * 5000, "a" * 64]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op5_media(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        avi = mjpeg.write_avi(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(avi), hashlib.sha256(avi).hexdigest())
        general = b"".join(np.where((c := mjpeg._decode_general(f)[0]) > 0, c, c + 255).astype(np.uint8).tobytes() for f in mjpeg.read_avi(avi).frames)
        assert general[: len(payload)] == payload
    assert got[2].media_sha256 == got[5].media_sha256


def test_broken_frames_are_errors(spark):
    good = mjpeg.write_avi(b"\x80" * 1024)
    at = good.index(b"\xff\xc0")
    zero, large = bytearray(good), bytearray(good)
    zero[at + 11] = 0  # sampling factors
    large[at + 5 : at + 9] = b"\xff\xff\xff\xff"  # height and width
    rows = [(1, bytes(zero)), (2, bytes(large)), (3, good[: at + 200]), (4, good)]
    got = {r.id: r.error for r in media.clips(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[4] is None and got[1] is None and got[2]  # one component alone is read without sampling factors
