"""Whole-frame jobs: scenes whose blobs are known, and results that do not depend on partitions."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import frame_queries, stream_queries  # noqa: F401
from skyloom.plans import frames as fr
from skyloom.registry import QUERIES
from skyloom.shared import fresh_path
from skyloom.sources import ser, sidecars
from skyloom.views import view

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(DATA), reason="the tables are not here")
def test_frame_jobs_take_all_frames_in_files_of_bounded_size(spark):
    frames = view(spark, DATA, "v_pixels").select("role", "idx").distinct().count()
    got = QUERIES["preview"](spark, DATA).groupBy("file").agg(F.countDistinct("index").alias("n")).collect()
    assert sum(r.n for r in got) == frames and all(r.n <= stream_queries.ROLL for r in got)


def star(a, x, y, light, sigma):
    yy, xx = np.indices(a.shape)
    a += light * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * sigma**2))
    return a


def near(b, x, y, far=3):
    return abs(b["px"] - x) <= far and abs(b["py"] - y) <= far


def found(a, **p):
    return fr.detect(a.astype(np.float32), fr.DetectParams(**p))[0]


def test_a_bright_area_is_no_blob():
    a = np.zeros((200, 200))
    a[20:120, 20:120] = 40000
    got = found(star(a, 160, 50, 60000, 2.0), surface="bandpass", rel=0.3, snr=0.0, max_size_px=6.0, psf=5.0)
    assert near(got[0], 160, 50) and got[0]["pointlike"] > 0.7 and got[0]["size_px"] < 6
    assert not any(40 < b["px"] < 100 and 40 < b["py"] < 100 for b in got)


def test_a_streak_is_not_round():
    a = np.zeros((200, 200))
    a[100:102, 60:100] = 60000
    star(a, 150, 150, 60000, 2.0)
    common = {"surface": "bandpass", "rel": 0.3, "snr": 0.0, "psf": 5.0, "grid": 1, "per_tile": 99}
    streak = lambda b: 60 <= b["px"] <= 100 and 95 <= b["py"] <= 105
    got, cut = found(a, **common), found(a, min_roundness=0.5, **common)
    assert [b["roundness"] > 0.6 for b in got if near(b, 150, 150)][0] and all(b["roundness"] < 0.4 for b in got if streak(b))
    assert any(map(streak, got)) and not any(map(streak, cut)) and any(near(b, 150, 150) for b in cut)


def test_the_hessian_is_flat_along_an_edge():
    a = star(star(np.zeros((200, 200)), 60, 60, 60000, 2.0), 140, 120, 50000, 2.5)
    a[150:152, 30:170] = 60000
    s = fr.det_of_hessian(a, 3.0)
    assert s[60, 60] > 0 and s[150, 100] < 0.1 * s[60, 60]
    got = found(a, rel=0.05, snr=8.0, min_blob_px=1, psf=4.0, sigma=3.0, grid=1, per_tile=99)
    assert any(near(b, 60, 60) for b in got) and any(near(b, 140, 120) for b in got)
    assert not any(50 <= b["px"] <= 150 and 148 <= b["py"] <= 154 for b in got)


def test_kernels_fit_into_small_frames():
    for n in (3, 4, 8):
        assert fr.det_of_hessian(np.random.default_rng(n).random((n, n + 5)), 3.0).shape == (n, n + 5)
    a = np.zeros((9, 9))
    a[0, :] = a[:, 0] = np.arange(9) == 8  # only pixels 8 away from the centre's row and column: a kernel of radius (9 - 1) // 2 does not reach them
    assert fr.det_of_hessian(a, 3.0)[0, 0] == fr.det_of_hessian(np.zeros((9, 9)), 3.0)[0, 0] == 0


def test_a_dense_corner_leaves_room_for_a_distant_star():
    a = np.zeros((200, 200))
    for i in range(25):
        star(a, 15 + i % 5 * 12, 15 + i // 5 * 12, 60000, 2.0)
    star(a, 175, 175, 30000, 2.0)
    common = {"sigma": 2.0, "rel": 0.02, "radius": 4, "min_blob_px": 1, "most": 8}
    assert not any(near(b, 175, 175, 4) for b in found(a, grid=1, per_tile=99, **common))
    assert any(near(b, 175, 175, 4) for b in found(a, grid=4, per_tile=1, **common))


def test_the_target_in_its_square():
    """The one near the prediction, not a brighter one outside nor a dimmer one inside; none when it is gone; coordinates of the whole frame."""
    sky = lambda: np.random.default_rng(0).random((300, 400)) * 5 + 100
    p = fr.DetectParams()
    look = lambda a, cx=200, cy=150, size=128, scale=1.0: fr.detect_roi(a.astype(np.float32), cx, cy, size, p, scale)
    assert near(look(star(star(sky(), 205, 153, 4000, 2.0), 40, 40, 9000, 2.0)), 205, 153)
    assert near(look(star(star(sky(), 200, 150, 4000, 2.0), 245, 185, 3000, 2.0)), 200, 150)
    assert look(sky()) is None and look(sky(), cx=-90) is None and look(sky(), size=2) is None
    half = look(star(sky(), 205, 153, 4000, 2.0), size=64, scale=2.0)
    assert near(half, 410, 306, 6) and half["moving"] and half["size_px"] == 6.0
    edge = look(star(sky(), 397, 3, 4000, 2.0), cx=390, cy=8, size=60)
    assert near(edge, 397, 3)


def recording(spark, n, side, name="cam"):
    """A star that moves over noise, beside one that stays."""
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        a = star(star(rng.random((side, side)) * 50, 10 + 7 * i % (side - 20), side / 2, 20000, 1.5), side / 2, side - 9, 20000, 1.5)
        rows.append((name, i, side, side, 1, 16, 0, i * 1000, a.astype("<u2").tobytes()))
    return spark.createDataFrame(rows, ser.SCHEMA)


def test_blobs_do_not_depend_on_partitions(spark):
    frames = recording(spark, 150, 40).filter("index <> 77")
    p = fr.DetectParams(sigma=1.5, radius=3)
    got = [sorted(map(str, fr.detect_frames(frames.repartition(k), p).collect())) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) >= 290
    flags = {}
    for r in fr.detect_frames(frames.repartition(5), p).collect():
        flags.setdefault(r["index"], []).append(str(r.moving))
    assert {i for i, f in flags.items() if "None" in f} == {0, 78} and all(set(flags[i]) == {"None"} for i in (0, 78))  # also across the borders of runs at 64 and 128
    assert sum(set(f) == {"False", "True"} for f in flags.values()) > 100


def test_the_reader_gives_each_range_the_frame_before(spark, monkeypatch):
    """Frames of 2 MB read from a file in ranges with a halo give what one task over the whole file gives."""
    path = fresh_path(spark, "ser")
    ser.write_ser(recording(spark, 12, 1000), path)
    monkeypatch.setattr(ser, "FRAMES_A_PARTITION", 5)
    held = ser.read_ser(spark, path, halo=True)
    assert sorted((r["index"], r.halo) for r in held.select("index", "halo").collect()) == sorted([(i, False) for i in range(12)] + [(4, True), (9, True)])
    p = fr.DetectParams(sigma=1.5, grid=1, per_tile=9)
    one = fr.detect_frames(ser.read_ser(spark, path).coalesce(1), p)
    assert sorted(map(str, fr.detect_frames(held, p).collect())) == sorted(map(str, one.collect()))
    assert ser.read_ser(spark, path).select("index").distinct().count() == 12 and ser.ser_segments(spark, path).first().frames == 12


def test_every_frame_has_a_line(spark):
    """Also frames without a blob; blobs come back as they were found."""
    frames = recording(spark, 30, 40).unionByName(recording(spark, 3, 24, "dark").withColumn("pixels", F.lit(bytes(24 * 24 * 2))))
    path, out = fresh_path(spark, "ser"), fresh_path(spark, "detections")
    ser.write_ser(frames, path)
    p = fr.DetectParams(sigma=1.5, radius=3)
    fr.detect_recording(spark, path, out, p)
    lines = sidecars.read_sidecar(spark, out, "detections").select("index", F.size("blobs").alias("n"), F.col("file").contains("recording=dark").alias("dark")).collect()
    assert sorted(r["index"] for r in lines if r.dark) == [0, 1, 2] and all(r.n == 0 for r in lines if r.dark)
    assert sorted(r["index"] for r in lines if not r.dark) == list(range(30)) and all(r.n for r in lines if not r.dark)
    back = sidecars.read_detections(spark, out).withColumnRenamed("recording", "file")
    assert sorted(map(str, back.collect())) == sorted(map(str, fr.detect_frames(frames, p).select(*back.columns).collect()))


def test_a_whole_frame_within_seconds():
    rng = np.random.default_rng(1)
    a = (rng.random((2160, 3840)) * 200).astype(np.float32)
    a[1000:1005, 2000:2005] += 30000
    start = time.perf_counter()
    got = fr.detect(a, fr.DetectParams())[0]
    assert near(got[0], 2002, 1002) and time.perf_counter() - start < 60
