"""Averages along series against plain loops, and SER files that appear at the job's commit."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import timeseries as ts
from skyloom.plans import ephemeris, tracking
from skyloom.sources import ser


@pytest.mark.parametrize("block", [None, 1, 7, 400])
@pytest.mark.parametrize("seeded", [True, False])
def test_ema_last(spark, seeded, block):
    rng = np.random.default_rng(3)
    rows = [(k, t, None if (k + t) % 7 == 0 else float(v)) for k, n in ((1, 1), (2, 40), (3, 2500)) for t, v in enumerate(rng.normal(5, 2, n))] + [(4, 0, None)]
    want = {}
    for k, _, v in rows:
        if v is not None:
            s = want.get(k, v if seeded else 0.0)
            want[k] = 0.9 * s + 0.1 * v
    got = {r.k: r.state for r in ts.ema_last(spark.createDataFrame(rows, "k int, t long, v double").repartition(5), ["k"], ["t"], "v", 0.9, seeded, block and F.floor(F.col("t") / block)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_rotation_average_with_steps_without_time(spark):
    times, angle, rows = [0.0, 0.1, 0.1, 0.4, 0.9, 1.0], 0.0, []
    for i, t in enumerate(times):
        angle = 0.3 * t + 0.05 * t * t
        rows.append((1, t, math.cos(angle), math.sin(angle), 0.0))
    w = None
    for (_, a, x, y, _), (_, b, u, v, _) in zip(rows, rows[1:]):
        if b > a:
            rate = (math.atan2(v, u) - math.atan2(y, x)) / (b - a)
            w = rate if w is None else w + (1 - math.exp(-(b - a) / 0.5)) * (rate - w)
    got = tracking.track_model(spark.createDataFrame(rows, "k int, t_s double, x double, y double, z double"), 0.5, ["k"]).collect()
    assert len(got) == 1 and math.isclose(got[0].wz, w, rel_tol=1e-9) and got[0].wx == got[0].wy == 0


@pytest.mark.parametrize("batch, parts", [(3, 1), (10_000, 4)])
def test_background_in_any_batches_and_partitions(spark, batch, parts):
    rng = np.random.default_rng(8)
    rows = [(role, y, x, i, int(rng.integers(0, 999))) for role in "ab" for y in range(2) for i in range(30) for x in range(3 if i < 10 else 5)]
    ground, want = {}, {}
    for role, y, x, i, v in rows:
        b = ground.get((role, y, x), float(v))
        want[role, y, x, i], ground[role, y, x] = abs(v - b), b + 0.125 * (v - b)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        df = spark.createDataFrame(rows, "role string, y int, x int, idx long, v long").repartition(parts)
        got = ts.background_diff(df, ["role", "y"], "x", "idx", "v", 0.125).collect()
    finally:
        spark.conf.set(key, was)
    assert {(r.role, r.y, r.x, r.idx): r["diff"] for r in got} == want and len(got) == len(rows)
    assert ts.background_diff(df.limit(0), ["role", "y"], "x", "idx", "v", 0.125).count() == 0


def test_observing_lists(spark):
    stars = spark.createDataFrame([(1, 10.0, 20.0, 0), (2, 50.0, -5.0, 1)], "hip int, ra_deg double, dec_deg double, list int")
    sites = spark.createDataFrame([(7, 40.0, 10.0, 0), (8, -30.0, 90.0, 1), (9, 0.0, 0.0, 1)], "site int, lat_deg double, lon_deg double, list int")
    pairs = lambda keys, s: {(r.hip, r.site) for r in ephemeris.star_almanac(stars, s, 0, 0, keys=keys).collect()}
    assert pairs(["list"], sites) == {(1, 7), (2, 8), (2, 9)}
    assert pairs([], sites.drop("list")) == {(h, s) for h in (1, 2) for s in (7, 8, 9)}
    with pytest.raises(ValueError):
        ephemeris.star_almanac(stars, sites.drop("list"), 0, 0, most_sites=2)


FRAMES = "file string, index long, width int, height int, channels int, depth int, color_id int, t_us long, pixels binary"


def test_ser_files_appear_at_commit_only(spark, tmp_path):
    df = spark.createDataFrame([(f"f{k}", i, 2, 2, 1, 8, 0, i * 10, bytearray([k, i, 0, 1])) for k in range(3) for i in range(4)], FRAMES)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    ser.write_ser(df, good)
    assert sorted(os.listdir(good)) == ["f0.ser", "f1.ser", "f2.ser"]
    assert {(os.path.basename(r.file), r["index"], bytes(r.pixels)) for r in ser.read_ser(spark, good).collect()} == {(f"f{k}.ser", i, bytes([k, i, 0, 1])) for k in range(3) for i in range(4)}
    broken = df.withColumn("width", F.when((F.col("file") == "f2") & (F.col("index") == 3), F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("width")))
    with pytest.raises(Exception, match="broken"):
        ser.write_ser(broken, bad)
    assert not os.path.isdir(bad) or not [f for f in os.listdir(bad) if f.endswith(".ser")]


def test_clock_phase_is_that_of_one_read_after_the_other(spark):
    """Blocks of any length give what a plain loop gives: steady clocks, drifting ones, jumps, and repeated times."""
    rng, rows, want = np.random.default_rng(6), [], {}
    for k, (n, drift, jump) in enumerate([(1, 0, 0), (40, 0, 0), (300, 0.02, 0), (300, -0.03, 0), (200, 0.001, 0.2), (500, 0, 0.05)]):
        t = np.cumsum(rng.choice([0.0, 0.3, 1.7], n))
        shown = np.floor(t * (1 + drift) + 0.4 + np.cumsum(rng.choice([0, 0, 3, -2], n) * (rng.random(n) < jump)))
        for i, (a, b) in enumerate(zip(t, shown)):
            want[k] = tracking.clock_step(want[k], b - a) if i else b - a
            rows.append((k, i, float(a), float(b)))
    reads = spark.createDataFrame(rows, "k long, i long, t_s double, shown double").repartition(4)
    for size in (1, 13, 1000):
        got = {r.k: r.state for r in tracking.fit_clock(reads.withColumn("part", F.floor(F.col("i") / size)), ["k"], ["i"], "part").collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want), size


def test_parts_that_occur_in_names(spark):
    """Short, long, repeated, empty and null parts, in any case, against a plain search."""
    names = ["ISS (ZARYA)", "iss deb", "Tiangong", "a", "", None, "TIANGONG", "aaaa", "x" * 300 + "Ülm"]
    parts = ["iss", "ISS (Z", "gong", "A", "aa", "", None, "nowhere", "ülm", "iss"]
    got = ephemeris.occurring(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in parts], "part string")).collect()
    assert sorted(map(tuple, got)) == sorted({(n, p) for n in names if n is not None for p in parts if p and p.upper() in n.upper()})


def test_ema_series(spark):
    """Mean and variance after every row equal a plain loop's, for any blocks; rows without a value keep what was there."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, n in ((1, 1), (2, 30), (3, 1500)):
        m = s = 0.0
        for t, v in enumerate(rng.normal(100, 5, n)):
            v = None if (t + k) % 11 == 0 else float(v)
            if v is not None:
                before, m = m, 0.97 * m + 0.03 * v
                s = 0.97 * s + 0.03 * (v - before) * (v - m)
            rows.append((k, t, v))
            want[k, t] = (m, s)
    df = spark.createDataFrame(rows, "k int, t long, v double").repartition(5)
    for size in (1, 40, 1000):
        got = {(r.k, r.t): (r.mean, r.variance) for r in ts.ema_series(df, ["k"], ["t"], "v", 0.97, F.floor(F.col("t") / size)).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], rtol=1e-9) for x in want)


def test_settings_in_force(spark):
    """Each setting's last value at or before a frame, in one pass, against a plain search; several at one time, none before the first."""
    r = np.random.default_rng(7)
    control = [(int(r.integers(0, 3)), int(r.integers(0, 200)) * 3_600_000_000, *(None if r.random() < 0.5 else int(r.integers(0, 9)) for _ in range(2))) for _ in range(120)]
    frames = [(int(r.integers(0, 4)), int(r.integers(0, 200)) * 3_600_000_000, i) for i in range(150)]
    df = ts.effective_control(spark.createDataFrame(frames, "session long, t_us long, seq long"), spark.createDataFrame(control, "session long, t_us long, fps int, most int"), ["fps", "most"])
    want = []
    for s, t, i in frames:
        held = [max(((ct, v) for cs, ct, *vs in control if cs == s and ct <= t and (v := vs[j]) is not None), default=(0, None))[1] for j in (0, 1)]
        want.append((s, t, i, *held))
    assert sorted(map(str, map(tuple, df.select("session", "t_us", "seq", "fps", "most").collect()))) == sorted(map(str, want))
