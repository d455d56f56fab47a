"""Cases that larger tables brought up."""

import math
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyloom import stream_queries, target_queries  # noqa: F401  (target queries register)
from skyloom.registry import QUERIES
from skyloom.functions import geo
from skyloom.operators import blobs, timeseries
from skyloom.plans import align, ephemeris, frames, tracking
from skyloom.sources import catalogs, ser
from skyloom.streaming import jobs, track
from skyloom.views import view


def test_times_of_long_recordings(spark, monkeypatch):
    pixels = spark.createDataFrame([(1, 20_000, y, x, 7) for y in range(8) for x in range(8)], "role int, idx int, y int, x int, v long")
    monkeypatch.setattr(stream_queries, "view", lambda *_: pixels)
    [f] = stream_queries.ser_frames(spark, "").collect()
    assert (f.file, f["index"], f.t_us) == ("role1-200", 0, 4_000_000_000)


def test_angles_wrap_at_the_seam_as_in_sql(spark):
    turns = [5 * math.radians((72 * k + half) / 100) - math.radians(k * 3.6) for k in range(100) for half in (-3600, 3600)]
    sql = lambda a: a + math.pi - 2 * math.pi * math.floor((a + math.pi) / (2 * math.pi)) - math.pi
    got = spark.createDataFrame([(a,) for a in turns], "a double").select("a", geo.wrap_pi("a").alias("w")).collect()
    assert all(r.w == sql(r.a) == track.wrap(r.a) for r in got)


def streamed(spark, path, rows):
    spark.createDataFrame(rows, "session long, kind string, t_us long, alt double").write.parquet(path)
    return jobs.with_end(spark.readStream.schema("session long, kind string, t_us long, alt double").parquet(path))


def test_windows_and_sessions_that_are_open_at_the_end_come_out(spark, tmp_path):
    rows = [(1, "view", t * 1_000_000, 0.5) for t in (5, 12, 13)]
    windows = jobs.run_to_end(jobs.stream_health(streamed(spark, str(tmp_path / "a"), rows), 10, "1 hour"), "w").collect()
    assert sorted((r.kind, r.start_us, r.frames) for r in windows) == [("view", 0, 1), ("view", 10_000_000, 2)]
    sessions = jobs.run_to_end(jobs.lock_sessions(streamed(spark, str(tmp_path / "b"), rows), "3 seconds", "1 hour"), "s").collect()
    assert sorted((r.session, r.start_us, r.hits) for r in sessions) == [(1, 5_000_000, 1), (1, 12_000_000, 2)]


def test_catalogue_numbers_of_any_size_fit_five_columns(spark):
    numbers = [0, 5, 99_999, 100_000, 179_999, 180_000, 339_999, 340_000, 1_200_000, 7_200_000, 44_000_000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", catalogs.catalogue_field(F.col("n")).alias("f"))
    got = {r.n: (r.f, r.back) for r in rows.select("*", catalogs.catalogue_number(F.col("f")).alias("back")).collect()}
    assert all(len(f) == 5 and back == n for n, (f, back) in got.items()) and len({f for f, _ in got.values()}) == len(numbers)
    assert got[5][0] == "00005" and got[100_000][0] == "A0000" and got[339_999][0] == "Z9999"


def test_star_names_with_seven_digits(spark):
    line = lambda number: (" " * 18 + "Vega".ljust(18)).ljust(96 - len(number)) + number
    lines = spark.createDataFrame([(line(n),) for n in (" 91262", "1234567", "  _   ")], "value string")
    assert sorted((r.proper, r.hip) for r in catalogs.read_star_names(lines).collect()) == [("Vega", 91262), ("Vega", 1234567)]


def test_many_satellites_at_once_are_as_one_by_one():
    k, t = 200, np.arange(0.0, 600.0, 30.0)
    draw = np.random.default_rng(3).uniform
    e = {"n": draw(6.5, 16.3, k) * 2 * np.pi / 1440, "ecc": np.where(np.arange(k) % 5, draw(1e-3, 2e-2, k), 5e-5), "inc": draw(0, np.pi, k), "argp": draw(0, 6, k), "node": draw(0, 6, k), "m": draw(0, 6, k), "bstar": draw(0, 5e-4, k)}
    one = np.stack([ephemeris.sgp4({c: float(v[i]) for c, v in e.items()}, t) for i in range(k)])
    assert np.allclose(ephemeris.sgp4({c: v[:, None] for c, v in e.items()}, np.tile(t, (k, 1))), one, atol=1e-6, equal_nan=True)


def test_files_do_not_grow_with_sessions(spark, tmp_path, monkeypatch):
    events = [(e, e % 300, "view" if e % 2 else "purchase", 0.5, '{"k": %d}' % (e % 100)) for e in range(1200)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string")
    rows.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    for name, expected, key in (("frame_index", 1200, "index"), ("read_alignment", 600, "obs_idx"), ("read_aircraft", 1028, None)):
        at = str(tmp_path / name)
        monkeypatch.setattr(stream_queries, "fresh_path", lambda *_, at=at: at)
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == expected and len(list(Path(at).rglob("*.txt"))) <= 4
        if key:
            assert {r[key] for r in got} == set(range(4)) and len({r["session"] for r in got}) == expected // 4


def test_fits_of_targets_that_lie_close_reach_the_truth():
    aim = np.array([[-0.2634, -0.0484, 0.9635], [-0.7449, -0.4384, 0.503], [-0.7544, -0.3859, 0.531]])
    aim = (aim / np.linalg.norm(aim, axis=1, keepdims=True))[None]
    truth = np.array([[0.3, 0.1, 0, 0, 0, 0, 0]])
    raw = np.stack([np.arctan2(aim[..., 1], aim[..., 0]) + 0.3, np.arcsin(aim[..., 2]) + 0.1], -1)
    found, value = align.fit(np.array([[0.2, 0, 0.02, -0.02, 0, 0, 0]]), raw, aim, 4000)
    assert np.allclose(found, truth, atol=1e-9) and value[0] - 1e-6 < 1e-18


def test_a_model_that_is_right_stays_right():
    """Or a beam that starts at the truth loses it among pairs that fit by chance."""
    aim = np.array([[[-0.48, 0.6, 0.64], [0.36, 0.48, 0.8]]])
    truth = np.array([[0.3, 0.1, 0, 0, 0, 0, 0]])
    raw = np.stack([np.arctan2(aim[..., 1], aim[..., 0]) + 0.3, np.arcsin(aim[..., 2]) + 0.1], -1)
    assert align.fit(truth, raw, aim, 100)[1][0] - 1e-6 < 1e-18


def test_almanac_times_are_dealt_by_their_own_unit(spark):
    """Fixes and times of one target fall into many buckets; neighbours are found across empty ones."""
    fixes = spark.createDataFrame([(1, t, *v) for t, v in ((5, (1.0, 0.0, 0.0)), (15, (0.0, 1.0, 0.0)), (95, (0.0, 0.0, 1.0)))], "cls int, t long, x double, y double, z double")
    times = spark.createDataFrame([(1, t) for t in (0, 10, 55, 200)], "cls int, t long")
    got = {r.t: [round(c, 6) for c in (r.x, r.y, r.z)] for r in timeseries.almanac_at(times, fixes, ["cls"], "t", 10).collect()}
    h = round(math.sqrt(0.5), 6)
    assert got == {0: [1, 0, 0], 10: [h, h, 0], 55: [0, h, h], 200: [0, 0, 1]}


def test_the_sample_after_is_found_in_one_pass(spark):
    """A frame that reaches to the end of its rows is summed anew for each of them: quadratic in a bucket."""
    rows = spark.createDataFrame([(1, 1, 0.0)], "k int, t long, x double")
    plan = timeseries.asof(rows.select("k", "t"), rows, ["k"], "t", ["x"])._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan


def test_first_observations_with_targets_are_exact_without_a_cap(spark, monkeypatch):
    """The first 40 observations of a key see nothing, so one look is not enough; the two that count have more than 1,000 targets each."""
    sky = lambda n, at: [(1, i, *at) for i in range(n)]
    obs = spark.createDataFrame(sky(40, (0.0, 0.0, -1.0)) + [(1, 40 + i, 1.0, 0.0, 0.0) for i in range(3)] + [(2, 5, 1.0, 0.0, 0.0)], "cls int, obs long, ox double, oy double, oz double")
    targets = spark.createDataFrame([(c, i, 0.999, 0.04, 0.0) for c in (1, 2) for i in range(1100)], "cls int, target long, x double, y double, z double")
    top = align.first_observed(obs, targets, 2, ["cls"], 0.6)
    assert sorted(map(tuple, top.groupBy("cls", "obs", "obs_idx").count().collect())) == [(1, 40, 0, 1100), (1, 41, 1, 1100), (2, 5, 0, 1100)]
    few = align.assignment_stats(top.withColumn("target", F.col("target") % 5), 2, ["cls"]).collect()
    assert list(map(tuple, few)) == [(1, 1100 * 1100, 25)]


def test_short_blocks_of_clock_reads_share_a_call(spark):
    """Blocks of two reads in many keys, over several batches: no call of Python for each of them."""
    reads = spark.range(6000).selectExpr("id div 4 AS k", "id % 4 AS i", "id % 4 div 2 AS part", "id % 4 * 1.0D AS t_s", "id % 4 + id div 4 % 3 - 1.0D AS shown")
    out = tracking.fit_clock(reads, ["k"], ["i"], "part")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    try:
        got = {r.k: r.state for r in out.collect()}
    finally:
        spark.conf.set(batch, before)
    assert got == {k: k % 3 - 1.0 for k in range(1500)}


def test_small_sets_of_targets_are_taken_whole(spark):
    """A search over many small sets pays for pairs and not for cells."""
    points = [(0.1 * i, math.sqrt(1 - 0.01 * i * i), 0.0) for i in range(8)]
    obs = spark.createDataFrame([(s, i, *p) for s in (1, 2) for i, p in enumerate(points[:3])], "s int, obs int, ox double, oy double, oz double")
    targets = spark.createDataFrame([(s, i, *p) for s in (1, 2) for i, p in enumerate(points)], "s int, target int, x double, y double, z double")
    assert align.candidates(obs, targets, 1, ["s"]).count() == 2 * 3 * 8
    assert {(r.obs, r.target) for r in align.nearest_target(obs, targets, ["s"], ["obs"]).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_means_of_squares_are_sums_divided_once():
    a = np.random.default_rng(1).integers(0, 65536, (40, 40)).astype(float)
    p = np.pad(a.astype(int), 1, mode="edge")
    sums = sum(p[y : y + 40, x : x + 40] for y in range(3) for x in range(3))
    assert (frames.box_mean(a, 1) == sums / 9).all()


def test_ranges_of_a_recording_are_read_by_more_than_one_task(spark, tmp_path):
    rows = [("r", i, 2, 2, 1, 8, 0, i, bytes(4)) for i in range(12 * ser.FRAMES_A_PARTITION)]
    ser.write_ser(spark.createDataFrame(rows, ser.SCHEMA), str(tmp_path / "s"))
    read = ser.read_ser(spark, str(tmp_path / "s")).select("index", F.spark_partition_id().alias("task")).collect()
    assert len(read) == len(rows) and len({r.task for r in read}) > 1


def test_points_that_blobs_bear_need_no_join(spark):
    rows = spark.createDataFrame([(1, 1900.0, 1000.0, 1910.0, 1000.0), (1, 1900.0, 1000.0, 1905.0, 1000.0), (2, 1900.0, 1000.0, 10.0, 10.0)], "frame long, at_x double, at_y double, px double, py double")
    picked = blobs.nearest_of(rows, ["frame", "at_x", "at_y"], 400.0)
    joined = blobs.pick(rows.select("frame", "at_x", "at_y").distinct(), rows.select("frame", "px", "py"), 400.0)
    assert sorted(picked.collect()) == sorted(joined.collect()) == [(1, 1900.0, 1000.0, 1905.0, 1000.0), (2, 1900.0, 1000.0, 1900.0, 1000.0)]
    assert "Join" not in picked._jdf.queryExecution().executedPlan().toString()


class Calls:
    """A state or handle that counts what is asked of it."""

    def __init__(self):
        self.made = []

    def __getattr__(self, name):
        return lambda *_: self.made.append(name) or []


def test_new_rows_of_a_session_cost_two_messages():
    tracker, calls = track.Tracker(track.Optics(0.0, 0.0, 1e-3), 1), Calls()
    tracker.handle = tracker.waiting = calls
    rows = pd.DataFrame({f: [[1.0], [2.0]] if f in ("px", "py") else ["frame"] * 2 if f == "kind" else [1, 2] for f in track.FIELDS})
    list(tracker.handleInputRows((1,), iter([rows]), None))
    assert calls.made == ["appendValue", "registerTimer"]


def test_new_rows_of_a_bucket_cost_two_messages():
    bucket, calls = jobs.Bracket(["az"], 10, 10, 100), Calls()
    bucket.handle = bucket.rows = calls
    list(bucket.handleInputRows((1, 0), iter([pd.DataFrame({"id": [1, 2], "t_us": [5, 6], "is_query": [True, False], "az": [0.0, 1.0]})]), None))
    assert calls.made == ["appendValue", "registerTimer"]


def test_of_blobs_with_equal_numbers_the_table_has_one_first(spark, tmp_path):
    part = next(k for k in range(1, 2000) if 300 < k * 7919 % 2160 < 500)
    py = part * 7919 % 2160
    line = {"l_orderkey": 7, "l_partkey": part, "l_suppkey": 1, "l_linenumber": 1, "l_extendedprice": py * 1.7, "l_quantity": 5.0, "l_discount": 0.1, "l_tax": 0.1}
    (tmp_path / "lineitem.parquet").mkdir()
    pd.DataFrame([line]).to_parquet(tmp_path / "lineitem.parquet/a.parquet")  # the larger file is read first, the table has the smaller one first
    pd.DataFrame([line | {"l_extendedprice": py * 1.7 + 40}, *[line | {"l_orderkey": 1000 + i} for i in range(5000)]]).to_parquet(tmp_path / "lineitem.parquet/b.parquet")
    pd.DataFrame({"o_orderkey": [7], "o_custkey": [3], "o_orderdate": pd.to_datetime(["2024-01-01"]).astype("datetime64[us]")}).to_parquet(tmp_path / "orders.parquet")
    [r] = QUERIES["detections_vs_world"](spark, str(tmp_path)).collect()
    assert abs(r.distance - 0.15 * py) < 0.01


def crowded(rng, n, spread):
    v = np.array([0.6, 0.0, 0.8]) + rng.normal(size=(n, 3)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_random_search_finds_targets_among_near_neighbours(spark, tmp_path):
    """Two batches of guesses do not settle the second set."""
    stars = np.vstack([crowded(np.random.default_rng(s), 12, 0.02) for s in (5, 6)])
    pd.DataFrame({"vec_id": range(60, 84), "embedding": [v.tolist() for v in stars], "label": np.repeat([5, 6], 12)}).to_parquet(tmp_path / "embeddings.parquet")  # models are drawn by ids
    got = {r.set_id: (r.targets, r.o0, r.o1) for r in QUERIES["random_search"](spark, str(tmp_path)).collect()}
    assert got == {k * 1000000: (f"{12 * k},{12 * k + 1},{12 * k + 2}", 0.3, 0.1) for k in (5, 6)}


def test_a_narrow_beam_loses_nothing(spark):
    """The mount is tilted, so the pair that fits best after a few steps is another one than the true pair."""
    rng = np.random.default_rng(0)
    raw = np.stack([rng.uniform(0, 2, 3), rng.uniform(0.2, 1, 3)], -1)
    seen = align.point(np.array([[0.4, -0.2, 0.06, -0.05, 0, 0, 0]]), raw[None])[0]
    others = np.concatenate([seen + rng.normal(size=(3, 3)) * 0.1 for _ in range(3)])
    stars = np.vstack([seen, others / np.linalg.norm(others, axis=1)[:, None]])
    targets = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(stars)], "set_id long, target long, x double, y double, z double")
    obs = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(raw)], "set_id long, obs_idx long, raw0 double, raw1 double")
    best = align.beam_align(obs, targets, 3, width=1).first()
    assert best.targets == [0, 1, 2] and best.loss < 1e-6 + 1e-15


def test_blobs_are_not_dealt_again_for_each_cell(spark, tmp_path, monkeypatch):
    """A row is shuffled once, with a number for its place; frames of many blobs, which go by cells, come out the same."""
    rng = np.random.default_rng(4)
    rows = [(s, i, float(rng.uniform(0, 900)), float(rng.uniform(0, 500))) for s, n in ((1, 30), (2, 90)) for i in range(n)]
    u = spark.createDataFrame(rows, "frame long, blob long, px double, py double")
    world = u.select("frame", F.col("blob").alias("source"), (F.col("py") * 1.7).alias("sx"), (F.col("px") * 0.5).alias("sy"))
    got = []
    for whole in (1000, 50, 0):
        monkeypatch.setattr(blobs, "WHOLE", whole)
        got.append(sorted(map(tuple, blobs.match_world(u, world, 60.0).collect())))
    d = {(s, a, b): math.sqrt((x - 1.7 * q) ** 2 + (y - 0.5 * p) ** 2) for s, a, x, y in rows for t, b, p, q in rows if s == t}
    near = {k: v for k, v in d.items() if v <= 60}
    best = [k for k, v in near.items() if v == min(w for j, w in near.items() if j[:2] == k[:2]) == min(w for j, w in near.items() if j[::2] == k[::2])]
    assert [g[:3] for g in got[0]] == sorted(best) and got[0] == got[1] == got[2]
    pd.DataFrame({"l_orderkey": [7], "l_partkey": [1], "l_suppkey": [1], "l_linenumber": [1], "l_extendedprice": [1.0], "l_quantity": [5.0], "l_discount": [0.1], "l_tax": [0.1]}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": [7], "o_custkey": [3], "o_orderdate": pd.to_datetime(["2024-01-01"]).astype("datetime64[us]")}).to_parquet(tmp_path / "orders.parquet")
    assert [r.place for r in view(spark, str(tmp_path), "v_blobs", "lineitem").collect()] == [0]


def test_owners_of_a_slot_share_one_state():
    """Two messages for the rows of many owners; at the end each query has the samples of its own owner."""
    bucket, calls = jobs.Bracket(["az"], 10, 4, 100, "owner"), Calls()
    bucket.handle = bucket.rows = calls
    rows = pd.DataFrame({"owner": [7, 8, 7, 8, 7, 9, 7], "id": [1, 2, 3, 4, 5, 6, 8], "t_us": [5, 5, 6, 7, 9, 8, 5], "is_query": [False, False, True, True, False, True, False], "az": [0.5, 0.25, None, None, 0.75, None, 0.1]})
    list(bucket.handleInputRows((1, 0), iter([rows[:4], rows[4:]]), None))
    assert calls.made == ["appendValue", "registerTimer"]
    held = tuple(rows[c].to_numpy(kind).tobytes() for c, kind in bucket.kinds.items())
    calls.get = lambda: iter([held])
    timer = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: 1})()
    [out] = list(bucket.handleExpiredTimer((1, 0), timer, None))
    got = {r["id"]: [None if pd.isna(r[c]) else r[c] for c in ("owner", "p_t", "p_az", "n_t", "n_az")] for r in out.to_dict("records")}
    assert got == {3: [7, 5, 0.5, 9, 0.75], 4: [8, 5, 0.25, None, None], 6: [9, None, None, None, None]} and calls.made[-1] == "clear"


def test_satellites_are_dealt_once_for_all_chunks_of_time(spark):
    tle = "1 list, 'S' || id AS name, 2024 AS epoch_year, 1.5D AS epoch_day, 1e-4D AS bstar, id * 1D AS inclination_deg, 3D AS raan_deg, 0.001D AS eccentricity, 10D AS arg_perigee_deg, 5D AS mean_anomaly_deg, 15.5D AS revs_per_day".split(", ")
    sites = spark.range(3).selectExpr("1 list", "id AS site", "id * 20D AS lat_deg", "5D AS lon_deg", "0D AS h_m")
    run = lambda chunk: ephemeris.satellite_almanac(spark.range(4).selectExpr(*tle), sites, 0, 100_000_000, 10.0, chunk, ["list"])
    cut, whole = run(35.0), run(3600.0)  # chunks that neither steps nor the end divide
    assert "Generate" not in cut._jdf.queryExecution().optimizedPlan().toString()
    times = {t for k in range(0, 100_000_001, 35_000_000) for t in range(k, min(100_000_001, k + 35_000_000), 10_000_000)}
    rows = {(r.name, r.site, r.t_us): r for r in whole.collect()}
    assert len(rows) == 4 * 3 * 11 and cut.count() == 4 * 3 * len(times)
    assert all(rows[r.name, r.site, r.t_us] == r for r in cut.collect() if (r.name, r.site, r.t_us) in rows)
