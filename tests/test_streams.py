"""Streams in several micro-batches: state that is bounded loses no row."""

import random
import tempfile

import pytest

from skyloom.streaming import jobs, track


S = 1_000_000


def at(t):
    """Microseconds; the epoch itself is behind any watermark."""
    return int((1000 + t) * S)


def fed(spark, batches, schema):
    """A stream that reads each batch as a trigger of its own."""
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def asked(spark, batches):
    """Answers of the as-of join: before and after each query, by id."""
    schema = "session long, id long, t_us long, is_query boolean, az double, alt double"
    rows = [[(1, i, at(t), v is None, v, 0.0) for t, i, v in b] for b in batches]
    out = jobs.run_to_end(jobs.bracket(fed(spark, rows, schema), "session", ["az", "alt"], 40 * S, 20 * S, 10 * S, "5 seconds"), "bracket").collect()
    assert len({r.id for r in out}) == len(out)
    return {r.id: (r.p_az, r.n_az) for r in out}


def test_queries_come_out_by_the_watermark(spark):
    """A query waits for a later sample no longer than the hold; then it comes out with what there is, also after the last sample of its session."""
    batches = [[(0, 0, 10.0), *((10 + i, 1 + i, None) for i in range(5))], [(20, 7, None)], [(30, 0, 20.0), (45, 8, None)], [(90, 0, 30.0), (60, 9, None)], [(120, 10, None)]]
    want = {**{1 + i: (10, 20) for i in range(5)}, 7: (10, 20), 8: (20, None), 9: (20, None)}
    assert asked(spark, batches) == want  # 90 is more than 20 after 45 and 60; the query at 120 still waits
    assert asked(spark, [[r for b in batches[:4] for r in b], batches[4]]) == want


def test_samples_too_old_are_not_used(spark):
    assert asked(spark, [[(0, 0, 1.0), (35, 1, None), (45, 2, None), (46, 0, 2.0), (47, 3, None)], [(200, 4, None)]]) == {1: (1, 2), 2: (None, 2), 3: (2, None)}


def test_late_and_repeated_reports_are_dropped_and_counted(spark):
    """Three triggers: the third brings a repeated report, a late one, and a new one; Spark drops by the watermark of the trigger before."""
    schema = "session long, seq long, t_us long"
    batches = [[(1, 1, at(0)), (1, 2, at(100))], [(1, 3, at(200))], [(1, 3, at(200)), (1, 4, at(50)), (1, 5, at(195))]]
    query = jobs.first_reports(fed(spark, batches, schema), ["session", "seq"], "10 seconds").writeStream.format("memory").queryName("reports").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.seq for r in spark.table("reports").collect()) == [1, 2, 3, 5]
    held = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["numRowsDroppedByWatermark"] for p in held) == 1
    assert sum(p["customMetrics"].get("numDroppedDuplicateRows", 0) for p in held) == 1
    assert held[-1]["numRowsTotal"] <= 2  # reports that the watermark has passed are forgotten


def test_kinematics_of_a_target_that_reports_in_several_triggers(spark):
    """The same as in one trigger; a report that is not newer is left out; a target that falls silent is forgotten."""
    schema = "url long, seq long, t_us long, x double, y double, z double"
    rows = [(1, i, at(i * i), i**2 * 1.0, 2.0 * i, 5.0) for i in range(1, 8)]
    ahead = [(2, 99, at(9000), 0.0, 0.0, 0.0)]
    out = [sorted((r.seq, r.vx, r.vy, r.ax) for r in jobs.run_to_end(jobs.stream_kinematics(fed(spark, b, schema), idle_ms=60_000), "kin").collect()) for b in ([rows, ahead], [rows[:3], [*rows[3:5], (1, 50, rows[2][2], 9.0, 9.0, 9.0)], rows[5:], ahead])]
    assert str(out[0]) == str(out[1]) and len(out[0]) == 8
    assert [x[1] for x in out[0]][1:7] == pytest.approx([1.0] * 6)


TRACKED = "session long, " + track.ROW
OPTICS = track.Optics(100.0, 100.0, 1e-3)


def mount(t, az=0.0, session=1):
    return (session, int(t * 1000), at(t), "mount", az, 0.1, 0.0, 0.0, [], [])


def seen(t, *blobs, kind="frame", session=1):
    return (session, int(t * 1000), at(t), kind, None, None, None, None, [float(x) for x, _ in blobs], [float(y) for _, y in blobs])


def tracked(spark, batches, **kw):
    return sorted(jobs.run_to_end(track.track(fed(spark, batches, TRACKED), OPTICS, "2 seconds", **kw), "track").collect(), key=lambda r: (r.session, r.t_us, r.seq or -1))


def test_a_timer_alone_reports_the_loss(spark):
    """Nothing of the session arrives after its second frame; another session's rows move the watermark on."""
    batches = [[mount(0), seen(0.5, (100, 100), kind="seed"), seen(1, (102, 100))], [mount(2, session=2)], [mount(9, session=2)]]
    rows = tracked(spark, batches)
    assert [(r.seq, r.t_us, r.status) for r in rows] == [(500, at(0.5), "track"), (1000, at(1), "track"), (None, at(1) + OPTICS.lost_us + 1, "lost")]


def test_a_settled_lock_coasts_and_comes_back(spark):
    """Associations for a second settle the lock; without blobs it coasts by the model, and a blob in the gate makes it a track again."""
    frames = [seen(t / 4, (100 + t, 100)) for t in range(2, 10)]
    rows = tracked(spark, [[mount(0), seen(0.25, (101, 100), kind="seed"), *frames], [mount(3), seen(4.5), seen(4.75, (119, 100)), seen(5, (900, 900))], [mount(20)]])
    by_time = {r.t_us: r for r in rows}
    assert all(by_time[f[2]].status == "track" and by_time[f[2]].gated for f in frames)
    assert [(r.t_us, r.status) for r in rows if r.seq is None] == [(at(2.25) + OPTICS.lost_us + 1, "coast"), (at(4.75) + OPTICS.lost_us + 1, "lost")]
    assert by_time[at(4.5)].status == "coast" and not by_time[at(4.5)].gated and 110 < by_time[at(4.5)].px < 125
    assert by_time[at(4.75)].gated and by_time[at(4.75)].status == "track"
    assert not by_time[at(5)].gated  # outside the gate: the lock is no longer settled


def test_results_do_not_depend_on_micro_batches(spark):
    r = random.Random(6)
    rows = [mount(t / 2, az=t / 2000, session=s) for t in range(40) for s in (1, 2)] + [seen(1.1, (100, 100), kind="seed", session=s) for s in (1, 2)]
    rows += [seen(1.2 + t / 5, *[(100 + r.gauss(0, 40), 100 + r.gauss(0, 40)) for _ in range(r.randint(0, 3))], session=s) for t in range(70) for s in (1, 2)]
    rows = sorted(rows, key=lambda x: x[2] + r.uniform(0, 0.9) * S)  # out of order, but not late
    ahead = [[mount(60, session=3)]]
    one = tracked(spark, [rows, *ahead])
    assert one == tracked(spark, [rows[i : i + 45] for i in range(0, len(rows), 45)] + ahead)
    assert len(one) >= 142 and {x.status for x in one} >= {"track", "lost"} and any(x.gated for x in one)


def test_late_rows_are_dropped_and_idle_sessions_cleared(spark):
    batches = [[mount(0), seen(0.5, (100, 100), kind="seed")], [mount(50, session=2)], [mount(60, session=2)], [seen(1, (100, 100)), mount(70, session=2)], [mount(400, session=3)]]
    query = track.track(fed(spark, batches, TRACKED), OPTICS, "2 seconds", idle_us=30 * S).writeStream.format("noop").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) > 3 and held[-1] <= 4  # what is left belongs to session 3
