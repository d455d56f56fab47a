"""Structured Streaming versions of the table operators. Sources are rolled files; state is kept by session, target or device. Each stateful
job takes rows by event time, drops what is behind the watermark or its state, and lets go of state that the watermark has passed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo
from ..operators import fleet
from ..shared import fresh_path
from ..sources.sidecars import read_sidecar

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_sidecar(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """New sidecar files as they appear, by the reader that batch jobs use."""
    return read_sidecar(spark, path, kind, streaming=True)


def timed(rows: DataFrame, delay: str) -> DataFrame:
    """The event time from t_us, with its watermark."""
    return rows.withColumn("event_t", F.timestamp_micros("t_us")).withWatermark("event_t", delay)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream. Written as a pattern, since a plain path would have to be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


#: The last second that a time stamp is written with four digits of the year for.
END_US = 253_402_300_799_000_000


def with_end(stream: DataFrame) -> DataFrame:
    """The rows (with t_us) of a table that is read to its end, and a last one, null but for its time, that takes the watermark past all others: windows and sessions
    that are still open then come out as well. The row itself stays behind the watermark's delay and never does. All of it is one micro-batch, so no row is late."""
    spark, at = stream.sparkSession, fresh_path(stream.sparkSession, "end")
    spark.createDataFrame([(END_US,)], "t_us long").write.parquet(at)
    return stream.unionByName(spark.readStream.schema("t_us long").parquet(at), allowMissingColumns=True)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that is there, then read the result. Append goes to files; the other modes keep each batch's table and the last (complete) or all (update) are read."""
    spark = stream.sparkSession
    out, at = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    batches = []

    def put(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/b={i}")
        batches.append(i)

    writer.foreachBatch(put).outputMode(mode).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/b={batches[-1]}")
    return spark.read.schema(stream.schema).option("basePath", out).parquet(*[f"{out}/b={i}" for i in batches]).select(*stream.columns, F.regexp_extract("_metadata.file_path", "b=([0-9]+)", 1).cast("long").alias("batch"))


def stream_health(frames: DataFrame, seconds: int = 1, delay: str = "10 seconds") -> DataFrame:
    """Tumbling frames, rate and peak of each role; late rows beyond the watermark are dropped."""
    w = F.window("event_t", f"{seconds} seconds")
    return timed(frames, delay).groupBy("kind", w.alias("w")).agg(F.count("*").alias("frames"), F.max("alt").alias("peak")).select("kind", F.unix_micros("w.start").alias("start_us"), "frames", (F.col("frames") / seconds).alias("fps"), "peak")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, in batch or update mode."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in (order, *rest)])


def lock_sessions(hits: DataFrame, gap: str, delay: str = "10 seconds", key: str = "session") -> DataFrame:
    """Episodes of associations that no gap longer than ``gap`` parts."""
    w = F.session_window("event_t", gap)
    return timed(hits, delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("hits"), F.max("t_us").alias("last_us")).select(key, F.unix_micros("w.start").alias("start_us"), "last_us", "hits")


class Bracket(StatefulProcessor):
    """Rows of a time bucket wait until the watermark is ``hold_us`` past the queries; the whole bucket is forgotten after its last query's turn. The state's key is an owner and a
    bucket or, with ``by``, a slot and a bucket, where ``by`` is the column of the owners that share the slot. Each access to the state costs more than many rows' work: rows are
    kept by columns as bytes, one entry a delivery, timers are only added, and all owners of a slot are answered at once."""

    def __init__(self, values: list[str], reach_us: int, hold_us: int, bucket_us: int, by: str | None = None) -> None:
        self.values, self.reach_us, self.hold_us, self.bucket_us, self.by = values, reach_us, hold_us, bucket_us, by
        self.kinds = ({by: np.int64} if by else {}) | {"id": np.int64, "t_us": np.int64, "is_query": np.bool_} | {v: np.float64 for v in values}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ", ".join(f"{c} binary" for c in self.kinds))

    def wake(self, time: int) -> None:
        self.handle.registerTimer(-(-time // 1000))

    def end_of(self, key) -> int:
        return (int(key[1]) + 1) * self.bucket_us + self.hold_us

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        new = {c: np.concatenate([p[c].to_numpy(kind) for p in parts]) for c, kind in self.kinds.items()}
        self.rows.appendValue(tuple(a.tobytes() for a in new.values()))
        asked = new["t_us"][new["is_query"]]
        self.wake(int(asked.min()) + self.hold_us if len(asked) else self.end_of(key))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.rows.get())
        if not parts:
            return
        held = {c: np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, (c, kind) in enumerate(self.kinds.items())}
        owner = held[self.by] if self.by else np.full(len(held["id"]), int(key[0]))
        order = np.lexsort((held["id"], held["t_us"], owner))
        held, owner = {c: a[order] for c, a in held.items()}, owner[order]
        t, asked = held["t_us"], held["is_query"]
        ready = asked & (t + self.hold_us <= mark)
        samples = np.flatnonzero(~asked)
        again = np.append(False, (owner[samples[1:]] == owner[samples[:-1]]) & (t[samples[1:]] == t[samples[:-1]]))[: len(samples)]
        samples = samples[~again]  # of one time, the first
        if ready.any():
            yield self.answered(held, owner, np.flatnonzero(ready), samples)
        waiting = np.flatnonzero(asked & ~ready)
        rest = np.concatenate([waiting, samples])
        if mark >= self.end_of(key) or not len(rest):
            self.rows.clear()
        else:
            self.rows.put([tuple(a[rest].tobytes() for a in held.values())])
        if mark < self.end_of(key):
            self.wake(min(int(t[waiting].min()) + self.hold_us, self.end_of(key)) if len(waiting) else self.end_of(key))

    def answered(self, held: dict[str, np.ndarray], owner: np.ndarray, asked: np.ndarray, samples: np.ndarray) -> pd.DataFrame:
        t, (times, rank) = held["t_us"], np.unique(held["t_us"], return_inverse=True)
        whose = np.unique(owner, return_inverse=True)[1]
        at = whose * len(times) + rank
        place = np.searchsorted(at[samples], at[asked], side="right")
        out = {"owner": owner[asked], "id": held["id"][asked], "t_us": t[asked]}
        found = {}
        for side, i, most in (("p", place - 1, self.reach_us), ("n", place, self.hold_us)):
            inside = (i >= 0) & (i < len(samples))
            s = samples[np.where(inside, i, 0)] if len(samples) else np.zeros_like(asked)
            found[side] = s, ~(inside & (whose[s] == whose[asked]) & (np.abs(t[s] - t[asked]) <= most))
        out |= {f"{side}_t": pd.arrays.IntegerArray(t[s], no) for side, (s, no) in found.items()}
        return pd.DataFrame(out | {f"{side}_{v}": np.where(no, np.nan, held[v][s]) for side, (s, no) in found.items() for v in self.values})

    def close(self) -> None:
        pass


#: Owners share so many slots; a slot's rows of one bucket are the most that a task holds at once.
SLOTS = 64


def bracket(rows: DataFrame, key: str, values: list[str], reach_us: int, hold_us: int, bucket_us: int, delay: str = "10 seconds") -> DataFrame:
    """As-of join within one stream. rows: key, id, t_us, is_query and values. A query comes out when the watermark is ``hold_us`` past it, with the samples
    around it (p_t, p_*, n_t, n_*): the newest one at or before it, at most ``reach_us`` old, and the first one after it, at most ``hold_us`` later; null where there is none.
    State is kept by slot (of many keys) and time bucket, so the number of states does not grow with the keys, a busy key is dealt out and nothing stays longer than its bucket;
    a sample goes to every bucket whose queries it can answer."""
    doubles = ", ".join(f"{side}_{v} double" for side in "pn" for v in values)
    schema = f"owner long, id long, t_us long, p_t long, n_t long, {doubles}"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    place = lambda t: F.floor(t / bucket_us)
    t = F.col("t_us")
    buckets = F.when(F.col("is_query"), F.array(place(t))).otherwise(F.sequence(place(t - hold_us), place(t + reach_us)))
    dealt = timed(rows.withColumnRenamed(key, "owner"), delay).withColumn("bucket", F.explode(buckets)).withColumn("slot", F.pmod(F.xxhash64("owner"), F.lit(SLOTS)))
    out = dealt.groupBy("slot", "bucket").transformWithStateInPandas(Bracket(values, reach_us, hold_us, bucket_us, "owner"), schema, "append", "EventTime")
    return out.withColumnRenamed("owner", key)


def stream_pose(rows: DataFrame, key: str = "session", **limits) -> DataFrame:
    """Frames with the pose between the mount samples around them; where there is only one of the two, its pose holds. ``limits`` are those of ``bracket``."""
    j = bracket(rows, key, ["az", "alt"], **limits)
    part = (F.col("t_us") - F.col("p_t")) / (F.col("n_t") - F.col("p_t"))
    value = lambda a: F.when(F.col("p_t").isNull(), F.col(f"n_{a}")).when(F.col("n_t").isNull(), F.col(f"p_{a}")).otherwise(F.col(f"p_{a}") + geo.wrap_pi(F.col(f"n_{a}") - F.col(f"p_{a}")) * part)
    return j.select(key, F.col("id").alias("seq"), value("az").alias("az"), value("alt").alias("alt"))


def stream_dirs(rows: DataFrame, key: str, **limits) -> DataFrame:
    """Directions between almanac fixes, or of the only one. ``limits`` are those of ``bracket``."""
    j = bracket(rows, key, ["x", "y", "z"], **limits)
    part = F.when(F.col("p_t").isNull(), 1.0).when(F.col("n_t").isNull(), 0.0).otherwise((F.col("t_us") - F.col("p_t")) / (F.col("n_t") - F.col("p_t")))
    d = geo.normalize(tuple(geo.lerp(F.coalesce(f"p_{a}", f"n_{a}"), F.coalesce(f"n_{a}", f"p_{a}"), part) for a in "xyz"), 1e-9)
    return j.select(key, "id", "t_us", *[c.alias(a) for c, a in zip(d, "xyz")])


def stream_kinematics(fixes: DataFrame, key: str = "url", delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """Velocity and acceleration of each position report (x, y, z); the state is the fix before and its velocity. A report that is not newer than its target's
    last is left out. A target's state goes when the watermark is ``idle_ms`` past its last report."""
    names = [key, "seq", *[f"{p}{a}" for p in "va" for a in "xyz"]]
    schema = f"{key} long, seq long, " + ", ".join(f"{n} double" for n in names[2:])

    def step(group, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        t0, place, speed = state.get if state.exists else (None, None, None)
        new = pd.concat(list(batches)).sort_values(["t_us", "seq"]).drop_duplicates("t_us")
        new = new if t0 is None else new[new["t_us"] > t0]
        if not len(new):
            return
        nan = [np.nan] * 3
        t = new["t_us"].to_numpy(np.int64)
        x = np.vstack([place or nan, new[["x", "y", "z"]].to_numpy(float)])
        dt = np.append(np.nan if t0 is None else t[0] - t0, np.diff(t))[:, None] / 1e6
        v = np.diff(x, axis=0) / dt
        a = np.diff(np.vstack([speed or nan, v]), axis=0) / dt
        frame = pd.DataFrame(np.hstack([v, a]), columns=names[2:])
        frame.insert(0, "seq", new["seq"].to_numpy(np.int64))
        frame.insert(0, key, group[0])
        last = int(new["t_us"].iloc[-1])
        state.update((last, x[-1].tolist(), None if np.isnan(v[-1]).any() else v[-1].tolist()))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield frame

    return timed(fixes, delay).groupBy(key).applyInPandasWithState(step, schema, "t long, place array<double>, speed array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def first_reports(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Reports that are not late, each once: what is behind the watermark is dropped, and so is a repeated key while the watermark has not passed the first one by ``delay``."""
    return timed(rows, delay).dropDuplicatesWithinWatermark(keys).drop("event_t")


def health_of(frames: DataFrame, seconds: int) -> DataFrame:
    return fleet.capture_health(frames, seconds)
