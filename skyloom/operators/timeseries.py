"""As-of and interpolating joins of time series, and work along ordered series.

An as-of join deals rows by key and time bucket, not by key alone: the last sample of the buckets before is carried by a window over
buckets, so one long session is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

BUCKET_US = 6 * 3600 * 1_000_000


def asof(events: DataFrame, samples: DataFrame, keys: list[str], t: str, columns: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """events with ``prev`` (the last sample at or before t) and ``next`` (the first one after), structs of t and columns, null where there is none."""
    held = F.struct(t, *columns)
    number = F.floor(F.col(t) / bucket_us)
    s = samples.select(*keys, F.col(t), held.alias("asof_s")).withColumn("asof_b", number)
    e = events.withColumn("asof_b", number)
    per = s.groupBy(*keys, "asof_b").agg(F.max("asof_s").alias("last_s"), F.min("asof_s").alias("first_s"))
    buckets = e.select(*keys, "asof_b").distinct().join(per, [*keys, "asof_b"], "full")
    before = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, "asof_b", F.last("last_s", True).over(before("asof_b")).alias("carry_prev"), F.last("first_s", True).over(before(F.desc("asof_b"))).alias("carry_next"))
    rows = e.withColumn("asof_e", F.lit(1)).unionByName(s.withColumn("asof_e", F.lit(0)), allowMissingColumns=True)
    upto = lambda *order: Window.partitionBy(*keys, "asof_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the sample after comes from a window in falling order: one that reaches to the end of its rows is summed anew for each of them
    rows = rows.withColumn("prev", F.last("asof_s", True).over(upto(t, "asof_e"))).withColumn("next", F.last("asof_s", True).over(upto(F.desc(t), F.desc("asof_e"))))
    out = rows.filter("asof_e = 1").join(carried, [*keys, "asof_b"], "left")
    return out.select(*events.columns, F.coalesce("prev", "carry_prev").alias("prev"), F.coalesce("next", "carry_next").alias("next"))


def pose_at(frames: DataFrame, mount: DataFrame, keys: list[str] = ["session"], t: str = "t_us") -> DataFrame:
    """frames with az, alt: between samples linear along the shorter way (not wrapped again), after the last one its rates go on, before the first one it holds. mount has az, alt, rate_az, rate_alt (per second)."""
    j = asof(frames, mount, keys, t, ["az", "alt", "rate_az", "rate_alt"])
    seconds = (F.col(t) - F.col(f"prev.{t}")) / 1e6
    part = (F.col(t) - F.col(f"prev.{t}")) / (F.col(f"next.{t}") - F.col(f"prev.{t}"))

    def value(a: str) -> Column:
        p, n = F.col(f"prev.{a}"), F.col(f"next.{a}")
        return F.when(F.col("prev").isNull(), n).when(F.col("next").isNull(), p + F.col(f"prev.rate_{a}") * seconds).otherwise(p + geo.wrap_pi(n - p) * part)

    return j.select(*frames.columns, value("az").alias("az"), value("alt").alias("alt"))


def pose_asof(frames: DataFrame, anchors: DataFrame, cap_s: float, keys: list[str] = ["session"], t: str = "t_us") -> DataFrame:
    """frames with the last anchor's pose carried on at its rate for at most cap_s seconds; null before the first anchor."""
    j = asof(frames, anchors, keys, t, ["az", "alt", "rate_az", "rate_alt"])
    dt = F.greatest(F.lit(0.0), F.least(F.lit(cap_s), (F.col(t) - F.col(f"prev.{t}")) / 1e6))
    return j.select(*frames.columns, *[(F.col(f"prev.{a}") + F.col(f"prev.rate_{a}") * dt).alias(a) for a in ("az", "alt")])


def effective_control(frames: DataFrame, control: DataFrame, settings: list[str], keys: list[str] = ["session"], t: str = "t_us", bucket_us: int = BUCKET_US) -> DataFrame:
    """frames with each setting's last non-null value at or before t (of several at one time the greatest), all settings in one pass over time buckets."""
    number = F.floor(F.col(t) / bucket_us)
    held = [F.when(F.col(c).isNotNull(), F.struct(t, c)).alias(f"held_{c}") for c in settings]
    s = control.select(*keys, F.col(t), *held).withColumn("asof_b", number)
    e = frames.withColumn("asof_b", number)
    per = s.groupBy(*keys, "asof_b").agg(*[F.max(f"held_{c}").alias(f"last_{c}") for c in settings])
    order = Window.partitionBy(*keys).orderBy("asof_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = e.select(*keys, "asof_b").distinct().join(per, [*keys, "asof_b"], "full")
    carried = buckets.select(*keys, "asof_b", *[F.last(f"last_{c}", True).over(order).alias(f"carry_{c}") for c in settings])
    rows = e.withColumn("asof_e", F.lit(1)).unionByName(s.withColumn("asof_e", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "asof_b").orderBy(t, "asof_e").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.max(f"held_{c}").over(inside).alias(f"own_{c}") for c in settings]).filter("asof_e = 1")
    return rows.join(carried, [*keys, "asof_b"], "left").select(*[rows[c] for c in frames.columns], *[F.coalesce(f"own_{c}.{c}", f"carry_{c}.{c}").alias(c) for c in settings])


def almanac_at(queries: DataFrame, fixes: DataFrame, keys: list[str], t: str, bucket: int = BUCKET_US) -> DataFrame:
    """queries with the direction of the keyed target at t: linear between the fixes around it, held beyond them, a unit vector. ``bucket`` is in t's unit."""
    j = asof(queries, fixes, keys, t, ["x", "y", "z"], bucket)
    a, b = F.coalesce("prev", "next"), F.coalesce("next", "prev")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - a[t]) / F.greatest(F.lit(1), b[t] - a[t])))
    d = geo.normalize(tuple(geo.lerp(a[k], b[k], part) for k in "xyz"), 1e-9)
    return j.select(*queries.columns, *[e.alias(k) for e, k in zip(d, "xyz")])


def lagged(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def axis_rates(poses: DataFrame, keys: list[str] = ["session"], t: str = "t_us") -> DataFrame:
    """Rates per second from neighbouring samples; null for the first one and where no time has passed."""
    w = lagged(keys, t, "seq")
    dt = (F.col(t) - F.lag(t).over(w)) / 1e6
    return poses.select("*", *[F.when(dt > 0, geo.wrap_pi(F.col(a) - F.lag(a).over(w)) / dt).alias(f"rate_{a}") for a in ("az", "alt")])


def kinematics(fixes: DataFrame, keys: list[str] = ["url"], t: str = "t_us") -> DataFrame:
    """ECEF velocity and acceleration of position reports (x, y, z): velocity needs a fix before at an earlier time, acceleration one with a velocity."""
    w = lagged(keys, t, "seq")
    dt = (F.col(t) - F.lag(t).over(w)) / 1e6
    v = fixes.withColumns({f"v{a}": F.when(dt > 0, (F.col(a) - F.lag(a).over(w)) / dt) for a in "xyz"})
    return v.withColumns({f"a{a}": F.when(dt > 0, (F.col(f"v{a}") - F.lag(f"v{a}").over(w)) / dt) for a in "xyz"})


def path_gradient(series: DataFrame, value: str, keys: list[str], t: str, order: str) -> DataFrame:
    """Central differences, one-sided at the ends, over the series' first time step (seconds)."""
    w = lagged(keys, order)
    first = F.min(F.struct(order, (F.lead(t).over(w) - F.col(t)).alias("step")))
    steps = series.withColumn("grad_step", F.lead(t).over(w) - F.col(t))
    whole = Window.partitionBy(*keys)
    dt = F.min_by("grad_step", order).over(whole) / 1e6
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    g = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
    return steps.withColumn("gradient", g / dt).drop("grad_step")


def drop_out_of_order(rows: DataFrame, keys: list[str], t: str, arrival: str) -> DataFrame:
    """Rows later than all that arrived before them."""
    most = F.max(t).over(lagged(keys, arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("most_before", most).filter(F.col("most_before").isNull() | (F.col(t) > F.col("most_before"))).drop("most_before")


def lock_status(assoc: DataFrame, lock_min_us: int, lost_us: int, keys: list[str] = ["session"], t: str = "t_us") -> DataFrame:
    """status of each frame: ``hit`` (associated), ``miss`` (blobs, none inside the gate) or neither. A lock is settled lock_min_us after the first hit since a miss; a gap beyond lost_us is coast if settled, else lost."""
    w = lagged(keys, t, "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = assoc.withColumn("island", F.sum(F.col("miss").cast("int")).over(upto)).withColumn("good_t", F.last(F.when(F.col("hit"), F.col(t)), True).over(upto))
    island = Window.partitionBy(*keys, "island").orderBy(t, "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("since", F.min(F.when(F.col("hit"), F.col(t))).over(island))
    rows = rows.withColumn("settled", F.coalesce(F.col("good_t") - F.col("since") >= lock_min_us, F.lit(False)))
    gap = F.col(t) - F.col("good_t")
    return rows.withColumn("status", F.when(F.col("good_t").isNull(), "none").when(gap > lost_us, F.when(F.col("settled"), "coast").otherwise("lost")).otherwise("track")).drop("island", "since")


def schedule(frames: DataFrame, speed: float, keys: list[str] = ["session"], t: str = "t_us") -> DataFrame:
    """Replay offset in seconds from the series' first frame."""
    first = F.min(t).over(Window.partitionBy(*keys))
    return frames.withColumn("offset_s", (F.col(t) - first) / 1e6 / max(1e-6, speed))


def ema_last(rows: DataFrame, keys: list[str], order: list[str], value: str, keep: float, seeded: bool = True, block: Column | None = None) -> DataFrame:
    """keys and ``state``: the last value of s = keep * s + (1 - keep) * value over each key's rows in order, as a weighted sum (no row holds a series). s starts
    with the first value, or with 0 if not ``seeded``. Rows without a value take no part; a key without any has no row. ``block`` is a value that does not fall with
    ``order`` (a stretch of time or of frames): rows are then counted within blocks and blocks within keys, so a long series is many tasks."""
    rows = rows.withColumn("ema_block", F.lit(0) if block is None else block)
    age = F.row_number().over(Window.partitionBy(*keys, "ema_block").orderBy(*[F.col(c).desc() for c in order])) - 1
    aged = rows.filter(F.col(value).isNotNull()).select(*keys, "ema_block", F.col(value).cast("double").alias("ema_v"), age.alias("ema_age"))
    parts = aged.groupBy(*keys, "ema_block").agg(F.sum((1 - keep) * F.pow(F.lit(keep), "ema_age") * F.col("ema_v")).alias("part"), F.count("*").alias("n"), F.max_by("ema_v", "ema_age").alias("first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("ema_block")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    state = F.sum(F.col("part") * F.pow(F.lit(keep), "after"))
    if seeded:
        state = state + F.pow(F.lit(keep), F.max(F.col("after") + F.col("n"))) * F.max_by("first", "after")
    return parts.groupBy(*keys).agg(state.alias("state"))


def carried_in(parts: DataFrame, keys: list[str], block: str, keep: float, name: str) -> DataFrame:
    """keys, block and ``name``: what comes into each block (0 into a key's first) where a block of n rows turns v into keep ** n * v + part. Blocks are read in order, one after the other."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in [*keys, block])

    def run(batches):
        of, v = None, 0.0
        for rows in batches:
            key, out = list(zip(*[rows[k].tolist() for k in keys])), np.zeros(len(rows))
            for i, (k, part, n) in enumerate(zip(key, rows["part"].to_numpy(), rows["n"].to_numpy())):
                v = v if k == of else 0.0
                of, out[i] = k, v
                v = keep ** int(n) * v + part
            yield rows[[*keys, block]].assign(**{name: out})

    return parts.select(*keys, block, "n", "part").repartition(*keys).sortWithinPartitions(*keys, block).mapInPandas(run, f"{kinds}, {name} double")


def ema_series(rows: DataFrame, keys: list[str], order: list[str], value: str, keep: float, block: Column) -> DataFrame:
    """rows with ``mean`` and ``variance`` after each: mean = keep * mean + (1 - keep) * value and variance = keep * variance + (1 - keep) * (value - mean before) * (value - mean
    after), both from 0. ``block`` is a value that does not fall with ``order``, of some thousand rows at most: within blocks the sums are windows from 0, and what
    comes into a block is added with the weight that is left of it, so a long series is many tasks. Rows without a value take no part and have the means before."""
    w = Window.partitionBy(*keys, "ema_block").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    left = lambda n: F.pow(F.lit(keep), n)
    has = F.col(value).isNotNull().cast("int")
    r = rows.withColumn("ema_block", block).withColumn("ema_n", F.sum(has).over(upto))
    total = lambda x: F.coalesce(left(F.col("ema_n")) * F.sum(x * left(-F.col("ema_n"))).over(upto), F.lit(0.0))
    ends = lambda d, c: d.groupBy(*keys, "ema_block").agg(F.max("ema_n").alias("n"), F.max_by(c, F.struct("ema_n", *order)).alias("part"))
    r = r.withColumn("ema_local", total((1 - keep) * F.col(value)))
    r = r.join(carried_in(ends(r, "ema_local"), keys, "ema_block", keep, "ema_in"), [*keys, "ema_block"])
    r = r.withColumn("mean", F.col("ema_local") + left(F.col("ema_n")) * F.col("ema_in"))
    step = F.col(value) - F.coalesce(F.lag("mean").over(w), F.col("ema_in"))
    r = r.withColumn("ema_step", step).withColumn("ema_spread", total(keep * (1 - keep) * F.col("ema_step") * F.col("ema_step")))
    r = r.join(carried_in(ends(r, "ema_spread"), keys, "ema_block", keep, "ema_var"), [*keys, "ema_block"])
    return r.select(*[F.col(c) for c in rows.columns], "mean", (F.col("ema_spread") + left(F.col("ema_n")) * F.col("ema_var")).alias("variance"))


def background_diff(pixels: DataFrame, keys: list[str], pixel: str, order: str, value: str, rate: float) -> DataFrame:
    """pixels (keys, order, pixel, value) with ``diff``: the distance of each value from the pixel's exponentially averaged background, which then moves towards
    it by ``rate``; 0 for a pixel's first one. keys name a camera and a strip of its image, ``pixel`` counts from 0 within the strip. A task reads its strips frame by
    frame and holds one background a pixel, never a series."""
    schema = pixels.select(*keys, order, pixel, value).schema.add("diff", "double")

    def run(batches):
        at, ground = None, np.zeros(0)
        for batch in batches:
            held = [c.to_pylist() for c in batch.columns[: len(keys)]]
            frame, x, v = (batch.column(len(keys) + i).to_numpy() for i in range(3))
            strip = list(zip(*held))
            ends = np.flatnonzero(np.array([a != b for a, b in zip(strip[1:], strip)], bool) | (np.diff(frame) != 0)) + 1
            diff = np.zeros(len(v))
            for i, j in zip([0, *ends], [*ends, len(v)]):
                if i == j:
                    continue
                if strip[i] != at:
                    at, ground = strip[i], np.zeros(0)
                k = x[i:j]
                if k.max() >= len(ground):
                    ground = np.append(ground, np.full(k.max() + 1 - len(ground), np.nan))
                seen = v[i:j].astype(float)
                before = np.where(np.isnan(ground[k]), seen, ground[k])
                diff[i:j] = np.abs(seen - before)
                ground[k] = before + rate * (seen - before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(diff)], names=[*batch.schema.names, "diff"])

    return pixels.select(*keys, order, pixel, value).repartition(*keys).sortWithinPartitions(*keys, order, pixel).mapInArrow(run, schema)


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], init: Column, step) -> DataFrame:
    """keys and ``state``: step(state, row) over each key's rows in order, in JVM higher-order functions. For series that fit a row; longer ones are cut by a key of time."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("rows"))
    return held.select(*keys, F.aggregate("rows", init, step).alias("state"))
