"""Tracking: motion models of targets, prediction, and the soonest way to meet one."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geo
from ..operators.timeseries import lagged


def predict(d: geo.V3, omega: geo.V3, dt) -> geo.V3:
    """The direction after turning with the rotation vector omega for dt seconds; slower than 1e-12 it holds still."""
    rate = geo.norm(omega)
    axis = geo.scale(omega, 1 / F.greatest(rate, F.lit(1e-12)))
    moved = geo.rodrigues(d, axis, rate * geo.c(dt))
    return tuple(F.when(rate < 1e-12, a).otherwise(b) for a, b in zip(d, moved))


def track_model(dirs: DataFrame, tau: float, keys: list[str], t: str = "t_s") -> DataFrame:
    """Rotation vector at the end of each track: instantaneous rates by lag, then a time-aware EMA with weight 1 - exp(-dt / tau). A step without time changes nothing; no turn is a zero rate."""
    w = lagged(keys, t)
    a = tuple(F.lag(k).over(w) for k in "xyz")
    rows = dirs.select("*", (F.col(t) - F.lag(t).over(w)).alias("dt"), *[x.alias(f"p{k}") for x, k in zip(a, "xyz")])
    turn = geo.cross(geo.v3("p"), geo.v3())
    sine = geo.norm(turn)
    rate = F.when(sine > 1e-9, F.atan2(sine, geo.dot(geo.v3("p"), geo.v3())) / sine / F.col("dt")).otherwise(0.0)
    rows = rows.filter("dt > 0").select(*keys, t, "dt", *[(x * rate).alias(f"w{k}") for x, k in zip(turn, "xyz")])
    rows = rows.withColumn("age", F.max(t).over(Window.partitionBy(*keys)) - F.col(t))
    first = F.min_by(F.struct("age", "dt", "wx", "wy", "wz"), t)
    weight = (1 - F.exp(-F.col("dt") / tau)) * F.exp(-F.col("age") / tau)  # what is left of a step's weight at the end; the first step has the whole weight
    out = rows.groupBy(*keys).agg(first.alias("f"), *[F.sum(weight * F.col(f"w{a}")).alias(f"w{a}") for a in "xyz"])
    return out.select(*keys, *[(F.col(f"w{a}") + F.exp(-(F.col("f.dt") + F.col("f.age")) / tau) * F.col(f"f.w{a}")).alias(f"w{a}") for a in "xyz"])


def intercept(ticks: DataFrame, keys: list[str], most_rate: float, least_s: float = 0.5, step_s: float = 0.1, steps: int = 80) -> DataFrame:
    """For each tick (az, alt of the mount; x, y, z and wx, wy, wz of the target): the soonest horizon and gentler of the two poses that both axes reach within most_rate, else the one that exceeds it least, with clamped rates."""
    rows = ticks.withColumn("dt", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: least_s + step_s * j)))
    rows = rows.withColumn("p", F.struct(*[c.alias(a) for c, a in zip(predict(geo.v3(), geo.v3("w"), "dt"), "xyz")]))
    az, alt = geo.dir_to_azalt(tuple(F.col(f"p.{a}") for a in "xyz"))
    rows = rows.withColumns({"taz": az, "talt": alt}).withColumn("pose", F.explode(F.array(F.lit(0), F.lit(1))))
    flip = F.col("pose") == 1
    raz = geo.wrap_pi(F.col("taz") + F.when(flip, math.pi).otherwise(0.0) - F.col("az")) / F.col("dt")
    ralt = geo.wrap_pi(F.when(flip, math.pi - F.col("talt")).otherwise(F.col("talt")) - F.col("alt")) / F.col("dt")
    rows = rows.withColumns({"raz": raz, "ralt": ralt}).withColumn("worst", F.greatest(F.abs("raz"), F.abs("ralt")))
    ok = F.col("worst") <= most_rate
    order = F.struct((~ok).cast("int").alias("bad"), F.when(ok, F.col("dt")).otherwise(F.col("worst")).alias("first"), F.when(ok, F.col("worst")).otherwise(F.col("dt")).alias("second"), "pose")
    b = rows.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "dt", "pose", "raz", "ralt")).alias("b"))
    clamp = lambda c: F.greatest(F.lit(-most_rate), F.least(F.lit(most_rate), F.col(c)))
    return b.select(*keys, (F.col("b.o.bad") == 0).alias("feasible"), F.col("b.dt").alias("dt"), F.col("b.pose").alias("pose"), clamp("b.raz").alias("rate_az"), clamp("b.ralt").alias("rate_alt"))


def clock_step(phase: float, q: float) -> float:
    """The phase after a read whose shown second less its time is q: kept within [q - 0.1, q + 1.1], else held to q or q + 1."""
    return q if phase - q < -0.1 else q + 1.0 if phase - q > 1.1 else phase


class ClockBlock:
    """What a block of reads does to any phase that comes in: ``records`` of (read, whether it is a lower bound, bound, the phase at the block's end). A phase is kept unless a
    read's bound holds it; the first read to do so decides, and from there on the phase in no longer matters. Only reads whose bounds are tighter than all
    before can be first. Reads are taken one by one; the phases held so far are touched only where a read lies beyond the least or greatest of them."""

    def __init__(self, first: float) -> None:
        self.first, self.n, self.low, self.high = first, 0, -math.inf, math.inf
        self.records, self.ends, self.least, self.most = [], [], math.inf, -math.inf

    def take(self, q: float) -> None:
        if self.least - q < -0.1 or self.most - q > 1.1:
            self.ends = [clock_step(e, q) for e in self.ends]
            self.least, self.most = min(self.ends), max(self.ends)
        for tighter, is_low, end in ((q - 0.1 > self.low, True, q), (q + 1.1 < self.high, False, q + 1.0)):
            if tighter:
                self.records.append((self.n, is_low, q))
                self.ends.append(end)
                self.least, self.most = min(self.least, end), max(self.most, end)
        self.low, self.high, self.n = max(self.low, q - 0.1), min(self.high, q + 1.1), self.n + 1

    def row(self) -> tuple:
        return (self.first, *map(list, zip(*self.records)), self.ends)


def fit_clock(reads: DataFrame, keys: list[str], order: list[str], block: str) -> DataFrame:
    """keys and ``state``: the sub-second phase of whole-second clocks after each key's reads. Each read has the monotonic time t_s and the shown second. The phase is that of
    the first read, carried on; within [-0.1, 1.1] of a read it is kept, else it is held to 0 or 1 second. ``block`` is a column that does not fall with
    ``order``: blocks are summed up apart, as maps of the phase, and the maps of a key are then applied one after the other, so no row and no task holds a series.
    Tasks read their blocks one after the other in Spark's order, since most blocks are too short for a call of their own."""
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema if f.name in [*keys, block]}
    names = ", ".join(f"{k} {kinds[k]}" for k in [*keys, block])
    columns = [*keys, block, "first", "at", "is_low", "q", "ends"]

    def summed(batches):
        of = held = None
        for batch in batches:
            out = []
            for *of_read, q in zip(*(c.to_pylist() for c in batch.columns)):
                if of_read != of:
                    if held:
                        out.append((*of, *held.row()))
                    of, held = of_read, ClockBlock(q)
                held.take(q)
            yield table(out)
        if held:
            yield table([(*of, *held.row())])

    maps_schema = f"{names}, first double, at array<long>, is_low array<boolean>, q array<double>, ends array<double>"
    kept = reads.select(*keys, block, *order, (F.col("shown") - F.col("t_s")).cast("double").alias("clock_q"))
    sorted_reads = kept.repartition(*keys, block).sortWithinPartitions(*keys, block, *order).select(*keys, block, "clock_q")
    arrow = {"first": pa.float64(), "at": pa.list_(pa.int64()), "is_low": pa.list_(pa.bool_()), "q": pa.list_(pa.float64()), "ends": pa.list_(pa.float64())}
    key_types = {f.name: to_arrow_type(f.dataType) for f in kept.schema if f.name in [*keys, block]}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], key_types.get(c) or arrow[c]) for i, c in enumerate(columns)], names=columns)

    maps = sorted_reads.mapInArrow(summed, maps_schema)

    def applied(parts):
        of, phase = None, None
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                key = tuple(r[: len(keys)])
                phase = phase if key == of else r.first
                of = key
                held = [(i, e) for i, low, q, e in zip(r.at, r.is_low, r.q, r.ends) if (phase - q < -0.1 if low else phase - q > 1.1)]
                phase = min(held)[1] if held else phase
                out.append((*key, r[len(keys)], phase))
            yield pd.DataFrame(out, columns=[*keys, block, "state"])

    steps = maps.repartition(*keys).sortWithinPartitions(*keys, block).mapInPandas(applied, f"{names}, state double")
    return steps.groupBy(*keys).agg(F.max_by("state", block).alias("state"))
