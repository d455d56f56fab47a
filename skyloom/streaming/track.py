"""Live tracking of one target a session as a stateful job: pose history, prediction, gate, motion model, lock status and timers.

Rows of a session arrive in any order within the watermark's delay. A frame waits in the state until the watermark is ``hold_us`` past it and is then
taken in order of time, with the pose between the mount samples around it; a sample that is more than ``hold_us`` later is not waited for, and the last
rates carry the pose on. So results do not depend on how rows fall into micro-batches. The state of a session is the rows that wait, the mount
samples of the last ``hold_us`` and the one before, the model with the lock, and counts of samples left out; it is cleared ``idle_us`` after the session's last row.

Rows (session, seq, t_us, kind, az, alt, rate_az, rate_alt, px, py): kind "mount" is a measured pose with its rates; "seed" picks the target at px[0], py[0] and
begins a track; "frame" has the blobs px, py (perhaps none). Out come a row for every frame and seed, and one where a timer finds that nothing was associated for longer
than ``lost_us``: session, seq (null for a timer), t_us, status ("none" before a seed, "track", "coast" for a lost lock that had settled, "lost" for one that
had not), gated (a blob was taken), px, py (the target as predicted, in the frame), x, y, z and wx, wy, wz (the model).

Mount samples not newer than the last one are left out; a frame that is not newer than the model's direction sets it anew
without a change of the rate; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROW = "seq long, t_us long, kind string, az double, alt double, rate_az double, rate_alt double, px array<double>, py array<double>"
FIELDS = [f.split()[0] for f in ROW.split(", ")]
OUT = "session long, seq long, t_us long, status string, gated boolean, px double, py double, x double, y double, z double, wx double, wy double, wz double"
SAMPLE = "t_us long, az double, alt double, rate_az double, rate_alt double"
MODEL = "t_us long, x double, y double, z double, wx double, wy double, wz double, good_us long, since_us long, settled boolean"


@dataclass(frozen=True)
class Optics:
    """Centre and scale of the image, its axes' signs, the gate, smoothing and lock times."""

    cx: float
    cy: float
    rad_per_px: float
    gate_px: float = 80.0
    smoothing_s: float = 0.5
    lost_us: int = 1_500_000
    lock_us: int = 1_000_000
    hold_us: int = 1_000_000
    sign_az: float = 1.0
    sign_alt: float = -1.0

    @staticmethod
    def axes(az: float, alt: float) -> tuple[tuple, tuple, tuple]:
        """Forward, side (towards growing az), up (towards growing alt)."""
        sa, ca, se, ce = math.sin(az), math.cos(az), math.sin(alt), math.cos(alt)
        return (ca * ce, sa * ce, se), (-sa, ca, 0.0), (-ca * se, -sa * se, ce)

    def direction(self, px: float, py: float, az: float, alt: float) -> tuple:
        ox, oy = (px - self.cx) * self.rad_per_px * self.sign_az, (py - self.cy) * self.rad_per_px * self.sign_alt
        return unit([f + ox * s + oy * u for f, s, u in zip(*self.axes(az, alt))])

    def pixel(self, d: tuple, az: float, alt: float) -> tuple[float, float]:
        ahead, side, up = (dot(axis, d) for axis in self.axes(az, alt))
        scale = 1.0 / ahead if ahead > 1e-6 else 1e6
        return self.cx + side * scale / (self.rad_per_px * self.sign_az), self.cy + up * scale / (self.rad_per_px * self.sign_alt)


def dot(a, b) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a) -> tuple:
    n = math.sqrt(dot(a, a))
    return a[0] / n, a[1] / n, a[2] / n


def wrap(a: float) -> float:
    up = a + math.pi
    return up - 2 * math.pi * math.floor(up / (2 * math.pi)) - math.pi


class Track:
    """The model and lock of a session; mount samples are (t_us, az, alt, rate_az, rate_alt). Three numbers are too few for numpy: a call costs more than the sum."""

    def __init__(self, optics: Optics, model: tuple | None, history: list[tuple]) -> None:
        self.o, self.history, self.times, self.posed = optics, history, [s[0] for s in history], None
        self.t, self.d, self.w, self.good, self.since, self.settled = None, None, (0.0, 0.0, 0.0), None, None, False
        if model is not None:
            self.t, self.d, self.w = model[0], tuple(model[1:4]), tuple(model[4:7])
            self.good, self.since, self.settled = model[7:]

    def held(self) -> tuple:
        return (self.t, *self.d, *self.w, self.good, self.since, self.settled)

    def sample(self, row: tuple) -> bool:
        """Take a mount sample; False if it is not newer than the last."""
        if self.times and row[0] <= self.times[-1]:
            return False
        self.history.append(row)
        self.times.append(row[0])
        self.posed = None
        return True

    def forget(self, t: int) -> None:
        """Drop the samples that no time after ``t`` needs."""
        gone = max(0, bisect_right(self.times, t) - 1)
        del self.history[:gone], self.times[:gone]
        self.posed = None

    def pose(self, t: int) -> tuple[float, float]:
        """Between samples along the shorter way, before them the first, after them at the last rates; without any, zero."""
        if self.posed is None or self.posed[0] != t:
            self.posed = (t, self.pose_of(t))
        return self.posed[1]

    def pose_of(self, t: int) -> tuple[float, float]:
        h, end, at = self.history, bisect_right(self.times, t + self.o.hold_us), bisect_right(self.times, t)
        if not end:
            return 0.0, 0.0
        if at == end:
            dt = (t - h[at - 1][0]) / 1e6
            return h[at - 1][1] + h[at - 1][3] * dt, h[at - 1][2] + h[at - 1][4] * dt
        if at == 0:
            return h[0][1], h[0][2]
        a, b = h[at - 1], h[at]
        part = (t - a[0]) / (b[0] - a[0])
        return a[1] + wrap(b[1] - a[1]) * part, a[2] + wrap(b[2] - a[2]) * part

    def predict(self, t: int) -> tuple:
        rate = math.sqrt(dot(self.w, self.w))
        if rate < 1e-12:
            return self.d
        axis, angle = [w / rate for w in self.w], rate * (t - self.t) / 1e6
        c, s, along = math.cos(angle), math.sin(angle), dot(axis, self.d) * (1 - math.cos(angle))
        return unit([d * c + n * s + a * along for d, n, a in zip(self.d, cross(axis, self.d), axis)])

    def ingest(self, t: int, d: tuple) -> None:
        if self.d is not None and t > self.t:
            dt = (t - self.t) / 1e6
            turn = cross(self.d, d)
            s = math.sqrt(dot(turn, turn))
            rate = math.atan2(s, dot(self.d, d)) / dt / s if s > 1e-9 else 0.0
            weight = 1 - math.exp(-dt / self.o.smoothing_s)
            self.w = tuple(w * (1 - weight) + n * rate * weight for w, n in zip(self.w, turn))
        self.t, self.d = t, d

    def seed(self, t: int, px: float, py: float) -> None:
        self.ingest(t, self.o.direction(px, py, *self.pose(t)))
        self.good, self.since, self.settled = t, None, False

    def frame(self, t: int, px: list, py: list) -> bool:
        """Associate the nearest blob within the gate; True if there is one."""
        if self.d is None or not len(px):
            return False
        pose = self.pose(t)
        ex, ey = self.o.pixel(self.predict(t), *pose)
        far = [math.hypot(x - ex, y - ey) for x, y in zip(px, py)]
        best = far.index(min(far))
        if far[best] > self.o.gate_px:
            self.since, self.settled = None, False
            return False
        self.ingest(t, self.o.direction(px[best], py[best], *pose))
        self.good, self.since = t, t if self.since is None else self.since
        self.settled = t - self.since >= self.o.lock_us
        return True

    def status(self, t: int) -> str:
        return "none" if self.d is None else "track" if t - self.good <= self.o.lost_us else "coast" if self.settled else "lost"

    def row(self, session: int, seq: int | None, t: int, gated: bool) -> tuple:
        px, py = self.o.pixel(self.predict(t), *self.pose(t)) if self.d is not None else (None, None)
        return (session, seq, t, self.status(t), gated, px, py, *(self.d or [None] * 3), *self.w)


class Tracker(StatefulProcessor):
    """Each access to the state is a message to Spark, which costs more than a row's work. So rows wait by columns, one entry a delivery; the model
    with the lock is one value, the samples are another; and a timer is added where one may be needed, without a look at those that are set: one that finds nothing to do changes nothing."""

    def __init__(self, optics: Optics, idle_us: int) -> None:
        self.optics, self.idle_us = optics, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{k}>" for n, k in (f.split() for f in ROW.split(", "))))
        self.held = handle.getValueState("held", f"{MODEL}, lost_us long, last_us long")
        self.history = handle.getValueState("history", ", ".join(f"{n} array<{k}>" for n, k in (f.split() for f in SAMPLE.split(", "))))
        self.left_out = handle.getMapState("left_out", "reason string", "n long")

    def wake(self, time: int) -> None:
        self.handle.registerTimer(-(-time // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """New rows wait; nothing comes out before the watermark has passed them."""
        number = lambda v: None if v is None or v != v else float(v)
        parts = [[batch[f].tolist() for f in FIELDS] for batch in rows]
        seq, t, kind, *poses, px, py = [list(chain.from_iterable(p[i] for p in parts)) for i in range(len(FIELDS))]
        self.waiting.appendValue((list(map(int, seq)), list(map(int, t)), kind, *[list(map(number, p)) for p in poses], *[[[] if v is None else list(map(float, v)) for v in p] for p in (px, py)]))
        self.wake(min(t) + self.optics.hold_us)
        return iter(())

    def count(self, reason: str, n: int) -> None:
        before = self.left_out.getValue((reason,))[0] if self.left_out.containsKey((reason,)) else 0
        self.left_out.updateValue((reason,), (before + n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, mark, hold = int(key[0]), timerValues.getCurrentWatermarkInMs() * 1000, self.optics.hold_us
        rows = sorted((r for part in self.waiting.get() for r in zip(*part)), key=lambda r: (r[1], r[0]))
        held = self.held.get()
        if not rows and held is None:
            return
        n = len(MODEL.split(", "))
        lost, last = held[n:] if held is not None else (None, None)
        track = Track(self.optics, tuple(held[:n]) if held is not None and held[0] is not None else None, list(zip(*self.history.get())) if held is not None else [])
        later, out, older = [], [], 0
        for r in rows:
            if r[2] != "mount" or r[1] > mark:
                later.append(r)
            elif not track.sample((r[1], *r[3:7])):
                older += 1
        if older:
            self.count("repeated or older sample", older)
        ready, later = [r for r in later if r[1] + hold <= mark and r[2] != "mount"], [r for r in later if r[1] + hold > mark or r[2] == "mount"]
        for r in ready:
            if lost is not None and lost < r[1]:
                out.append(track.row(session, None, lost, False))
                lost = None
            gated = False
            if r[2] == "seed":
                track.seed(r[1], r[7][0], r[8][0])
            else:
                gated = track.frame(r[1], r[7], r[8])
            out.append(track.row(session, r[0], r[1], gated))
            if r[2] == "seed" or gated:
                lost = r[1] + self.optics.lost_us + 1
        if lost is not None and lost + hold <= mark:
            out.append(track.row(session, None, lost, False))
            lost = None
        last = max([r[1] for r in rows] + ([last] if last is not None else []), default=mark)
        if not later and last + self.idle_us <= mark:
            for state in (self.waiting, self.held, self.history, self.left_out):
                state.clear()
        else:
            track.forget(mark - hold)
            if later:
                self.waiting.put([tuple(map(list, zip(*later)))])
            elif rows:
                self.waiting.clear()
            self.history.update(tuple(map(list, zip(*track.history))) or ([],) * len(SAMPLE.split(", ")))
            self.held.update((*(track.held() if track.d is not None else [None] * n), lost, last))
            self.wake(min([*(r[1] + hold for r in later), *([lost + hold] if lost is not None else []), last + self.idle_us]))
        if out:
            columns = dict(zip([f.split()[0] for f in OUT.split(", ")], map(list, zip(*out))))
            yield pd.DataFrame(columns | {"seq": pd.array(columns["seq"], "Int64")})

    def close(self) -> None:
        pass


def track(rows: DataFrame, optics: Optics, delay: str = "10 seconds", idle_us: int = 3_600_000_000) -> DataFrame:
    """The job over a stream of rows as above."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.select("session", *FIELDS, F.timestamp_micros("t_us").alias("event_t")).withWatermark("event_t", delay)
    return timed.groupBy("session").transformWithStateInPandas(Tracker(optics, idle_us), OUT, "append", "EventTime")
