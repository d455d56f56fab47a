"""Segments, sessions, settings and cameras of a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def committed(segments: DataFrame, lines: str = "n_lines", on_disk: str = "n_disk") -> DataFrame:
    """Frames of a segment that both the sidecar and the pixel file hold."""
    return segments.withColumn("committed", F.least(lines, on_disk))


def segment_binning(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The first binning that a segment's records carry, else 1."""
    return frames.groupBy(*keys).agg(F.coalesce(F.min_by("bin", F.when(F.col("bin").isNotNull(), F.col("idx"))), F.lit(1)).alias("binning"))


def retention(segments: DataFrame) -> DataFrame:
    """Sessions with an important segment are kept; the others may be removed."""
    return segments.groupBy("session").agg(F.count("*").alias("n_segments"), F.count_if("important").alias("n_important")).withColumn("keep", F.col("n_important") > 0)


def keep_segments(segments: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    return segments.join(frames.filter("important").select(*keys).distinct(), keys, "left_semi")


def purge_segments(segments: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    return segments.join(frames.filter("important").select(*keys).distinct(), keys, "left_anti")


def segment_rank(segments: DataFrame) -> DataFrame:
    """Age of each segment within its session and role (1 newest); purge = neither important nor among the newest two."""
    age = F.row_number().over(Window.partitionBy("session", "role").orderBy(F.desc("t_us"), F.desc("segment")))
    return segments.withColumn("age", age).withColumn("purge", ~F.col("important") & (F.col("age") > 2))


def telemetry_mode(tracking: Column, coasting: Column, lost: Column, estop: Column, rate: Column) -> Column:
    return F.when(tracking, F.when(coasting, "coast").otherwise("track")).when(lost, "lost").when(estop, "estop").when(F.abs(rate) > 1e-9, "slew").otherwise("idle")


def capture_health(frames: DataFrame, seconds: int = 1, peak: str = "alt", key: str = "kind") -> DataFrame:
    """Frames, rate and peak of each role in tumbling windows; the same for streams."""
    w = F.window(F.timestamp_micros("t_us"), f"{seconds} seconds")
    return frames.groupBy(key, w.alias("w")).agg(F.count("*").alias("frames"), F.max(peak).alias("peak")).select(key, F.unix_micros("w.start").alias("start_us"), "frames", (F.col("frames") / seconds).alias("fps"), "peak")


def configurations(sensors: DataFrame, optics: DataFrame, reducers: DataFrame, keys: list[str] = [], most_rows: int = 100_000) -> DataFrame:
    """Every sensor with every optic of its keys (such as a rig) and every reducer. Without keys the product of all is asked for; small sides are broadcast, and their size is checked."""
    if reducers.limit(most_rows + 1).count() > most_rows or (not keys and optics.limit(most_rows + 1).count() > most_rows):
        raise ValueError(f"optics without keys and reducers are limited to {most_rows} rows")
    focal = F.col("focal_mm") * F.col("multiplier")
    out = (sensors.join(optics, keys) if keys else sensors.crossJoin(F.broadcast(optics))).crossJoin(F.broadcast(reducers))
    return out.withColumns({"focal": focal, "fov_x": geo.fov_deg("res_x", "pixel_um", focal), "fov_y": geo.fov_deg("res_y", "pixel_um", focal), "plate_scale": geo.arcsec_per_px("pixel_um", focal)})


def nested_fov(cameras: DataFrame) -> DataFrame:
    """Pairs of roles of a session whose second field of view lies within the first one, with the rectangle's half sides in pixels of the first."""
    a, b = cameras.alias("a"), cameras.alias("b")
    inside = (F.col("a.session") == F.col("b.session")) & (F.col("b.fov_x") < F.col("a.fov_x")) & (F.col("b.fov_y") < F.col("a.fov_y"))
    half = lambda f, n: F.tan(F.radians(F.col(f"b.{f}")) / 2) / F.tan(F.radians(F.col(f"a.{f}")) / 2) * F.col(f"a.{n}") / 2
    return a.join(b, inside).select("a.session", F.col("a.role").alias("outer_role"), F.col("b.role").alias("inner_role"), half("fov_x", "width").alias("half_x"), half("fov_y", "height").alias("half_y"))


def detection_lag(frames: DataFrame, detections: DataFrame, keys: list[str], index: str = "idx") -> DataFrame:
    """Committed frames that have no detections yet."""
    f = frames.groupBy(*keys).agg(F.max(index).alias("last_frame"))
    d = detections.groupBy(*keys).agg(F.max(index).alias("last_detected"))
    return f.join(d, keys, "left").withColumn("lag", F.col("last_frame") - F.coalesce("last_detected", F.lit(-1)))
