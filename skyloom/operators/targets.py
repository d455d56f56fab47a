"""Targets: filters, joins, unions and ranking of catalogues and position reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

EARTH_R = 6371000.0


def within_bbox(df: DataFrame, lat_deg: float, lon_deg: float, km: float = 20.0, lat: str = "lat_deg", lon: str = "lon_deg") -> DataFrame:
    """Positions within a box of +-km about a site. Longitude wraps at the date line."""
    dlat = km * 1000 * 360 / (2 * math.pi * EARTH_R)
    dlon = dlat / math.cos(math.radians(lat_deg))
    off = F.pmod(F.col(lon) - lon_deg + 180, F.lit(360.0)) - 180
    return df.filter(F.col(lat).between(lat_deg - dlat, lat_deg + dlat) & (F.abs(off) <= dlon))


def visible_targets(dirs: DataFrame, keys: list[str], z: str = "z", low_deg: float = -20.0, high_deg: float = 89.0) -> DataFrame:
    """All rows of the targets that are not always too low and not always too high."""
    seen = dirs.groupBy(*keys).agg(F.max(z).alias("top"), F.min(z).alias("bottom"))
    good = seen.filter((F.col("top") >= math.sin(math.radians(low_deg))) & (F.col("bottom") <= math.sin(math.radians(high_deg))))
    return dirs.join(good.select(*keys), keys, "left_semi")


def search_targets(df: DataFrame, text: str, name: str = "name", url: str = "url") -> DataFrame:
    """Rows whose name or url holds the text in any case, best score first."""
    t = F.lit(text.lower())
    return df.filter(F.lower(name).contains(t) | F.lower(url).contains(t)).orderBy(F.desc("score"))


def alignment_candidates(df: DataFrame, source_flag: str = "source_for_alignment", target_flag: str = "use_for_alignment") -> DataFrame:
    return df.filter(F.col(source_flag) & F.col(target_flag))


def aircraft_altitude(baro: Column, geometric: Column) -> Column:
    return F.coalesce(baro, geometric, F.lit(0.0))


def fix_age(now_us, known_us) -> Column:
    """Seconds since the last fix; null if there is none."""
    return (geo.c(now_us) - geo.c(known_us)) / 1e6


def enabled_observations(obs: DataFrame) -> DataFrame:
    return obs.filter("enabled")


def name_stars(stars: DataFrame, names: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``display`` = "name (HIP n)", or "HIP n" without a name. Names are broadcast only if there are at most most_rows."""
    small = names.limit(most_rows + 1).count() <= most_rows
    j = stars.join(F.broadcast(names) if small else names, "hip", "left")
    hip = F.concat(F.lit("HIP "), F.col("hip").cast("string"))
    return j.withColumn("display", F.when(F.col("proper").isNull(), hip).otherwise(F.concat("proper", F.lit(" ("), hip, F.lit(")"))))


def dedupe_planets(df: DataFrame, name: str = "name") -> DataFrame:
    """Without barycentres whose planet is there, id 0 and the Earth."""
    planets = df.select(F.concat(F.upper(name), F.lit("_BARYCENTER")).alias("bary"))
    return df.join(planets, F.upper(df[name]) == planets["bary"], "left_anti").filter((F.col("id") != 0) & ~F.upper(name).contains("EARTH"))


def all_targets(*sources: DataFrame) -> DataFrame:
    """Union by column name; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key; maxima of structs combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys + order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in order + rest])


def union_tles(*groups: DataFrame) -> DataFrame:
    """Satellite groups under one url each; within a group the last one of a name wins."""
    every = all_targets(*groups)
    return latest_by_key(every, ["group", "name"], ["seq"]).withColumn("url", F.concat_ws("/", F.lit("sky://satellites"), "group", "name"))


def rank_targets(df: DataFrame, n: int, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), "url").limit(n)


def sources_in_view(dirs: DataFrame, frames: DataFrame, half_diagonal: float, margin: float = math.radians(3), source: str = "source") -> DataFrame:
    """Sources x frames with dir . boresight > cos(half diagonal + margin). Both sides are dealt to cells of a cube grid as wide as the cone; a frame visits its cell's neighbours, then the exact test decides."""
    reach = half_diagonal + margin
    width = max(2 * math.sin(min(reach, math.pi) / 2), 1e-6)
    cell = lambda p: [F.floor(F.col(f"{p}{a}") / width).cast("int").alias(f"cell_{a}") for a in "xyz"]
    s = dirs.select("*", *cell(""))
    f = frames.select("*", *cell("b"))
    for a in "xyz":
        f = f.withColumn(f"cell_{a}", F.explode(F.array(*[F.col(f"cell_{a}") + i for i in (-1, 0, 1)])))
    cos = geo.dot(geo.v3(), geo.v3("b"))
    return s.join(f, ["cell_x", "cell_y", "cell_z"]).withColumn("cos", cos).filter(F.col("cos") > math.cos(reach)).drop("cell_x", "cell_y", "cell_z")
