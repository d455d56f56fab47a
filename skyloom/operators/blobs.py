"""Blobs: from pixel tables to ranked detections, and matching detections to predictions. Pixel tables are for small frames and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["role", "idx"]


def cut_blobs(blobs: DataFrame, min_px: int = 0, max_size_px: float | None = None, min_roundness: float | None = None, n_above: str = "n_above") -> DataFrame:
    out = blobs.filter(F.col(n_above) >= min_px)
    out = out if max_size_px is None else out.filter(F.col("size_px") <= max_size_px)
    return out if min_roundness is None else out.filter(F.col("roundness") >= min_roundness)


def robust_sigma(pixels: DataFrame, snr: float = 5.0, rel: float = 0.3, frame: list[str] = FRAME) -> DataFrame:
    """Lower median, 1.4826 * lower median of absolute deviations + 1e-6, and threshold = max(snr * sigma, rel * maximum)."""
    lower = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    mid = pixels.groupBy(*frame).agg(lower("v").alias("med"), F.max("v").alias("most"))
    dev = pixels.join(mid, frame).withColumn("dev", F.abs(F.col("v") - F.col("med"))).groupBy(*frame).agg(F.first("med").alias("med"), F.first("most").alias("most"), lower("dev").alias("mad"))
    return dev.withColumn("sigma", 1.4826 * F.col("mad") + 1e-6).withColumn("threshold", F.greatest(snr * F.col("sigma"), rel * F.col("most"))).select(*frame, "med", "sigma", "threshold")


def tile_peaks(pixels: DataFrame, r: int, threshold: float = 0.0, frame: list[str] = FRAME) -> DataFrame:
    """The largest pixel of each (2r+1)-sided tile that reaches the threshold; ties go to the lowest (y, x); frames without light have none."""
    n = 2 * r + 1
    best = pixels.groupBy(*frame, F.floor(F.col("y") / n).alias("ty"), F.floor(F.col("x") / n).alias("tx")).agg(F.max(F.struct("v", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"))
    return best.select(*frame, "ty", "tx", (-F.col("b.ny")).alias("y"), (-F.col("b.nx")).alias("x"), F.col("b.v").alias("v")).filter((F.col("v") >= threshold) & (F.col("v") > 0))


def blob_moments(pixels: DataFrame, peaks: DataFrame, r: int, psf: float = 3.0, frame: list[str] = FRAME) -> DataFrame:
    """Moments of the light above half the peak within r pixels of it."""
    p = peaks.select(*frame, F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("peak"))
    near = pixels.join(p, frame).filter((F.abs(F.col("y") - F.col("py")) <= r) & (F.abs(F.col("x") - F.col("px")) <= r))
    w = F.greatest(F.col("v") - F.col("peak") / 2, F.lit(0.0))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    s = near.groupBy(*frame, "py", "px", "peak").agg(F.count_if(F.col("v") >= F.col("peak") / 2).alias("n_above"), *[F.sum(w * e).alias(n) for n, e in (("s0", F.lit(1.0)), ("sx", dx), ("sy", dy), ("sxx", dx * dx), ("syy", dy * dy), ("sxy", dx * dy))])
    mx, my = F.col("sx") / F.col("s0"), F.col("sy") / F.col("s0")
    s = s.withColumns({"mx": mx, "my": my}).withColumns({"cxx": F.col("sxx") / F.col("s0") - F.col("mx") * F.col("mx"), "cyy": F.col("syy") / F.col("s0") - F.col("my") * F.col("my"), "cxy": F.col("sxy") / F.col("s0") - F.col("mx") * F.col("my")})
    half, root = (F.col("cxx") + F.col("cyy")) / 2, F.sqrt(F.pow((F.col("cxx") - F.col("cyy")) / 2, F.lit(2.0)) + F.pow("cxy", F.lit(2.0)))
    s = s.withColumns({"l1": half + root, "l2": half - root, "size_px": 2 * F.sqrt(F.col("n_above") / F.lit(3.141592653589793))})
    roundness = F.when(F.col("l1") <= 1e-6, F.lit(1.0)).otherwise(F.col("l2") / F.col("l1"))
    return s.select(*frame, "py", "px", "peak", "n_above", (F.col("px") + F.col("mx")).alias("cx"), (F.col("py") + F.col("my")).alias("cy"), "size_px", roundness.alias("roundness"), F.least(F.lit(1.0), psf / F.greatest("size_px", F.lit(psf))).alias("pointlike"))


def cap_density(blobs: DataFrame, width: int, height: int, grid: int = 8, per_tile: int = 2, most: int = 16, frame: list[str] = ["frame"], ties: list[str] = ["px", "py"]) -> DataFrame:
    """The strongest per_tile blobs of each tile, then the strongest of the frame; id is the rank from 0."""
    tile = [F.floor(F.col("px") / -(-width // grid)), F.floor(F.col("py") / -(-height // grid))]
    order = [F.desc("peak"), *ties]
    ranked = blobs.withColumn("in_tile", F.row_number().over(Window.partitionBy(*frame, *tile).orderBy(*order))).filter(F.col("in_tile") <= per_tile)
    return ranked.withColumn("id", F.row_number().over(Window.partitionBy(*frame).orderBy(*order)) - 1).filter(F.col("id") < most).drop("in_tile")


def flag_moving(peaks: DataFrame, pixels: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Whether a peak exceeds the same pixel of the frame before by more than a fraction of itself; null on the first frame."""
    before = pixels.select("role", (F.col("idx") + 1).alias("idx"), "y", "x", F.col("v").alias("v_before"))
    return peaks.join(before, ["role", "idx", "y", "x"], "left").withColumn("moving", (F.col("v") - F.col("v_before")) > fraction * F.col("v"))


def frame_diff(pixels: DataFrame, gain: float = 1.0) -> DataFrame:
    """|frame - frame before| * gain, clamped to 16 bits; one frame fewer."""
    w = Window.partitionBy("role", "y", "x").orderBy("idx")
    rows = pixels.withColumn("before", F.lag("v").over(w)).filter(F.col("before").isNotNull())
    d = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.abs(F.col("v") - F.col("before")) * gain)))
    return rows.withColumn("d", d.cast("long")).select("role", "idx", "y", "x", "d")


def center_of_mass(pixels: DataFrame, n: int, frame: list[str] = FRAME) -> DataFrame:
    """Centre of light about the crop's centre; the axis runs evenly from -n/2 to n/2."""
    at = lambda c: F.col(c) * (n / (n - 1)) - n / 2
    s = pixels.groupBy(*frame).agg(F.sum("v").alias("total"), F.sum(F.col("v") * at("x")).alias("sx"), F.sum(F.col("v") * at("y")).alias("sy"))
    total = F.when(F.col("total") == 0, 1).otherwise(F.col("total"))
    return s.select(*frame, (F.col("sx") / total).alias("com_x"), (F.col("sy") / total).alias("com_y"))


def frame_histogram(pixels: DataFrame, full: float = 65535.0, bins: int = 64, every: int = 4, frame: list[str] = FRAME) -> DataFrame:
    """Square root of each bin's share of the fullest bin, over every ``every``-th pixel."""
    some = pixels.filter((F.col("y") * 8 + F.col("x")) % every == 0)
    counts = some.groupBy(*frame, F.least(F.lit(bins - 1), F.floor(F.col("v") / full * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("level", F.sqrt(F.col("n") / F.max("n").over(Window.partitionBy(*frame)))).drop("n")


def bayer_planes(pixels: DataFrame) -> DataFrame:
    """Half-resolution planes ul, ur, ll, lr of a mosaic."""
    plane = F.element_at(F.array(*map(F.lit, ("ul", "ur", "ll", "lr"))), (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int"))
    return pixels.select("role", "idx", plane.alias("plane"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")


#: The colours of the four mosaic places, row by row.
LAYOUTS = {"RGGB": "RGGB", "GRBG": "GRBG", "GBRG": "GBRG", "BGGR": "BGGR"}


def debayer_rgb(pixels: DataFrame, layout: str = "RGGB") -> DataFrame:
    """Red, mean green and blue of each 2x2 mosaic cell."""
    place = {p: colour for p, colour in zip(("ul", "ur", "ll", "lr"), LAYOUTS[layout])}
    mean = lambda colour: F.avg(F.when(F.col("plane").isin([p for p, c in place.items() if c == colour]), F.col("v")))
    return bayer_planes(pixels).groupBy("role", "idx", "y", "x").agg(*[mean(c).alias(n) for c, n in (("R", "r"), ("G", "g"), ("B", "b"))])


def mono_sum(pixels: DataFrame) -> DataFrame:
    return bayer_planes(pixels).groupBy("role", "idx", "y", "x").agg(F.sum("v").alias("v"))


def associate(blobs: DataFrame, predicted: DataFrame, gate_px: float = 80.0, keys: list[str] = ["frame"], ids: list[str] = ["blob"]) -> DataFrame:
    """The blob nearest to the prediction in each frame (ties to the lowest id), if it lies inside the gate."""
    d = F.hypot(F.col("px") - F.col("pred_x"), F.col("py") - F.col("pred_y"))
    near = blobs.join(predicted, keys).groupBy(*keys).agg(F.min(F.struct(d.alias("distance"), *ids)).alias("b"))
    return near.select(*keys, *[F.col(f"b.{i}").alias(i) for i in ids], F.col("b.distance").alias("distance")).filter(F.col("distance") <= gate_px)


def pick(points: DataFrame, blobs: DataFrame, reach_px: float = 40.0, keys: list[str] = ["frame"]) -> DataFrame:
    """The blob nearest to each point within reach, else the point."""
    return nearest_of(points.join(blobs, keys, "left"), points.columns, reach_px)


def nearest_of(pairs: DataFrame, point: list[str], reach_px: float = 40.0) -> DataFrame:
    """The same over rows that hold a point (its columns ``point``, with at_x and at_y) beside a blob: where each frame's blobs bear its point, no join is needed."""
    d = F.hypot(F.col("px") - F.col("at_x"), F.col("py") - F.col("at_y"))
    near = pairs.withColumn("d", d).groupBy(*point).agg(F.min(F.when(F.col("d") <= reach_px, F.struct("d", "px", "py"))).alias("b"))
    return near.select(*point, F.coalesce("b.px", "at_x").alias("x"), F.coalesce("b.py", "at_y").alias("y"))


#: Frames of so many blobs are compared whole, larger ones by cells.
WHOLE = 1000


def match_world(blobs: DataFrame, projected: DataFrame, radius: float, keys: list[str] = ["frame"]) -> DataFrame:
    """Mutual nearest pairs of blobs and projected sources of a frame within a radius. Blobs of a frame meet its sources; where a frame has more than WHOLE blobs, they meet
    those of their pixel cell of that size and its neighbours. Rows that are dealt by ``keys`` stay where they are for all but such frames."""
    frame = Window.partitionBy(*keys)
    held = blobs.withColumn("held", F.count("*").over(frame))
    many = held.filter(F.col("held") > WHOLE).drop("held")
    cell = lambda df, x, y: df.withColumns({"cell_x": F.floor(F.col(x) / radius), "cell_y": F.floor(F.col(y) / radius)})
    around = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)]))
    b = cell(many, "px", "py").withColumn("cell_x", around("cell_x")).withColumn("cell_y", around("cell_y"))
    by_cell = b.join(cell(projected.join(many.select(*keys).distinct(), keys, "left_semi"), "sx", "sy"), [*keys, "cell_x", "cell_y"]).drop("cell_x", "cell_y")
    pairs = held.filter(F.col("held") <= WHOLE).drop("held").join(projected, keys).unionByName(by_cell)
    dx, dy = F.col("px") - F.col("sx"), F.col("py") - F.col("sy")
    near = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy)).filter(F.col("distance") <= radius)
    rank = lambda one, other: F.row_number().over(Window.partitionBy(*keys, one).orderBy("distance", other))
    return near.withColumns({"by_blob": rank("blob", "source"), "by_source": rank("source", "blob")}).filter("by_blob = 1 and by_source = 1").select(*keys, "blob", "source", "distance")
