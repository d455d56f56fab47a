"""Line-delimited JSON sidecars, alignment files and the optics database. Schemas are declared; unknown fields are ignored, absent ones null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "frames": "t_mono_ns long, t_utc string, important boolean, bin array<int>, roi array<int>",
    "detections": "index long, t_mono_ns long, blobs array<struct<id: int, px: array<double>, score: double, size_px: double, pointlike: double, roundness: double, moving: boolean>>",
    "state": "t_mono_ns long, recording boolean, sources map<string, string>, capturing map<string, boolean>, cameras map<string, struct<frames: long>>, optics map<string, struct<fov_x_deg: double, fov_y_deg: double>>, target_px array<double>, track_roi array<int>",
    "sim_mount": "t_mono_ns long, az_deg double, alt_deg double, rate_az_deg_s double, rate_alt_deg_s double",
    "control": "t_mono_ns long, important int, fps double, frame_limit int, file_limit int, stop boolean",
}
NAME = r"([0-9]{8}T[0-9]{6}(?:[0-9]{3})?Z)_([A-Za-z0-9]+)\.([a-z_]+)[^/]*$"


def read_sidecar(spark: SparkSession, path: str, kind: str, streaming: bool = False) -> DataFrame:
    """Rows of committed lines: a partial last line cannot be parsed and is dropped, blank lines are skipped. ``file`` is where a row comes from."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(f"{SCHEMAS[kind]}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken is null").drop("_broken").withColumn("file", F.col("_metadata.file_path"))


def session_columns(file: Column) -> dict[str, Column]:
    """session (folder), segment (time stamp, to seconds or milliseconds), role and kind from a file name <stamp>_<role>.<kind>..."""
    stamp = F.regexp_extract(file, NAME, 1)
    digits = F.regexp_replace(stamp, "[TZ]", "")
    text = F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d*)$", "$1-$2-$3 $4:$5:$6.$7")
    at = F.try_to_timestamp(F.when(F.length(digits) == 14, F.concat(text, F.lit("000"))).otherwise(text), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return {"session": F.regexp_extract(file, r"([^/]+)/[^/]+$", 1), "segment": stamp, "segment_t": at, "role": F.regexp_extract(file, NAME, 2), "kind": F.regexp_extract(file, NAME, 3)}


def with_session_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(session_columns(F.col("file")))


def index_frames(spark: SparkSession, path: str, kind: str = "frames", of: str | None = None) -> DataFrame:
    """Rows with ``index``, their place among the non-blank lines of the file (files are rolled, so a file fits a row). Where the lines of several sessions share a file, ``of``
    names the number in a line that tells them apart, and the place is that among the session's own lines."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    complete = F.regexp_extract("value", r"(?s)^(.*\n)", 1)  # up to the last line break
    lines = whole.select("file", F.posexplode(F.filter(F.split(complete, "\n"), lambda x: F.trim(x) != "")).alias("index", "line"))
    rows = lines.select("file", F.col("index").cast("long").alias("index"), F.from_json("line", SCHEMAS[kind] + (f", {of} long" if of else "")).alias("r")).select("file", "index", "r.*")
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy("file", of).orderBy("index")) - 1).cast("long")) if of else rows


def committed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line breaks of each file, blank lines too: what counts as committed."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return whole.select("file", (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


def write_detections(frames: DataFrame, blobs: DataFrame, path: str) -> None:
    """A line for every frame (file, index and perhaps t_us) with its blobs, strongest first, perhaps none; a folder ``recording=<name>`` for each file. Recordings are rolled, so
    a file's lines are one task's."""
    one = F.struct("id", F.array("px", "py").alias("px"), "score", "size_px", "pointlike", "roundness", "moving")
    lists = blobs.groupBy("file", "index").agg(F.array_sort(F.collect_list(one)).alias("blobs"))
    t = (F.col("t_us") * 1000 if "t_us" in frames.columns else F.lit(None)).cast("long")
    rows = frames.select("file", "index", t.alias("t_mono_ns")).join(lists, ["file", "index"], "left")
    rows = rows.select(F.regexp_extract("file", r"([^/]+?)(?:\.ser)?$", 1).alias("recording"), "index", "t_mono_ns", F.coalesce("blobs", F.array()).alias("blobs"))
    rows.repartition("recording").sortWithinPartitions("recording", "index").write.partitionBy("recording").json(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """recording, index and the columns of a blob, a row for each blob."""
    rows = read_sidecar(spark, path, "detections").select(F.regexp_extract("file", "recording=([^/]+)/", 1).alias("recording"), "index", F.explode("blobs").alias("b"))
    return rows.select("recording", "index", "b.id", F.col("b.px")[0].alias("px"), F.col("b.px")[1].alias("py"), *[f"b.{c}" for c in ("score", "size_px", "pointlike", "roundness", "moving")])


def alignment_time(text: Column) -> Column:
    """UTC time from text with 'T' or a space, an hour of one or two digits and any number of fraction digits."""
    p = r"^(\d{4}-\d{2}-\d{2})[T ](\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6})\d*)?"
    part = lambda i: F.regexp_extract(text, p, i)
    return F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.lpad(part(2), 2, "0"), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("."), F.rpad(part(5), 6, "0")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def read_alignments(spark: SparkSession, path: str, rolled: bool = False) -> DataFrame:
    """file, obs_idx, t, raw_axis_values of JSON arrays of observations, one a file; if ``rolled``, a set a line, and set_id too."""
    one = "array<struct<time: string, raw_axis_values: array<double>>>"
    if rolled:
        sets = spark.read.schema(f"set_id long, observations {one}").json(path).select(F.col("_metadata.file_path").alias("file"), "set_id", F.posexplode("observations").alias("obs_idx", "o"))
    else:
        whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
        sets = whole.select("file", F.posexplode(F.from_json("value", one)).alias("obs_idx", "o"))
    return sets.select("file", *(["set_id"] if rolled else []), "obs_idx", alignment_time(F.col("o.time")).alias("t"), F.col("o.raw_axis_values").alias("raw_axis_values"))


def write_alignments(obs: DataFrame, path: str, sets_a_file: int | None = None) -> None:
    """A JSON array for each set's enabled observations, in files by set_id; with ``sets_a_file``, that many set numbers share a file, a line each with its set_id."""
    o = F.struct(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "raw_axis_values")
    held = obs.filter("enabled").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("obs_idx", o.alias("o")))).alias("rows"))
    if sets_a_file:
        rows = held.select(F.floor(F.col("set_id") / sets_a_file).alias("roll"), F.to_json(F.struct("set_id", F.col("rows.o").alias("observations"))).alias("value"))
        rows.repartition("roll").write.partitionBy("roll").text(path)
    else:
        held.select("set_id", F.to_json("rows.o").alias("value")).write.partitionBy("set_id").text(path)


def read_optics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sensors (is_color true with a Bayer layout, false if mono, else null), optics and reducers of one document."""
    schema = "sensors array<struct<name: string, res_x: int, res_y: int, pixel_um: double, bayer: string, mono: boolean>>, optics array<struct<name: string, focal_length_mm: double, aperture_mm: double>>, reducers array<struct<name: string, multiplier: double>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    part = lambda c: doc.select(F.explode(c).alias("r")).select("r.*")
    sensors = part("sensors").withColumn("is_color", F.when(F.col("bayer").isNotNull(), True).when(F.col("mono"), False))
    return sensors, part("optics"), part("reducers")


def write_almanac(fixes: DataFrame, path: str) -> None:
    """One JSON record for each target and chunk: id, mag, fixes [[t, x, y, z], ...] in time order."""
    fix = F.array(*[F.col(c).cast("double") for c in ("t_ns", "x", "y", "z")])
    held = fixes.groupBy("id", "chunk").agg(F.last("mag").alias("mag"), F.array_sort(F.collect_list(fix)).alias("fixes"))
    held.select("id", "mag", "fixes").write.json(path)


def read_almanac(spark: SparkSession, path: str) -> DataFrame:
    """id, mag (12 where absent), t_ns, x, y, z."""
    rows = spark.read.schema("id string, mag double, fixes array<array<double>>").json(path)
    e = rows.select("id", F.coalesce("mag", F.lit(12.0)).alias("mag"), F.explode("fixes").alias("f"))
    return e.select("id", "mag", F.col("f")[0].cast("long").alias("t_ns"), *[F.col("f")[i + 1].alias(a) for i, a in enumerate("xyz")])
