"""The SER capture format as a data source: one row a frame, tasks take ranges of frames, positioned reads.

Header of 178 bytes, frames, then optionally one 64-bit tick count (100 ns since 0001-01-01) a frame. A frame count of
0x7FFFFFFF or less than one means that recording goes on: then complete frames on disk count.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = struct.Struct("<14s7i40s40s40s2q")
OPEN, FILE_ID = 0x7FFFFFFF, b"LUCAM-RECORDER"
FRAMES_A_PARTITION = 64
EPOCH_US = 62135596800000000
SCHEMA = "file string, index long, width int, height int, channels int, depth int, color_id int, t_us long, pixels binary"


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path


def read_header(path: str) -> dict:
    with open(path, "rb") as f:
        _, _, color, big, width, height, depth, count, *_rest = HEADER.unpack(f.read(HEADER.size))
    channels, size = (3 if color >= 100 else 1), (1 if depth <= 8 else 2)
    frame = width * height * channels * size
    on_disk = (os.path.getsize(path) - HEADER.size) // frame
    frames = on_disk if count == OPEN or count <= 0 else min(count, on_disk)
    trailer = count not in (OPEN, 0) and os.path.getsize(path) >= HEADER.size + frames * (frame + 8)
    return {"file": path, "color_id": color, "little_endian": big == 0, "width": width, "height": height, "depth": depth, "channels": channels, "bytes_per_frame": frame, "frames": frames, "recording": count == OPEN, "trailer": trailer}


def files_of(path: str) -> list[str]:
    path = local(path)
    return sorted(glob.glob(f"{path}/**/*.ser", recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))


class Range(InputPartition):
    def __init__(self, header: dict, first: int, end: int) -> None:
        self.header, self.first, self.end = header, first, end


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self):
        headers = [read_header(f) for f in files_of(self.path)]
        return [Range(h, i, min(h["frames"], i + FRAMES_A_PARTITION)) for h in headers for i in range(0, h["frames"], FRAMES_A_PARTITION)] or [Range({}, 0, 0)]

    def read(self, part: Range):
        yield from frames_of(part.header, part.first, part.end)


def frames_of(h: dict, first: int, end: int):
    """Rows of SCHEMA for some frames of a file, by positioned reads."""
    n = end - first
    if n <= 0:
        return
    with open(h["file"], "rb") as f:
        ticks = [None] * n
        if h["trailer"]:
            f.seek(HEADER.size + h["frames"] * h["bytes_per_frame"] + 8 * first)
            ticks = struct.unpack(f"<{n}q", f.read(8 * n))
        f.seek(HEADER.size + first * h["bytes_per_frame"])
        for i, t in enumerate(ticks):
            body = f.read(h["bytes_per_frame"])
            if h["depth"] > 8 and not h["little_endian"]:
                swapped = bytearray(body)
                swapped[0::2], swapped[1::2] = body[1::2], body[0::2]
                body = bytes(swapped)
            yield (h["file"], first + i, h["width"], h["height"], h["channels"], h["depth"], h["color_id"], None if t is None else t // 10 - EPOCH_US, body)


class Done(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class Writer(DataSourceWriter):
    """Rows of one file must meet in one task, in order: ``write_ser`` sees to that. The path is on a file system mounted everywhere. Each attempt writes
    hidden files of its own; only those of the attempts that Spark commits get their names, at the end of the job."""

    def __init__(self, options) -> None:
        self.path = local(options["path"])

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        out, name, ticks, first, done = None, None, [], None, []

        def close():
            if out:
                out.write(struct.pack(f"<{len(ticks)}q", *ticks) if all(t is not None for t in ticks) else b"")
                out.seek(0)
                out.write(header(first, len(ticks)))
                out.close()
                done.append((out.name, f"{self.path}/{name}.ser"))

        for r in rows:
            if r["file"] != name:
                close()
                name, ticks, first = r["file"], [], r
                out = open(f"{self.path}/.{name}.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
                out.write(header(r, OPEN))
            out.write(r["pixels"])
            ticks.append(None if r["t_us"] is None else (r["t_us"] + EPOCH_US) * 10)
        close()
        return Done(done)

    def commit(self, messages):
        for made, final in (f for m in messages if m for f in m.files):
            os.replace(made, final)

    def abort(self, messages):
        for made, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(made):
                os.remove(made)


def header(r, count: int) -> bytes:
    return HEADER.pack(FILE_ID, 0, r["color_id"], 0, r["width"], r["height"], r["depth"], count, b"", b"", b"", 0, 0)


class Ser(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ser"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The SER files below a folder, or a file or pattern, one row a file, by Spark's own listing (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", "*.ser") if os.path.isdir(local(path)) else files
    return files.load(path).select(F.regexp_replace("path", "^file:(//)?", "").alias("file"))


def tasks(spark: SparkSession) -> int:
    """Names and ranges are few bytes that stand for many: a number of tasks that is named is kept, where Spark would else join them into one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HEADERS = "file string, color_id int, little_endian boolean, width int, height int, depth int, channels int, bytes_per_frame long, frames long, recording boolean, trailer boolean"


def ser_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: the header's fields and its frames. Headers are read by tasks."""

    def read(parts):
        for p in parts:
            yield pd.DataFrame([read_header(f) for f in p["file"]], columns=[c.split()[0] for c in HEADERS.split(", ")])

    return listed(spark, path).repartition(tasks(spark), "file").mapInPandas(read, HEADERS)


def read_ser(spark: SparkSession, path: str, halo: bool = False) -> DataFrame:
    """One row a frame; a range of FRAMES_A_PARTITION frames is the unit that is dealt to tasks. With ``halo``, each range but a file's first begins with the frame
    before it, marked in the column ``halo``: tasks that compare neighbours then need no others."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(FRAMES_A_PARTITION).cast("long")))
    ranges = ser_segments(spark, path).filter("frames > 0").withColumn("first", first).repartition(tasks(spark), "file", "first").sortWithinPartitions("file", "first")
    schema = SCHEMA + (", halo boolean" if halo else "")
    kinds = pa.schema([("file", pa.string()), ("index", pa.int64()), *[(n, pa.int32()) for n in ("width", "height", "channels", "depth", "color_id")], ("t_us", pa.int64()), ("pixels", pa.binary()), *([("halo", pa.bool_())] if halo else [])])

    def read(batches):
        for batch in batches:
            for h in batch.to_pylist():
                begin = max(0, h["first"] - 1) if halo else h["first"]
                for row in frames_of(h, begin, min(h["frames"], h["first"] + FRAMES_A_PARTITION)):
                    row += (row[1] < h["first"],) if halo else ()
                    yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(row, kinds)], schema=kinds)

    return ranges.mapInArrow(read, schema)


def write_ser(frames: DataFrame, path: str) -> None:
    """Frames (columns of SCHEMA; ``file`` is the name without ending) to one SER file a name."""
    frames.sparkSession.dataSource.register(Ser)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    frames.select(*names).repartition("file").sortWithinPartitions("file", "index").write.format("ser").mode("append").save(path)
