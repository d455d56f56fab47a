"""Shared pieces: the shared folder, materialised tables, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a batch that goes to a Python worker, unless the session sets its own: rows may be long.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes in this session, where no limit is set."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine; elsewhere an error,
    since executors would write to disks of their own."""
    bound_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: '0' for null, else '1' and the source."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand, for hashes of substrings from prefix sums."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


POWERS = Powers()
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_HASH = BYTE_HASH[FOLD]


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """Prefix sums c with c[e] - c[s] = base^s * hash(data[s:e])."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def sub_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[s:e] from prefix sums; the length is hashed too."""
    _, down = POWERS.get(len(c))
    return mix64((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_chunks(column: pa.Array, limit: int = 1 << 19):
    """(first row, row offsets into data, data) over runs of rows of about ``limit`` bytes; one longer text is a chunk of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, (offsets[i : j + 1] - offsets[i]).astype(np.int64), data[offsets[i] : offsets[j]]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (no word crosses a row), and each row's first word: words of row r are first[r]:first[r+1]."""
    ok = ~(IS_SPACE if space is None else space)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | edge[1:-1]
    end = ok.copy()
    end[:-1] &= ~ok[1:] | edge[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lower-cased, and each row's first word."""
    s, e, first = words_of(data, offsets, space)
    return sub_hash(prefix_hash(data, FOLDED_HASH), s, e), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes (rows not regarded)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix64(h ^ np.uint64(k))
