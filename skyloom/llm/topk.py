"""Exact top-k inner-product search by distributed histogram selection.

Queries go through in chunks of QUERY_CHUNK vectors, each sent to the tasks that read the candidates; candidates are never moved. Each
pass scores everything and narrows, for every query, the interval of scores that holds its k-th best value: a task adds up its
histogram and reports the highest bins only, as far down as its own k-th score, since the global one is never lower.
When intervals are one score wide, a last pass keeps the scores from the k-th value up; of those that tie with it each task
keeps its k smallest ids, and a rank by (score descending, id) decides. What is shuffled is a few rows a query and task.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do those without an id; only vectors of
equal dimension are compared; components saturate where scores of their dimension would leave 64 bits (beyond sqrt(2^61 / dimension)); every row
of a repeated query id is a query of its own, so its ranks appear once for each; candidates with a query's own id are left out; a candidate id that
is repeated counts as often; ids are cast to long; fewer than k candidates are all returned; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Queries that are sent at once, and candidates that a task scores at once.
QUERY_CHUNK, CANDIDATES, BINS = 4096, 512, 256


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (integers floor(scale * x)), dim, of the vectors that take part."""
    finite = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.size(vector_col))).cast("double")
    v = F.transform(vector_col, lambda x: F.floor(F.least(most, F.greatest(-most, x.cast("double") * F.lit(float(scale))))))
    rows = vectors.filter(finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vector_col).alias("dim"))
    return rows.filter("vec_id is not null and dim > 0")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating-point multiplication where every sum fits its 53 bits."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Chunk:
    """Some queries of one dimension and the interval of scores that is known to hold each one's k-th best."""

    def __init__(self, rows, dim: int, k: int, most: int) -> None:
        self.dim, self.ids = dim, np.array([r["vec_id"] for r in rows], np.int64)
        self.v = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)
        self.width = max(1, math.ceil((2 * most + 1) / BINS))
        self.lo, self.need = np.full(len(rows), -most, np.int64), np.full(len(rows), k, np.int64)
        self.span = np.full(len(rows), float(BINS) * self.width)
        self.bin_width = np.full(len(rows), self.width, np.int64)

    def met(self, batches):
        """(scores of all queries, ids of some candidates) again and again."""
        for batch in batches:
            mine = batch.filter(pa.array(batch.column(2).to_numpy() == self.dim))
            ids, v = mine.column(0).to_numpy(), mine.column(1).flatten().to_numpy().reshape(-1, self.dim)
            for i in range(0, len(ids), CANDIDATES):
                yield scores(self.v, v[i : i + CANDIDATES]), ids[i : i + CANDIDATES]

    def narrow(self, found: dict[int, tuple[int, int]]) -> None:
        """Go on within the bins that hold the k-th best; a query with fewer candidates than k keeps its interval."""
        narrower = max(1, math.ceil(self.width / BINS))
        for q, (at, left) in found.items():
            self.lo[q] += at * self.bin_width[q]
            self.need[q], self.span[q], self.bin_width[q] = left, float(self.width), narrower
        self.width = narrower


def histograms(chunk: Chunk):
    def run(batches):
        n = len(chunk.ids)
        counts = np.zeros(n * BINS, np.int64)
        for s, c in chunk.met(batches):
            above = s.astype(np.float64) - chunk.lo[:, None]
            inside = (chunk.ids[:, None] != c[None, :]) & (s >= chunk.lo[:, None]) & (above < chunk.span[:, None])
            q, j = np.nonzero(inside)
            counts += np.bincount(q * BINS + (s[q, j] - chunk.lo[q]) // chunk.bin_width[q], minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        higher = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (higher < chunk.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int64()), pa.array(counts[q, b]), pa.array(chunk.need[q])], names=["q", "bin", "n", "need"])

    return run


def winners(chunk: Chunk, k: int):
    """Of every task: the scores above each query's k-th best, and of those equal to it the k smallest ids."""

    def run(batches):
        ties: dict[int, list[int]] = {}
        for s, c in chunk.met(batches):
            other = chunk.ids[:, None] != c[None, :]
            q, j = np.nonzero(other & (s > chunk.lo[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(chunk.ids[q]), pa.array(c[j]), pa.array(s[q, j])], names=["q", "query_id", "vec_id", "score"])
            for q, j in zip(*np.nonzero(other & (s == chunk.lo[:, None]))):
                held = ties.setdefault(int(q), [])
                held.append(int(c[j]))
                if len(held) >= 4 * k:
                    ties[int(q)] = sorted(held)[:k]
        q = np.array([x for x, held in ties.items() for _ in sorted(held)[:k]], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(chunk.ids[q]), pa.array([x for held in ties.values() for x in sorted(held)[:k]], pa.int64()), pa.array(chunk.lo[q])], names=["q", "query_id", "vec_id", "score"])

    return run


def best_of(rows: DataFrame, chunk: Chunk, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of one chunk of queries. The driver gets one small row a query and pass."""
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    while True:
        counts = rows.mapInArrow(histograms(chunk), "q long, bin long, n long, need long").groupBy("q", "bin", "need").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        found = counts.filter("upto >= need and upto - n < need").collect()
        last = chunk.width == 1
        chunk.narrow({r["q"]: (r["bin"], r["need"] - r["upto"] + r["n"]) for r in found})
        if last:
            break
    best = rows.mapInArrow(winners(chunk, k), "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every vector whose id is divisible by ``every``."""
    rows = materialize(quantized(vectors, scale, id_col, vector_col), "topk-vectors")
    queries = materialize(rows.filter(F.col("vec_id") % every == 0).withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    parts = []
    for dim, n in queries.groupBy("dim").count().orderBy("dim").collect():
        most = min(2**61, int((rows.filter(F.col("dim") == dim).agg(F.max(squares)).first()[0] or 0) * (1 + 1e-9)) + 1)
        chunks = math.ceil(n / QUERY_CHUNK)
        for chunk in range(chunks):
            held = queries.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk)).select("vec_id", "v").collect()
            if held:
                parts.append(best_of(rows, Chunk(held, dim, k, most), k))
                parts[-1] = materialize(parts[-1], "topk-best") if chunks > 1 else parts[-1]
    return functools.reduce(DataFrame.union, parts) if parts else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def oracle(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
