"""Ranked lexical search with per-term geometric blocking: the k best documents of every item by integer scores, exactly.

Index. Documents become vectors over the items' terms (term, impact). They are dealt out by ranges of a similarity code (signs of random
projections of their weighted vectors), so a task holds neighbours; tasks cut their rows into groups of bounded size. In a group, each posting
list that some item needs is clustered: evenly spread members are pivots, members go to the pivot with the greatest cosine, and clusters
are cut into blocks. A block stores its members and its summary, the coordinatewise maximum of their impacts over all terms of the items that use
the list. The index is a Parquet table, a row a group.

Search. An item has a threshold: the k-th best exact score among the documents that hold one of its weightiest terms (terms enough for 100 k documents). It needs
only the lists of its essential terms: what the others can give together stays below the threshold. A block whose summary cannot reach the
threshold is skipped; the members of all other blocks are scored in full. Both bounds are exact (a block or list is left out only where it stays
strictly below), so results are those of scoring everything, ties included.

Scale: texts are read once for a chunk of items; shuffled are the vectors (once) and at most k rows an item and batch or group. Statistics (N, L, df)
cover all documents; what goes to the driver are one count a term of the items and one threshold an item, in chunks of MOST_ITEMS
items. Terms are compared by 64-bit hashes of their bytes.

Defined results: null or empty texts have no terms, are not counted in N and never found; every row is a document of its own, so
repeated rows are ranked one after the other; null ids come first among equal scores; every row of items is an item, whatever its id; items without terms
have no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, mix64, text_chunks, word_hashes
from .licenses import SEPARATOR

#: Items that are searched in one pass, documents of a group, members of a block, pivots of a list, cells of a clustering at once.
MOST_ITEMS, GROUP, BLOCK, PIVOTS, CELLS = 2048, 1024, 16, 64, 1 << 20
#: An item's threshold comes from the documents of its weightiest terms: as many terms as have this many times k documents. Bits of the similarity code.
SEEDS, BITS = 100, 16
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = "doc_ids array<long>, sizes array<int>, terms array<int>, impacts array<int>, block_terms array<int>, block_sizes array<int>, members array<int>, summary_sizes array<int>, summary_terms array<int>, summary_maxima array<int>"
OUT = "item_id long, rank int, doc_id long, score long"


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass
class Items:
    """A chunk of items: their ids, sorted hashes of all their terms, and each item's terms as places in these; then the terms' weights and greatest
    impacts, totals of the documents, and each item's threshold and essential terms."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0
    words: int = 0
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    essential: list[np.ndarray] = field(default_factory=list)

    def heaviest(self, documents: int) -> list[np.ndarray]:
        """Each item's weightiest terms, as many as have ``documents`` documents together."""
        order = [t[np.argsort(-self.weights[t], kind="stable")] for t in self.terms]
        return [np.sort(t[: np.searchsorted(np.cumsum(self.df[t]), documents) + 1]) for t in order]

    def dense(self, i: int) -> np.ndarray:
        """An item's weights over all terms."""
        out = np.zeros(len(self.hashes), np.int64)
        out[self.terms[i]] = self.weights[self.terms[i]]
        return out

    def impacts(self, n: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n.astype(np.int64) * self.documents) // max(self.words, 1)
        tf = tfs.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))


def items_of(rows: list) -> Items:
    texts = pa.array([r[1] for r in rows], pa.large_string())
    found = []
    for _, offsets, data in text_chunks(texts):
        words, first = word_hashes(data, offsets, SEPARATOR)
        found += [np.unique(words[a:b]) for a, b in zip(first, first[1:])]
    hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return Items([r[0] for r in rows], hashes, [np.searchsorted(hashes, f) for f in found])


def vectors(hashes: np.ndarray):
    """doc_id, number of terms, and the items' terms with their occurrences."""

    def run(batches):
        for batch in batches:
            for i, offsets, data in text_chunks(batch.column(1)):
                words, first = word_hashes(data, offsets, SEPARATOR)
                rows = len(offsets) - 1
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == words)
                row = np.searchsorted(first, hit, "right") - 1
                keys, tfs = np.unique(row * len(hashes) + at[hit], return_counts=True)
                sizes = np.bincount(keys // len(hashes), minlength=rows)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(v, pa.int32())) for v in (keys % len(hashes), tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), pa.array(np.diff(first).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def of_vectors(items: Items, batch: pa.RecordBatch):
    sizes, terms = unpacked(batch.column(2))
    return sizes, terms, items.impacts(batch.column(1).to_numpy(), unpacked(batch.column(3))[1], sizes)


def scores(weights: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Full scores of some documents; each has a term."""
    at = ranges(starts[docs], sizes[docs])
    return np.add.reduceat(weights[terms[at]] * impacts[at], begins(sizes[docs])) if len(at) else np.zeros(0, np.int64)


def seeds(items: Items, k: int):
    """(query, score): for each item, the k best of a batch's documents that hold one of its weightiest terms."""

    def run(batches):
        heavy = items.heaviest(SEEDS * k)
        for batch in batches:
            sizes, terms, impacts = of_vectors(items, batch)
            order = np.argsort(terms, kind="stable")
            doc, by_term, starts = np.repeat(np.arange(len(sizes)), sizes)[order], terms[order], begins(sizes)
            out_query, out_score = [], []
            for q, t in enumerate(heavy):
                lo = np.searchsorted(by_term, t)
                docs = np.unique(doc[ranges(lo, np.searchsorted(by_term, t, "right") - lo)]) if len(t) else np.zeros(0, np.int64)
                if len(docs):
                    best = np.sort(scores(items.dense(q), docs, starts, sizes, terms, impacts))[::-1][:k]
                    out_query.append(np.full(len(best), q, np.int32))
                    out_score.append(best)
            if out_query:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_query)), pa.array(np.concatenate(out_score))], names=["query", "score"])

    return run


def coded(items: Items):
    """Vectors with impacts and a similarity code: signs of BITS projections, each term with a random sign for every one."""

    def run(batches):
        signs = mix64(items.hashes.copy())
        for batch in batches:
            full = np.flatnonzero(unpacked(batch.column(2))[0] > 0)
            batch = batch.take(pa.array(full))
            if not batch.num_rows:
                continue
            sizes, terms, impacts = of_vectors(items, batch)
            pull = (items.weights[terms] * impacts).astype(float)
            code, starts = np.zeros(len(sizes), np.int32), begins(sizes)
            for b in range(BITS):
                sign = ((signs >> np.uint64(b)) & np.uint64(1)).astype(float) * 2 - 1
                code = code * 2 + (np.add.reduceat(pull * sign[terms], starts) > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(impacts, pa.int32()))
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(terms, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), batch.column(0), own, lists], names=["code", "doc_id", "terms", "impacts"])

    return run


def lists_needed(items: Items) -> dict[int, np.ndarray]:
    """For each term that is essential to an item, the terms of all items to which it is."""
    users: dict[int, list[int]] = {}
    for q, terms in enumerate(items.essential):
        for t in terms.tolist():
            users.setdefault(t, []).append(q)
    return {t: np.unique(np.concatenate([items.terms[q] for q in qs])) for t, qs in users.items()}


def clusters(held: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``held`` (members by coordinates) and where blocks begin in it."""
    n = len(held)
    if n <= BLOCK:
        return np.arange(n), np.zeros(1, np.int64)
    pivots = np.linspace(0, n - 1, min(PIVOTS, -(-n // BLOCK))).astype(np.int64)
    pull = held * np.sqrt(weights)
    sides = pull[pivots]
    sides /= np.linalg.norm(sides, axis=1, keepdims=True) + 1e-9
    to = np.argmax(pull @ sides.T, axis=1)
    order = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.diff(to[order], prepend=-1))
    sizes = np.diff(np.append(first, n))
    pieces = -(-sizes // BLOCK)
    part = np.arange(int(pieces.sum())) - np.repeat(begins(pieces), pieces)
    return order, np.repeat(first, pieces) + part * np.repeat(sizes, pieces) // np.repeat(pieces, pieces)


def blocks_of(items: Items, needed: dict[int, np.ndarray], sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> tuple:
    """Blocks of all needed lists of a group: terms, sizes, members, and summaries as sizes, terms and maxima."""
    order = np.argsort(terms, kind="stable")
    doc, by_term, starts = np.repeat(np.arange(len(sizes)), sizes)[order], terms[order], begins(sizes)
    place = np.full(len(items.hashes), -1)
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    first = np.flatnonzero(np.diff(by_term, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(by_term))):
        t = int(by_term[a])
        if t not in needed:
            continue
        over = needed[t]
        place[over] = np.arange(len(over))
        step = max(BLOCK, CELLS // len(over))
        for members in (doc[i : min(i + step, b)] for i in range(a, b, step)):
            at = ranges(starts[members], sizes[members])
            column = place[terms[at]]
            inside = np.flatnonzero(column >= 0)
            held = np.zeros((len(members), len(over)))
            held[np.repeat(np.arange(len(members)), sizes[members])[inside], column[inside]] = impacts[at[inside]]
            sequence, begin = clusters(held, items.weights[over])
            maxima = np.maximum.reduceat(held[sequence], begin, axis=0).astype(np.int64)
            block, coordinate = np.nonzero(maxima)
            for held_out, values in zip(out, (np.full(len(begin), t), np.diff(np.append(begin, len(members))), members[sequence], np.bincount(block, minlength=len(begin)), over[coordinate], maxima[block, coordinate])):
                held_out.append(values)
        place[over] = -1
    return tuple(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in out)


def indexed(items: Items):
    """Rows of the index from vectors in the order of their codes."""

    def run(batches):
        needed = lists_needed(items)
        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                part = batch.slice(i, GROUP)
                sizes, terms = unpacked(part.column(2))
                impacts = unpacked(part.column(3))[1].astype(np.int64)
                columns = [sizes, terms, impacts, *blocks_of(items, needed, sizes, terms, impacts)]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(1)], pa.list_(pa.int64())), *[pa.array([c.astype(np.int32)], pa.list_(pa.int32())) for c in columns]], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


@dataclass
class Group:
    """A row of the index."""

    sizes: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    block_terms: np.ndarray
    block_sizes: np.ndarray
    members: np.ndarray
    summary_sizes: np.ndarray
    summary_terms: np.ndarray
    summary_maxima: np.ndarray

    def __post_init__(self) -> None:
        self.starts, self.block_starts, self.summary_starts = begins(self.sizes), begins(self.block_sizes), begins(self.summary_sizes)

    def bounds(self, blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no member's score can exceed; every summary has its own list's term."""
        at = ranges(self.summary_starts[blocks], self.summary_sizes[blocks])
        return np.add.reduceat(weights[self.summary_terms[at]] * self.summary_maxima[at], begins(self.summary_sizes[blocks]))

    def found(self, weights: np.ndarray, essential: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Documents that reach ``least`` with their scores; how many blocks were looked at, and how many of them were skipped."""
        lo = np.searchsorted(self.block_terms, essential)
        blocks = ranges(lo, np.searchsorted(self.block_terms, essential, "right") - lo)
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        kept = blocks[self.bounds(blocks, weights) >= least]
        docs = np.unique(self.members[ranges(self.block_starts[kept], self.block_sizes[kept])])
        s = scores(weights, docs, self.starts, self.sizes, self.terms, self.impacts)
        return docs[s >= least], s[s >= least], len(blocks), len(blocks) - len(kept)


def searched(items: Items, k: int):
    """(query, doc_id, score): the k best of each group that reach the item's threshold."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values
                key = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
                group = Group(*[batch.column(c)[r].values.to_numpy().astype(np.int64) for c in range(1, 10)])
                query, place, score = [], [], []
                for q, essential in enumerate(items.essential):
                    docs, s, _, _ = group.found(items.dense(q), essential, int(items.least[q]))
                    best = np.lexsort((key[docs], -s))[:k]
                    query.append(np.full(len(best), q, np.int32))
                    place.append(docs[best])
                    score.append(s[best])
                if query:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score))], names=["query", "doc_id", "score"])

    return run


def weighted(items: Items, found: DataFrame) -> None:
    """Statistics of all documents, the terms' weights and their greatest impacts."""
    total = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    items.documents, items.words = int(total[0]), int(total[1] or 0)
    m = f"(100 - 50 + (50 * n * {items.documents}L) div {max(items.words, 1)}L)"
    impact = F.expr(f"(1000000000L * tfs) div (1000 * tfs + 20 * {m})")
    held = found.select("n", F.inline(F.arrays_zip("terms", "tfs"))).groupBy("terms").agg(F.count("*").alias("df"), F.max(impact).alias("most")).collect()  # a row a term of the items
    items.weights, items.most, items.df = (np.zeros(len(items.hashes), np.int64) for _ in range(3))
    for r in held:
        items.df[r["terms"]] = r["df"]
        items.weights[r["terms"]] = math.floor(1000 * math.log((2 * items.documents + 2) / (2 * r["df"] + 1)))
        items.most[r["terms"]] = r["most"]


def bounded(items: Items, found: DataFrame, k: int) -> None:
    """Thresholds, and the essential terms that follow from them and from the terms' greatest impacts."""
    first = Window.partitionBy("query").orderBy(F.desc("score"))
    best = found.mapInArrow(seeds(items, k), "query int, score long").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    items.least = np.ones(len(items.ids), np.int64)  # a score of 0 is no result
    for r in best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
        items.least[r["query"]] = max(1, r["least"])
    most = items.weights * items.most
    items.essential = []
    for terms, least in zip(items.terms, items.least):
        terms = terms[np.argsort(-most[terms], kind="stable")]
        rest = np.cumsum(most[terms][::-1])[::-1]  # what a term and those after it can give
        items.essential.append(np.sort(terms[rest >= least]))


def build_index(items: Items, found: DataFrame) -> DataFrame:
    """The index over all documents that hold a term of the items; written to the shared folder."""
    vectors_ = found.mapInArrow(coded(items), "code int, doc_id long, terms array<int>, impacts array<int>").withColumn("tie", F.monotonically_increasing_id())
    near = vectors_.repartitionByRange("code", "doc_id", "tie").sortWithinPartitions("code", "doc_id", "tie").drop("tie")
    return materialize(near.mapInArrow(indexed(items), INDEX), "index")


def chunks(items: DataFrame, id_col: str, text_col: str):
    rows = []
    for r in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        rows.append(r)
        if len(rows) == MOST_ITEMS:
            yield rows
            rows = []
    if rows:
        yield rows


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", item_id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each row of items."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], OUT)
    for rows in chunks(items, item_id_col, text_col):
        chunk = items_of(rows)
        if not len(chunk.hashes):
            continue
        found = materialize(texts.mapInArrow(vectors(chunk.hashes), VECTORS), "vectors")
        weighted(chunk, found)
        bounded(chunk, found, k)
        best = build_index(chunk, found).mapInArrow(searched(chunk, k), "query int, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, i in enumerate(chunk.ids)], "query int, item_id long")
        out = out.union(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def oracle() -> str:
    """DuckDB SQL that scores every document."""
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: f"regexp_extract_all({lower(c)}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
docs AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM d WHERE len(ws) > 0),
t AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM docs),
p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS w FROM docs) GROUP BY ALL),
weights AS (SELECT w, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, t GROUP BY w),
q AS (SELECT DISTINCT i, item_id, w FROM (SELECT row_number() OVER () AS i, item_id, unnest({words("coalesce(text, '')")}) AS w FROM benchmark)),
s AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l))))::BIGINT AS score
  FROM q JOIN weights USING (w) JOIN p USING (w) JOIN docs USING (r), t GROUP BY i, r)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) <= 50"""
