"""Benchmark decontamination: n-gram seeds bring passages and test items together, Smith-Waterman alignment scores them.

Items are normalised to lower-case words without punctuation and cut into word n-grams. One pass over the corpus finds where
any of these stands and takes the passage around each cluster of hits (as word hashes; a passage reaches as far as the item can). Every
n-gram that a document kept is a seed, common or rare: an edited copy may keep only n-grams that are not the rarest (a choice of the rarest
lost such copies). Clusters that hold too few of the item's words for any alignment to reach the limit are dropped where they are found,
so what common n-grams hit is not written. Passages are aligned with the item, word by word, with linear gap costs. The score is the
alignment's share of the best that the item could reach. A copy that keeps no n-gram whole (an edit in every GRAM words) has no seed and is not found.

Items go through in chunks of about CHUNK_GRAMS n-grams, each sent to the tasks; more items mean more passes, not larger
chunks (one longer item is a chunk of its own). Items shorter than an n-gram are one n-gram of all their words.

Defined results: null or empty texts hold nothing; a null or empty item text matches nothing; items that share an id, or have none, are
all looked for, and the best alignment of each id (null is one) with a document counts; repeated rows give equal rows of hits
once; ids are cast to long; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, gram_hashes, materialize, text_chunks, word_hashes

GRAM, MARGIN = 3, 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: n-grams that one pass broadcasts.
CHUNK_GRAMS = 500_000
SEPARATOR = np.array([not (0x30 <= FOLD[b] <= 0x39 or 0x61 <= FOLD[b] <= 0x7A or b >= 0x80) for b in range(256)])


def item_grams(batches):
    """item, item_id, gram, words of every n-gram of every item (a distinct id and text); words is given with the first n-gram only."""
    for batch in batches:
        for i, offsets, data in text_chunks(batch.column(2)):
            words, first = word_hashes(data, offsets, SEPARATOR)
            for r in range(len(offsets) - 1):
                own = words[first[r] : first[r + 1]]
                if not len(own):
                    continue
                grams = gram_hashes(own, min(GRAM, len(own))).view(np.int64)
                k = len(grams)
                rest = [own.view(np.int64).tolist()] + [None] * (k - 1)
                item, item_id = (pa.array([batch.column(c)[i + r].as_py()] * k, pa.int64()) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([item, item_id, pa.array(grams), pa.array(rest, pa.list_(pa.int64()))], names=["item", "item_id", "gram", "words"])


class Items:
    """A chunk's n-grams, sorted, with the items that hold them."""

    def __init__(self, rows) -> None:
        rows.sort(key=lambda r: r["gram"])
        words = {r["item"]: np.array(r["words"], np.int64) for r in rows if r["words"] is not None}
        self.ids = sorted(words)
        self.words = [words[x] for x in self.ids]
        number = {x: i for i, x in enumerate(self.ids)}
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.short = sorted({len(w) for w in self.words if len(w) < GRAM})
        self.grams, self.owner = np.array([r["gram"] for r in rows], np.int64), np.array([number[r["item"]] for r in rows], np.int64)


def find_passages(items: Items, least: float):
    """Passages of documents around clusters of item n-grams that hold enough of the item's words to reach ``least`` (no word of the item is
    matched twice): doc_id, item, start, words."""
    grams, owner, lengths, short, ids, item_words = items.grams, items.owner, items.lengths, items.short, items.ids, items.words

    def run(batches):
        low = np.zeros(1 << 16, bool)
        low[(grams & 0xFFFF).astype(np.int64)] = True
        for batch in batches:
            for i, offsets, data in text_chunks(batch.column(1)):
                words, first = word_hashes(data, offsets, SEPARATOR)
                found = []
                for k in (GRAM, *short):
                    at_all = gram_hashes(words, k)
                    maybe = np.flatnonzero(low[(at_all & np.uint64(0xFFFF)).astype(np.int64)])
                    s, e = (np.searchsorted(grams, at_all[maybe].view(np.int64), side) for side in ("left", "right"))
                    hit = np.flatnonzero(e > s)
                    at = np.repeat(maybe[hit], (e - s)[hit])
                    g = np.repeat(s[hit], (e - s)[hit]) + np.arange(len(at)) - np.repeat(np.cumsum((e - s)[hit]) - (e - s)[hit], (e - s)[hit])
                    row = np.searchsorted(first, at, "right") - 1
                    ok = at + k <= first[row + 1]
                    found.append((at[ok], g[ok], row[ok]))
                at, g, row = (np.concatenate([f[c] for f in found]) for c in range(3))
                if not len(at):
                    continue
                item = owner[g]
                order = np.lexsort((at, item, row))
                at, g, row, item = at[order], g[order], row[order], item[order]
                n = lengths[item]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > n[1:] + MARGIN)
                cluster = np.flatnonzero(new)
                ends = np.append(cluster[1:], len(at))
                out = []
                for c, e in zip(cluster, ends):
                    reach = int(n[c]) + MARGIN
                    lo, hi = max(first[row[c]], at[c] - reach), min(first[row[c] + 1], at[e - 1] + reach)
                    passage = words[lo:hi].view(np.int64)
                    if np.isin(item_words[item[c]], passage).sum() >= least * n[c]:
                        out.append((batch.column(0)[i + row[c]].as_py(), ids[item[c]], int(lo - first[row[c]]), passage))
                yield pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["doc_id", "item", "start", "passage"])

    return run


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman by rows of the item: best score, and start and end of the passage's part in it."""
    m = len(passage)
    steps = np.arange(m + 1)
    h, begin = np.zeros(m + 1, np.int64), steps.copy()
    best, at, since = 0, 0, 0
    for w in item:
        diagonal = np.maximum(h[:-1] + np.where(passage == w, MATCH, MISMATCH), 0)
        above = h[1:] + GAP
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum(diagonal, above)
        start = steps.copy()
        start[1:] = np.where(new[1:] == 0, steps[1:], np.where(diagonal >= above, begin[:-1], begin[1:]))
        lifted = np.maximum.accumulate(new - GAP * steps)
        source = np.maximum.accumulate(np.where(new - GAP * steps == lifted, steps, 0))
        along = lifted + GAP * steps
        start = np.where(along > new, start[source], start)
        h, begin = np.maximum(new, along), start
        j = int(h.argmax())
        if h[j] > best:
            best, at, since = int(h[j]), j, int(begin[j])
    return best, since, at


def score_passages(batches):
    for batch in batches:
        out = []
        for doc_id, item_id, start, passage, item in zip(*(batch.column(k) for k in range(5))):
            s, lo, hi = align(item.values.to_numpy(), passage.values.to_numpy())
            out.append((doc_id.as_py(), item_id.as_py(), s / (MATCH * len(item)), start.as_py() + lo, start.as_py() + hi))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "first_word", "end_word"])


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: the best alignment of each document with each item id that reaches ``least``."""
    spark = docs.sparkSession
    distinct = items.filter(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    grams = materialize(distinct.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(item_grams, "item long, item_id long, gram long, words array<long>"), "leak-items")
    chunks = -(-(grams.count()) // CHUNK_GRAMS) or 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    passages = None
    for chunk in range(chunks):
        rows = grams.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == chunk).select("item", "gram", "words").collect()
        if rows:
            found = texts.mapInArrow(find_passages(Items(rows), least), "doc_id long, item long, start long, passage array<long>")
            passages = found if passages is None else passages.union(found)
    if passages is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    passages = materialize(passages.distinct(), "leak-passages")
    words = grams.filter("words is not null").select("item", "item_id", "words")
    both = passages.join(words, "item").select("doc_id", "item_id", "start", "passage", "words")
    scored = both.repartition("doc_id", "item_id").mapInArrow(score_passages, "doc_id long, item_id long, score double, first_word long, end_word long")
    best = scored.filter(F.col("score") >= least).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("early"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.early")).alias("first_word"), F.col("b.end_word").alias("end_word"))


def drop_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the documents that hold an item."""
    bad = find_leaks(docs, items, least).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["leak_id"]), "left_anti")
