"""Ranked search against scoring every document by the written rule."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"word{i}" for i in range(300)]


def brute(docs, items, k):
    """(item number, rank, doc_id, score), written from the rule alone."""
    terms = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for q, (_, text) in enumerate(items):
        found = []
        for (doc_id, _), t in zip(docs, terms):
            if not t:
                continue
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in set(TERM.findall((text or "").translate(LOW))) if tf[w])
            if score > 0:
                found.append((-score, -1 if doc_id is None else doc_id, doc_id))
        out += [(items[q][0], r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def some_docs():
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(300)], k=r.randint(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(2000, None), (2001, ""), (2002, " \t--- "), (None, docs[9][1]), (5, docs[5][1]), (5, docs[5][1]), (2003, "É word1 ÉCOLE école 12 word1\x00word2"), (2004, " ".join(r.choices(WORDS, k=20000)))]
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 30)))) for i in range(12)] + [(50, docs[7][1].upper()), (51, None), (52, ""), (53, "nowhere"), (None, "word3 word250"), (50, "École 12 word299")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_results_are_those_of_scoring_everything(spark, monkeypatch, small):
    if small:  # many groups, blocks, pivots, slabs and chunks of items
        for name, value in (("GROUP", 64), ("BLOCK", 4), ("CELLS", 256), ("MOST_ITEMS", 5), ("PIVOTS", 8)):
            monkeypatch.setattr(ranked, name, value)
    docs, items = some_docs()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("query", "score", "rank", "terms", "n", "code", "tie", "item_id")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("query", "doc_id", "score")}).coalesce(1)
    for k in (10, 50):
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.rank_documents(d, i, k).collect()), key=str)
        assert got == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = some_docs()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("text is null"), i), (d, i.filter("text is null"))):
        out = ranked.rank_documents(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def group_of(docs, items):
    """The statistics, thresholds and one group, made without Spark."""
    terms = ranked.items_of(items)
    texts = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    (batch,) = ranked.vectors(terms.hashes)([texts])
    terms.documents, terms.words = sum(1 for n in batch.column(1).to_pylist() if n), sum(batch.column(1).to_pylist())
    held = np.bincount(batch.column(2).flatten().to_numpy(), minlength=len(terms.hashes))
    terms.weights = np.array([math.floor(1000 * math.log((2 * terms.documents + 2) / (2 * x + 1))) if x else 0 for x in held], np.int64)
    terms.essential = terms.terms
    (near,) = ranked.coded(terms)([batch])
    return terms, near.take(pa.array(np.argsort(near.column(0).to_numpy(), kind="stable")))


def test_blocks_hold_whole_lists_and_bounds_are_never_too_low():
    docs, items = some_docs()
    terms, near = group_of(docs, items)
    sizes, own = ranked.unpacked(near.column(2))
    impacts = ranked.unpacked(near.column(3))[1].astype(np.int64)
    group = ranked.Group(sizes, own, impacts, *ranked.blocks_of(terms, ranked.lists_needed(terms), sizes, own, impacts))
    assert group.block_sizes.max() <= ranked.BLOCK
    for t in range(len(terms.hashes)):
        blocks = np.flatnonzero(group.block_terms == t)
        members = np.sort(group.members[ranked.ranges(group.block_starts[blocks], group.block_sizes[blocks])])
        assert members.tolist() == np.unique(np.repeat(np.arange(len(sizes)), sizes)[own == t]).tolist()
    skipped = looked = 0
    for q, essential in enumerate(terms.terms):
        weights = terms.dense(q)
        full = ranked.scores(weights, np.arange(len(sizes)), group.starts, sizes, own, impacts)
        for b in np.flatnonzero(np.isin(group.block_terms, essential)):
            at = group.members[group.block_starts[b] : group.block_starts[b] + group.block_sizes[b]]
            assert group.bounds(np.array([b]), weights)[0] >= full[at].max()
        least = max(1, int(np.sort(full)[-10]))
        found, s, n, left = group.found(weights, essential, least)
        looked, skipped = looked + n, skipped + left
        assert sorted(found) == np.flatnonzero(full >= least).tolist() and (s == full[found]).all()
    assert 0.3 < skipped / looked < 1  # bounds leave out a good part of the blocks


def test_members_of_a_block_are_alike():
    """Two families of documents in one list do not share blocks."""
    r = np.random.default_rng(2)
    held = np.zeros((200, 40))
    family = r.integers(0, 2, 200)
    for i, f in enumerate(family):
        held[i, r.choice(np.arange(20) + 20 * f, 8, replace=False)] = r.integers(1, 100, 8)
    order, begin = ranked.clusters(held, np.ones(40, np.int64))
    assert sorted(order) == list(range(200))
    mixed = sum(len(set(family[order[a:b]])) > 1 for a, b in zip(begin, [*begin[1:], 200]))
    assert mixed <= 0.1 * len(begin)
