"""The stages of the corpus pipeline."""

import itertools
import os
import tempfile
import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import neardup
from skyloom.llm.common import materialize
from skyloom.llm.queries import tokenizer_path


def test_dedup_takes_pairs_from_four_fifths(spark):
    words = [f"w{j}" for j in range(200)]
    rows = [(i, " ".join(f"edit{j}" if j in edits else w for j, w in enumerate(words))) for i, edits in ((1, ()), (2, (20, 60, 100, 140)), (3, range(10, 190, 20)))]
    got = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]  # similarities of 176/216 and 151/241 with the first


def test_signatures_at_the_threshold_are_alike():
    assert neardup.least_alike(85) == 112
    for percent in (50, 80, 85, 95):
        p = percent / 100
        assert sum(comb(neardup.MINIMA, k) * p**k * (1 - p) ** (neardup.MINIMA - k) for k in range(neardup.least_alike(percent))) < 2e-6


DATA = "/root/testdata/sf0.001"


def tables(spark, docs, labels, benchmark):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_whole_pipeline_over_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns that clash: every row that comes out is a document as the library encodes it, copies of
    one document are one, benchmark passages are gone, and no clean document is lost to the first three stages."""
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    base, item = read("documents"), read("benchmark").first()["text"]
    clean = [f"clean{i} " + " ".join(f"w{(i * 37 + j * j) % 997}x{j % 13}" for j in range(60)) for i in range(6)]
    odd = [(None, None, None, None, None), (9001, None, "en", "web", None), (9002, "", None, None, 0), (9003, "long " + " ".join(f"t{i}" for i in range(40_000)), "en", None, 1), (9004, clean[0], None, "web", 5), (9004, clean[0], None, "web", 5), (9005, clean[1], "de", "web", 5), (9006, clean[1] + " tail", "de", "web", 5), (9007, f"{clean[2]} {item} {clean[3]}", "en", "web", 7), (9008, clean[4], "fr", "q", 8), (None, clean[5], "fr", "q", 8)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns({c: F.lit("clash") for c in ("size", "copies", "rank", "score", "component_id", "kept", "start", "n_tokens", "item_id", "quality", "part")})
    got = corpus_pipeline.run(spark, tables(spark, docs, read("labels"), read("benchmark"))).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    facts = lambda text: (len(ids := [*encode(text or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes()))
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(facts(r.text))
    assert all((r.n_tokens, r.ids_crc32) in texts[r.doc_id] for r in got)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *itertools.accumulate(r.n_tokens for r in ordered[:-1])]
    assert [-1 if r.doc_id is None else r.doc_id for r in ordered] == sorted(-1 if r.doc_id is None else r.doc_id for r in ordered)
    after = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = materialize(stage(spark, after, DATA), "stage")
        assert after.columns == docs.columns
    left = [(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()]
    held = {i for i, _ in left}
    assert 9007 not in held and 9008 in held and (9005 in held) != (9006 in held)
    assert sum(i == 9004 for i, _ in left) == 1 and sum(t == clean[5] for _, t in left) == 1
    assert {r.doc_id for r in got} <= held


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_whole_pipeline_over_empty_tables(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    empty = tables(spark, *(read(n).limit(0) for n in ("documents", "labels", "benchmark")))
    assert corpus_pipeline.run(spark, empty).count() == 0
    unlabelled = tables(spark, read("documents").limit(20), read("labels").limit(0), read("benchmark").limit(0))
    assert {r.doc_id for r in corpus_pipeline.run(spark, unlabelled).collect()} <= {r.doc_id for r in read("documents").limit(20).collect()}
