"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import json
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, licenses, mixing, neardup, quality, secrets, substrings, tokens, topk, urls
from skyloom.llm.graph import components

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]
WS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    r, base, shared = random.Random(11), prose(120, 1), prose(90, 2)
    words = base.split()
    rows = [(i, prose(r.randint(1, 150), 100 + i), f"src{i % 4}") for i in range(30)]
    rows += [(100, base, "src0"), (101, base, "src1"), (102, base.upper(), None), (103, " ".join(words[:60] + ["edited"] + words[61:]), "src0"), (104, " ".join(words[:30] + ["a"] + words[31:80] + ["b"] + words[81:]), "src2")]
    rows += [(105, prose(40, 7) + "\n" + shared + " " + prose(40, 8), "src0"), (106, shared + "\t" + prose(30, 9), "src3"), (107, prose(20, 10) + " " + shared, "src3")]
    rows += [(110, None, "src0"), (111, "", "src1"), (112, "   \n\t ", None), (113, "one two", "src0"), (114, "ONE two", "src2"), (115, "é ü ß café\u00a0x " * 40, "src1"), (116, "abc " * 4000, "src1"), (117, "x" * 3000, "src2"), (118, "\x00\x1c\x85 end", "src2")]
    rows += [(120, prose(50, 20), "src0")] * 2 + [(None, prose(50, 21), "src1"), (121, prose(15000, 22), "src0")]
    return rows


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({n: F.lit("clash") for n in ("size", "th", "set_id", "component", "key", "n", "start", "rank", "copies", "sk")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sizes(rows):
    return [(i, len(WS.findall(t or "")), s) for i, t, s in rows]


def test_mix(spark, docs, none):
    plan = mixing.mix_sources(docs).collect()
    want = sizes(corpus())
    assert sorted((str(r.doc_id), r["size"]) for r in plan) == sorted((str(i), n) for i, n, _ in want)
    total, by = sum(n for _, n, _ in want), {}
    for r in plan:
        by.setdefault(r.sk, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    assert sorted(by) == ["0", "1src0", "1src1", "1src2", "1src3"]
    targets = {k: v[0].target for k, v in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for k, v in by.items():
        assert v[0].source_size == sum(r["size"] for r in v) and targets[k] <= 2 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - targets[k]) <= max(60, 0.02 * targets[k], max(r["size"] for r in v) / 2)  # a copy is a whole document
    # water-filling by hand: weights 5 2 1 5 2 in order, null last
    order, w = ["1src0", "1src1", "1src2", "1src3", "0"], dict(zip(["1src0", "1src1", "1src2", "1src3", "0"], (5, 2, 1, 5, 2)))
    cap, fixed = {k: 2 * by[k][0].source_size for k in order}, {}
    while True:
        left = 1.5 * total - sum(fixed.values())
        level = left / sum(w[k] for k in order if k not in fixed)
        over = [k for k in order if k not in fixed and w[k] * level > cap[k]]
        if not over:
            break
        fixed |= {k: cap[k] for k in over}
    assert all(abs(targets[k] - fixed.get(k, w[k] * level)) < 1e-6 * total for k in order)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    assert mixing.take_copies(docs, mixing.mix_sources(docs)).count() == sum(r.copies for r in plan)
    assert mixing.mix_sources(none).count() == 0


def test_leaks(spark, docs, none):
    shared = prose(90, 2).split()
    edited = " ".join(shared[:8] + ["changed"] + shared[9:22] + shared[24:40])
    items = spark.createDataFrame([(1, " ".join(shared[10:40])), (2, edited), (3, prose(30, 999)), (4, None), (5, ""), (6, "zz qq")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(d, i) for d in (105, 106, 107) for i in (1, 2)}
    assert all(s == 1.0 for (d, i), s in got.items() if i == 1) and all(0.7 < s < 1 for (d, i), s in got.items() if i == 2)
    assert decontaminate.drop_leaks(docs, items).count() == docs.count() - 3
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_with_an_edit_every_few_words(spark):
    """Copies that keep one to three n-grams between edits, beside exact copies that make the kept ones no rarer than the broken ones."""
    words = [f"w{j}" for j in range(60)]
    copies = [(d, " ".join(f"edit{j}" if j % d == d - 1 else w for j, w in enumerate(words))) for d in (4, 5, 6)]
    exact = [(10, " ".join(words)), (11, "some words before " + " ".join(words)), (12, " ".join(words[:20]) + " " + prose(60, 5))]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for held in (*([c] for c in copies), copies[:1] + exact):
        got = {r.doc_id: r.score for r in decontaminate.find_leaks(spark.createDataFrame(held, "doc_id long, text string"), items).collect()}
        want = {i: sw(words, t.split()) / 120 for i, t in held}
        assert got == {i: s for i, s in want.items() if s >= 0.5} and held[0][0] in got


def test_leaks_of_repeated_and_missing_item_ids(spark):
    """Items of one id are all looked for; columns that clash, repeated rows and null ids do no harm."""
    texts = [prose(40, 700 + i) for i in range(4)]
    items = spark.createDataFrame([(1, texts[0], 5), (1, texts[1], 6), (1, texts[1], 6), (None, texts[2], 7), (2, None, 8), (2, texts[3][:20], 9)], "item_id long, text string, item long").withColumns({c: F.lit("clash") for c in ("gram", "words", "doc_id", "start")})
    docs = spark.createDataFrame([(10, prose(30, 1) + " " + texts[1]), (10, prose(30, 1) + " " + texts[1]), (11, texts[2] + " " + texts[0]), (None, texts[2]), (12, prose(50, 4))], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "passage", "score", "leak_id")})
    got = sorted((str(r.doc_id), str(r.item_id), r.score) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == sorted([("10", "1", 1.0), ("11", "1", 1.0), ("11", "None", 1.0), ("None", "None", 1.0)])
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [12]


def test_leaks_are_all_alignments_that_reach_the_limit(spark):
    """Against brute force: every document and item that share a 3-gram and align well enough, edited copies among them, are found, no others."""
    r = random.Random(8)
    items = [(i, prose(r.randint(2, 30), 800 + i)) for i in range(25)]
    docs = []
    for d in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, len(w) // 2)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        docs.append((d, " ".join([prose(r.randint(0, 40), 900 + d), *w, prose(r.randint(0, 40), 1900 + d)])))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = item.split(), text.split()
            if grams(a, min(3, len(a))) & grams(b, min(3, len(a))) and (s := sw(a, b) / (2 * len(a))) >= 0.5:
                want[d, i] = s
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 20 < len(want) < 200


def sw(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_score_is_smith_waterman():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 20))
        assert decontaminate.align(a, b)[0] == sw(a, b)


def brute_repeats(rows, k=400):
    seen, out = {}, []
    bodies = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in bodies:
        for s in range(len(b) - k + 1):
            seen[b[s : s + k]] = seen.get(b[s : s + k], 0) + 1
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - k + 1):
            if seen[b[s : s + k]] > 1:
                gone[s] += 1
                gone[s + k] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_repeats(docs, none):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect())
    want = brute_repeats(corpus())
    assert got == want and sum(w[2] > 0 for w in want) > 5
    assert substrings.remove_repeats(none).count() == 0


def test_column_wise_construction():
    """Orders and common prefixes against all pairs: which pieces of a group share LENGTH bytes in a column."""
    r = np.random.default_rng(9)
    base = [r.integers(0, 3, substrings.WIDEST) for _ in range(3)]
    rows = np.full((60, substrings.WIDEST), substrings.NO_BYTE)
    for i in range(60):
        a, e = r.integers(0, 337), r.integers(400, 737)
        rows[i, min(a, e - 400) : e] = base[i % 3][min(a, e - 400) : e]
        for x in r.integers(0, substrings.WIDEST, r.integers(0, 4)):
            rows[i, x] = 5 if rows[i, x] != substrings.NO_BYTE else rows[i, x]
    group = np.arange(60) % 3 + 3 * (r.integers(0, 2, 60))
    got = substrings.column_wise(group.astype(np.int64), np.ascontiguousarray(rows.T.astype(np.int16)))
    want = np.zeros_like(got)
    for x in range(substrings.BEFORE + 1):
        for i in range(60):
            w = rows[i, x : x + 400]
            want[x, i] = (w != substrings.NO_BYTE).all() and any(j != i and group[j] == group[i] and (rows[j, x : x + 400] == w).all() for j in range(60))
    assert (got == want).all() and 100 < want.sum() < want.size - 100
    v, first = r.integers(0, 50, 300).astype(np.int32), r.integers(0, 250, 200)
    last = first + r.integers(0, 50, 200)
    assert (substrings.least_between(v, first, last) == [v[a : b + 1].min() for a, b in zip(first, last)]).all()


@pytest.mark.parametrize("hot", [0, 3])
def test_repeats_of_hot_anchors(docs, spark, monkeypatch, hot):
    """Anchors with more pieces than a bucket takes, and passages in many surroundings: the same rows, whichever way they go."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BUCKET", 5)
    passage = prose(120, 71)
    rows = corpus() + [(2000 + i, prose(30, 3000 + i) + " " + passage[i % 7 : 700 + i % 5] + " " + prose(30, 4000 + i), "src0") for i in range(25)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_repeats(rows)


def test_repeats_across_segments(docs, monkeypatch):
    """Long texts in overlapping segments: the pieces together see every window once."""
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    import pyarrow as pa

    rows = [("a" * 5 + prose(900, 3),), (prose(900, 3),), ("x" * 4000,)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array([r[0] for r in rows])], names=["doc_id", "th", "text"])
    for d in range(3):
        covered = sorted(x for b in substrings.anchors([batch]) for i, lo, hi in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()) if i == d for x in range(lo, hi + 1))
        assert covered == list(range(len(rows[d][0]) - 399))


def test_repeats_do_not_depend_on_segments(spark):
    """Unique and repeated text across many segment borders. The workers get the small SEGMENT with the function."""
    rows = [(0, prose(2500, 31), ""), (1, prose(1200, 32) + prose(300, 33), ""), (2, prose(300, 33) + prose(900, 34), ""), (3, "y" * 2600, "")]
    held = substrings.anchors

    def anchors(batches):
        substrings.SEGMENT, whole = 1000, substrings.SEGMENT
        try:
            yield from held(batches)
        finally:
            substrings.SEGMENT = whole

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substrings, "anchors", anchors)
            got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    want = brute_repeats(rows)
    assert got == want and want[0][2] == 0 and want[1][2] > 400


def test_coder_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 50000), (7, 3), (700, 2), (5000, 50257), (60000, 300)):
        ids = np.minimum(r.zipf(1.4, n), top).astype(np.int64) - 1
        data = tokens.encode_segment(ids)
        assert (tokens.decode_segment(data) == ids).all()
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            tokens.decode_segment(bytes(broken))
    assert len(tokens.encode_segment(np.tile(np.arange(50), 4000))) < 200000 / 4


def test_words_of_letters_and_marks_are_encoded_by_pieces(monkeypatch):
    from tokenizers import Tokenizer

    from skyloom.llm.queries import tokenizer_path

    path = tokenizer_path()
    whole, coder, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(3)
    monkeypatch.setattr(coder, "MOST", 300)
    heads = ["the", "Été", "ñandú", "ciónmente", "Straße", "x", "élève", "It", "wordlike"]
    tails = ["", "", ".", ",", "$$$", ",%%%", "'", "\"?!", "_", "~~", "<|"]
    others = ["it's", "don't.", "a1", "42", "42,", "×2", "µm", "e\u0301t", "—", "word—", "日本語", "名,", "a'sb", "ça-va", "!", "x\u200b.", "ﬁne", "'re", "5'", "Ω.", "\u0000"]
    made = lambda k: "".join(r.choice("aeésñtrñlmü") for _ in range(k))
    for _ in range(6):
        words = [h + t for h in heads + [made(r.randint(1, 9)) for _ in range(40)] for t in tails] + others
        texts = ["".join(w + r.choice(" \n") for w in r.choices(words, k=r.randint(1, 60)))[:-1] for _ in range(60)] + [" ".join(others), "the  end", " the", "the\n", "the <|endoftext|> end", ""]
        got = coder.encode(pa.array(texts, pa.large_string()))
        assert [list(ids) for ids in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    fresh = tokens.Encoder(path)
    monkeypatch.setattr(fresh, "joined", lambda *_: pytest.fail("words of letters went through the whole tokenizer"))
    [ids] = fresh.encode(pa.array(["The naïve Été, naïve.\nThe end!"], pa.large_string()))
    assert list(ids) == whole.encode("The naïve Été, naïve.\nThe end!", add_special_tokens=False).ids


def test_tokens(docs, none):
    from skyloom.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    added = [(300 + j, x, "src0") for j, x in enumerate(("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "<|endof", "text|> <|", "a\nb c\nd e", " lead", "trail\n", "a\u2003b"))]
    assert 50256 in t.encode(added[0][1], add_special_tokens=False).ids
    docs, want, start = docs.select("doc_id", "text", "source").union(docs.sparkSession.createDataFrame(added, SCHEMA)).withColumn("start", F.lit("clash")), [], 0
    for i, text, _ in sorted(corpus() + added, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in tokens.tokenize_and_read(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == want
    assert tokens.tokenize_and_read(none, tokenizer_path()).count() == 0


def shingles_of(text):
    w = WS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, none):
    rows = corpus()
    sets = [shingles_of(t) for _, t, _ in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for (i, _, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(str((i, len(s), i if not s else least.get(c), (i if not s else least.get(c)) == i)) for (i, _, _), s, c in zip(rows, sets, comp))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in neardup.near_duplicates(docs).collect())
    assert got == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {100, 105} <= {r.doc_id for r in kept.select("doc_id").collect()} and not {101, 102, 103} & {r.doc_id for r in kept.select("doc_id").collect()}
    assert neardup.near_duplicates(none).count() == 0


def closure(sets, percent=85):
    """id -> smallest id reachable over links between sets, from all pairs; sets are compared as bit masks of the shingles that two sets hold at least."""
    times = Counter(x for s in sets.values() for x in s)
    bit = {x: 1 << i for i, x in enumerate(x for x, n in times.items() if n > 1)}
    masks = [(i, len(s), sum(bit[x] for x in s if x in bit)) for i, s in sets.items()]
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, (b, n_b, m_b) in enumerate(masks):
        for a, n_a, m_a in masks[:j]:
            both = (m_a & m_b).bit_count()
            if both and 100 * both >= percent * (n_a + n_b - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("family, sets, shingles", [(neardup.FAMILY, neardup.BLOCK_SETS, neardup.BLOCK_SHINGLES), (3, 4, 1000)])
def test_near_duplicates_in_families(spark, monkeypatch, family, sets, shingles):
    """A group of near copies and one that stays below the threshold, as whole families and table by table, in one block and in many."""
    monkeypatch.setattr(neardup, "FAMILY", family)
    monkeypatch.setattr(neardup, "BLOCK_SETS", sets)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    words = prose(200, 50).split()
    rows = [(i, " ".join(words[:k] + [f"edit{i}"] + words[k + 1 :])) for i, k in ((i, 5 + (i * 17) % 190) for i in range(40))]
    rows += [(100 + i, " ".join(words[:100] + prose(100, 60 + i).split())) for i in range(10)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == closure({i: shingles_of(t) for i, t in rows})


def test_near_duplicates_of_thousands(spark):
    """3,000 copies of one text with one to six edits each: the links are many, most pairs lie near the threshold, none may be lost."""
    words, r, rows = prose(160, 51).split(), random.Random(6), []
    for i in range(3000):
        w = list(words)
        for j in r.sample(range(len(w)), r.randint(1, 6)):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = closure({i: shingles_of(t) for i, t in rows})
    assert got == want and 100 < len(set(want.values())) < 2500


def test_intersections():
    r = np.random.default_rng(3)
    for top, sizes in ((30, (7, 9)), (400, (40, 25)), (10**6, (5, 5))):
        left, right = ([np.unique(r.integers(0, top, r.integers(1, 60))).astype(np.uint64) for _ in range(n)] for n in sizes)
        assert (neardup.common_counts(left, right) == [[len(np.intersect1d(x, y)) for y in right] for x in left]).all()


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 300)] + [(300, 300), (5, 5), (5, 6), (6, 5)] + [(r.randint(400, 500), r.randint(400, 500)) for _ in range(60)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: i for ab in links if ab[0] != ab[1] for i in ab}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://Example.ORG/en/1234?q"), (4, "http://a.example.org/es/x"), (5, "https://example.org"), (6, "http://x.com/de/1#f"), (7, "http://x.com/fr/1"), (8, "http://fox.casino.net/a"), (9, "http://casinos.net/a"), (10, "a://b://c/d"), (11, "http://"), (12, "http://casino.com/fr/1"), (8, "http://fox.casino.net/a"), (None, "http://x.org/a"), (13, "http://notexample.org/es/"), (14, "http://x.net/responsible-gambling/casino")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.org", "/en/1234", "example.org/en/1", "block"), (4, "a.example.org", "/es/x", "example.org/es/", "block"), (5, "example.org", "", None, "allow"), (6, "x.com", "/de/1", "com/de/", "block"), (7, "x.com", "/fr/1", "com/fr/", "allow"), (8, "fox.casino.net", "/a", None, "block"), (9, "casinos.net", "/a", None, "allow"), (10, "b:", "//c/d", None, "allow"), (11, "", "", None, "allow"), (12, "casino.com", "/fr/1", "com/fr/", "allow"), (None, "x.org", "/a", "org/", "allow"), (13, "notexample.org", "/es/", "org/", "allow"), (14, "x.net", "/responsible-gambling/casino", None, "allow")}
    assert urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).count() == len(rows)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality(spark, none):
    good = [(i, prose(60 + i % 40, i), "en", "a", 400) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(60, 2000 + i).split()), "en", "b" if i % 2 else "a", None) for i in range(100)]
    extra = [(5000, None, None, None, None), (5001, "", "en", "a", 0), (0, prose(60, 0), "en", "a", 400)]
    df = spark.createDataFrame(good + junk + extra, "doc_id long, text string, lang string, source string, n_chars long").withColumn("good", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 100, 2)] + [(0, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    classified = quality.classify(df, labels)
    assert min(quality.held_out(classified).first()[1:]) > 0.8 and quality.held_out(classified).first().both > 0.97
    out = {r.doc_id: r.kept for r in classified.collect()}
    held_out = [out[i] for i in range(1, 300, 2)], [not out[1000 + i] for i in range(1, 100, 2)]
    assert np.mean(held_out[0]) > 0.98 and np.mean(held_out[1]) > 0.98
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and abs(kept.filter("doc_id < 1000").count() - 301) <= 4
    assert quality.classify(df.limit(0), labels).count() == 0 and quality.classify(df, labels.limit(0)).filter("kept").count() == df.count()


def test_quality_tells_categories_apart(spark):
    """Every language and source has odds of its own, null too, however many there are."""
    rows = [(i, None if i % 41 == 0 else f"src{i % 41}", ("en", "fr", "es", "de", None)[i % 5]) for i in range(2000)]
    df = spark.createDataFrame([(i, prose(20, i % 7), s, g, 100) for i, s, g in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(g in ("fr", None))) for i, _, g in rows if i % 2], "doc_id long, quality int")
    out = quality.classify(df, labels)
    wrong = [r for r in out.join(df.select("doc_id", "lang"), "doc_id").collect() if (r.p_metadata >= 0.5) != (r.lang in ("fr", None))]
    assert not wrong
    tables = quality.category_odds(df, quality.good_labels(labels), "doc_id", {"source": "source", "lang": "lang"})
    known = {i: int(g in ("fr", None)) for i, _, g in rows if i % 2}
    train = {r.doc_id for r in df.filter(quality.fold_of("doc_id") > 1).collect()} & set(known)
    prior = (sum(known[i] for i in train) + 1) / (len(train) + 2)
    for name, at in (("source", 1), ("lang", 2)):
        got = {r[0]: r[1] for r in tables[name].collect()}
        for key in {r[at] for r in rows}:
            mine = [known[r[0]] for r in rows if r[0] in train and r[at] == key]
            assert math.isclose(got["0" if key is None else "1" + key], math.log((sum(mine) + 4 * prior) / (len(mine) - sum(mine) + 4 * (1 - prior))), rel_tol=1e-9)


def test_top_k(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i * 10, v[i].tolist()) for i in range(300)] + [(7, None), (8, [1.0] * 7 + [None]), (9, [float("nan")] * 8), (11, [float("inf")] + [0.0] * 7), (1, [1.0, 2.0]), (2000, [3.0, 4.0])]
    df = spark.createDataFrame([x for x in rows if x[0] != 2000 or len(x[1]) == 8], "vec_id long, embedding array<float>").withColumn("need", F.lit(1))
    q = np.floor(v.astype(np.float64) * 1024).astype(np.int64)
    want = []
    for a in range(0, 300, 10):
        s = q @ q[a]
        best = sorted((-int(s[b]), b * 10) for b in range(300) if b != a)[:10]
        want += [(a * 10, k + 1, b, -x) for k, (x, b) in enumerate(best)]
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == sorted(want)
    few = topk.top_k(df.filter("vec_id in (0, 10, 100)")).collect()
    assert sorted((x.query_id, x["rank"]) for x in few) == [(0, 1), (0, 2), (100, 1), (100, 2)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_repeated_ids_and_huge_components(spark, monkeypatch):
    """Queries of one id are apart, ties go to smaller ids, saturated components and many chunks of queries."""
    monkeypatch.setattr(topk, "QUERY_CHUNK", 3)
    r = np.random.default_rng(4)
    v = r.normal(size=(120, 4))
    v[3], v[20:40] = [1e30, -1e30, 0, 5], [0.5, 0.5, 0.5, 0.5]
    ids = [int(i) // 2 * 10 for i in range(120)]
    rows = list(zip(ids, v.tolist()))
    most = math.floor(math.sqrt(2.0**61 / 4))
    q = np.floor(np.clip(v * 1024, -most, most)).astype(np.int64)
    want = []
    for a in range(120):
        if ids[a] % 100 == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(q[a], q[b])), ids[b]) for b in range(120) if ids[b] != ids[a])[:10]
            want += [(ids[a], k + 1, b, -x) for k, (x, b) in enumerate(best)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_secrets(spark, docs, none):
    hexes, key = "0123456789abcdef0123456789abcdef", "AKIA" + "Z9Y8X7W6V5U4T3S2"
    texts = [f'é "PassWord" : "{"x" * 6}" and token=ab secret: token: abcdef99', f"{key} {key}A AKIAB {hexes} api_key='zzzzzzz'", None, "", "ſecret=abcdefg toKen=abcdef1", "a9Xk2Lq8Zr4Vt7Wn3Bm6Yp1Sd5 thiswordisquitelongbutordinary"]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert got[5].spans == "random:0:26"
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(none).count() == 0


def test_secrets_of_any_length_and_alphabet(spark):
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    base58 = "".join(c for c in low + up + digits if c not in "0OIl")
    r, rows = random.Random(3), []
    for alphabet in (digits, digits + "abcdef", low + "234567", up + "234567", low + digits, base58, low + up + digits, low + up + digits + "+/"):
        for n in (64, 80, 512, 513, 2000, 5000):
            made = ["".join(r.choices(alphabet, k=n)) for _ in range(40)]
            assert sum(secrets.battery(t) > (1.5 if len(alphabet) == 10 else 2) for t in made) >= 36, (alphabet, n)
            rows.append((len(rows), f"key {made[0]} end {'/'.join(prose(3, n + j).replace(' ', '_') for j in range(8))}"))
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {g.doc_id for g in got if any(x.startswith("random:4:") for x in g.spans.split(","))}
    assert len(got) == 48 and len(found) >= 44 and found >= {i for i in range(48) if i % 6 > 1}  # 64 or 80 characters of a small alphabet are weak evidence
    assert all(g.n_random <= 1 for g in got)  # paths of ordinary words are no discoveries


def test_false_discovery_control_by_hand(spark):
    """Every random token against weighted Benjamini-Hochberg over all candidates, in the bins that the docstring states."""
    r, rows = random.Random(5), []
    made = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=r.randint(20, 60))) for _ in range(60)]
    made += ["_".join(prose(6, 5000 + i).split()) for i in range(200)] + ["".join(prose(5, 6000 + i).split()) for i in range(60)]
    made = [t for t in made if len(t) >= 20]
    rows = [(i, t) for i, t in enumerate(made)]
    p = [secrets.battery(t) for t in made]
    mean = sum(map(len, made)) / len(made)
    bins = [min(6000, max(0, math.floor((x + math.log10(len(t) / mean)) * 20))) for x, t in zip(p, made)]
    cut = min((b for b in set(bins) if 10 ** (-b / 20) <= 0.01 * sum(x >= b for x in bins) / len(made)), default=None)
    want = {i for i, (x, t) in enumerate(zip(p, made)) if cut is not None and x + math.log10(len(t) / mean) >= cut / 20}
    got = {x.doc_id for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.n_random}
    assert got == want and len(want & set(range(60))) > 50 and len(want - set(range(60))) < 10


def test_normal_tails_and_quantiles():
    assert math.isclose(secrets.log_normal_tail(0), math.log(0.5)) and math.isclose(secrets.log_normal_tail(-1.959964), math.log(0.025), rel_tol=1e-5) and abs(secrets.log_normal_tail(-30.001) - secrets.log_normal_tail(-29.999)) < 0.1
    assert all(math.isclose(secrets.normal_quantile(secrets.log_normal_tail(z)), z, abs_tol=1e-2) for z in (-60, -40, -34, -20, -3, 0, 2))


def test_tail_is_binomial():
    for n in (19, 63, 400):
        for least in (0, 1, 2, n // 10, n // 6, n // 4, n // 2, n):
            want = sum(math.comb(n, k) * 0.15**k * 0.85 ** (n - k) for k in range(least, n + 1))
            assert math.isclose(math.exp(secrets.log_tail(n, least, 0.15)), want, rel_tol=1e-9)


def test_licenses(spark, docs, none):
    texts = ["Under the MIT License, or the mit\nlicense.", "x General Public LICENSE", None, "", "mit", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files, to deal in the Software without restriction", "MIT-License café apache  license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(LOW))
        places = [j for p, _ in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        labels = sorted({x for p, x in licenses.PHRASES if any(w[j : j + len(p.split())] == p.split() for j in range(len(w)))})
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert got[5].labels == "mit" and got[5].base_labels == "" and got[5].score >= 0.6
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0


def brute_spans(text, templates, share=0.6, near=3):
    """(template, share) of every verified span, by comparing all grams of the text with all grams of the templates."""
    words = lambda v: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", v.translate(LOW))
    grams = lambda w: [tuple(w[i : i + licenses.GRAM]) for i in range(len(w) - licenses.GRAM + 1)]
    held = [(label, grams(words(t))) for label, t in templates]
    d, out = grams(words(text)), []
    for n, (label, t) in enumerate(held):
        others = {g for other, grams_ in held if other != label for g in grams_}
        own = {j for j, g in enumerate(t) if g not in others}
        votes = {}
        for i, a in enumerate(d):
            for j, b in enumerate(t):
                if a == b:
                    votes.setdefault(i - j, set()).add(j)
        spans, last = [], None
        for k in sorted(votes):
            if last is None or k - last > near:
                spans.append(set())
            spans[-1] |= votes[k]
            last = k
        out += [(n, len(s) / len(t)) for s in spans if len(s) >= share * len(t) and 2 * len(s & own) >= len(own)]
    return sorted(out)


def test_license_spans_equal_brute_force(spark):
    rng, whole = random.Random(5), [t for _, t in licenses.TEMPLATES]
    texts = list(whole)
    for t in whole:
        w = t.split()
        edited = [x if rng.random() > 0.06 else "changed" for x in w]
        longer = [y for x in w for y in ([x, "between"] if rng.random() < 0.04 else [x])]
        texts += [" ".join(edited), "Some words before. " + " ".join(longer) + " And more after it.", " ".join(w[: len(w) // 2]), " ".join(rng.sample(w, len(w))), t + " " + t]
    texts += ["", "no license here", " ".join(whole)]
    rows = licenses.license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.TEMPLATES).collect()
    for i, text in enumerate(texts):
        assert sorted((r.template, r.share) for r in rows if r.doc_id == i) == brute_spans(text, licenses.TEMPLATES), (i, text)


#: Notices and the one label that a reader would give; written by hand.
NOTICES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("apache", "Copyright 2020 somebody. Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("", "The general terms of this public license are free software of the foundation."),
)


def test_one_label_a_notice_and_a_template(spark):
    """Every notice and every template's text has its own label alone, also between other prose and with a few words changed in a long one."""
    known = [*licenses.TEMPLATES, *licenses.whole_licenses()]
    assert {label for label, _ in licenses.whole_licenses()} == {"apache", "gpl", "lgpl", "mpl", "cc0"}
    cases = [*NOTICES, *known, *[(label, f"{prose(30, 41)} {t} {prose(30, 42)}") for label, t in (*NOTICES, *known)]]
    cases += [(label, " ".join("changed" if k % 40 == 39 else w for k, w in enumerate(t.split()))) for label, t in known if len(t.split()) > 60]
    cases += [("agpl,mit", f"{NOTICES[1][1]} {prose(9, 43)} {NOTICES[7][1]}")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    wrong = [(label, got[i].method_labels, text[:80]) for i, (label, text) in enumerate(cases) if got[i].method_labels != label]
    assert not wrong, wrong
    for r in got.values():
        assert set(r.labels.split(",")) == set(r.method_labels.split(",")) | set(r.base_labels.split(",")) - ({""} if r.method_labels else set()) or r.labels == ""
