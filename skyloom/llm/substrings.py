"""Removal of repeated byte strings: every byte covered by a LENGTH-byte string that starts at two or more places of the corpus.

The sorted suffixes and their common prefixes come from column-wise construction over many documents at once: in each round one symbol of
every document is put before what was inserted, and one sequential pass updates the collection's Burrows-Wheeler order and the common
prefixes of neighbours. A LENGTH-byte window is repeated where a neighbour shares LENGTH bytes.

So that this is a bounded job for a task, the documents of a construction are pieces of texts. Winnowing assigns each window the rightmost
least of its GRAM-byte hashes, its anchor. The anchor follows from the window's content, so equal windows have it at the same offset, and
a run of neighbouring windows shares one. The bytes that a run covers, at most WIDEST, are its piece. Pieces are aligned at their
anchors, so equal windows stand in one column, and a round orders the suffixes of its column alone.
  1. Runs that agree in all their bytes are one piece, whose windows are repeated; runs whose anchor hash occurs once are unique. These
     are aggregations that combine before the shuffle.
  2. The other pieces are dealt by anchor hash to buckets of about BUCKET pieces, each constructed in WIDEST rounds.
  3. An anchor with more than HOT different pieces is not one bucket: its windows go in classes of CLASS neighbours (not repeated where what all of
     them share is unique, repeated where all they cover occurs twice), and those left open one by one, by aggregations of hashes.
Texts that hold a repeated anchor are written apart once, so later steps read those only.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows are separate occurrences, each of them
loses what repeats; equal ids with different texts are separate; ids are cast to long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, prefix_hash, sub_hash, text_chunks

LENGTH, GRAM, CLASS = 400, 64, 16
#: Columns of a piece: as far as windows reach before their anchor, and as far as they reach from it.
BEFORE = LENGTH - GRAM
WIDEST = BEFORE + LENGTH
BUCKET, HOT = 8192, 4096
NO_BYTE = 256
SEGMENT = 1 << 19


def window_anchors(c: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """The anchor of each window start of n bytes (n < 2^20), from prefix hashes."""
    w = length - gram + 1
    at = np.arange(n - gram + 1)
    key = (sub_hash(c, at, at + gram) & np.uint64(MASK_HIGH)) | (np.uint64(LOW_BITS) - at.astype(np.uint64))
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(n - length + 1)
    least = np.minimum(after[starts], before[starts + w - 1])
    return (np.uint64(LOW_BITS) - (least & np.uint64(LOW_BITS))).astype(np.int64)


LOW_BITS = (1 << 20) - 1
MASK_HIGH = ((1 << 64) - 1) ^ LOW_BITS


def pieces(column):
    """(row, first byte, bytes with offsets of whole short texts, first and end of the anchors that are its own) for runs of texts, and
    for overlapping segments of texts beyond SEGMENT. A segment reaches as far as any window of its anchors, so no run of one is split."""
    for i, offsets, data in text_chunks(column, SEGMENT):
        if len(data) <= SEGMENT + LENGTH:
            yield i, 0, offsets, data, 0, len(data)
        else:
            for s in range(0, len(data) - GRAM + 1, SEGMENT):
                base = max(0, s - (LENGTH - GRAM))
                part = data[base : s + SEGMENT + LENGTH - 1]
                yield i, base, np.array([0, len(part)]), part, s - base, s - base + SEGMENT


def anchors(batches):
    """doc_id, th, p (anchor), lo and hi (first and last window start of its run), ah (anchor hash), ch (hash of all the run covers)."""
    for batch in batches:
        for i, base, offsets, data, least, end in pieces(batch.column(2)):
            if len(data) < LENGTH:
                continue
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            ok = row[: len(data) - LENGTH + 1] == row[LENGTH - 1 :]
            if not ok.any():
                continue
            c = prefix_hash(data)
            anchor = window_anchors(c, len(data), LENGTH, GRAM)
            new = ok.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1] | (row[1 : len(ok)] != row[: len(ok) - 1])
            last = ok.copy()
            last[:-1] &= (anchor[1:] != anchor[:-1]) | ~ok[1:] | (row[1 : len(ok)] != row[: len(ok) - 1])
            lo, hi = np.flatnonzero(new), np.flatnonzero(last)
            own = (anchor[lo] >= least) & (anchor[lo] < end)
            lo, hi = lo[own], hi[own]
            p = anchor[lo]
            ah = sub_hash(c, p, p + GRAM)
            ch = mix64(sub_hash(c, lo, hi + LENGTH) + (p - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = row[lo]
            shift = base - offsets[own]
            take = pa.array(own + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x + shift).astype(np.int32)) for x in (p, lo, hi)), pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64))], names=["doc_id", "th", "p", "lo", "hi", "ah", "ch"])


def spread(batch, column: int, *fields: str):
    """For each row: its bytes and, for its list of structs, one array a field."""
    for r in range(batch.num_rows):
        held = batch.column(column)[r].values
        yield r, np.frombuffer((batch.column(2)[r].as_py() or "").encode(), np.uint8), [held.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def repeat_rows(batch, rows: list[int], counts: list[int]):
    take = pa.array(np.repeat(rows, counts))
    return batch.column(0).take(take), batch.column(1).take(take)


def pieces_of(batches):
    """doc_id, th, p, lo, hi, c, ah and the bytes of each run."""
    for batch in batches:
        for r, data, (p, lo, hi, c, ah) in spread(batch, 3, "p", "lo", "hi", "c", "ah"):
            body = pa.array([data[s:e].tobytes() for s, e in zip(lo, hi + LENGTH)], pa.binary())
            yield pa.RecordBatch.from_arrays([*repeat_rows(batch, [r], [len(p)]), *(pa.array(x.astype(np.int32)) for x in (p, lo, hi)), pa.array(c), pa.array(ah), body], names=["doc_id", "th", "p", "lo", "hi", "c", "ah", "body"])


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of values[first..last]."""
    out = values[last]
    wide = np.flatnonzero(last > first)
    level, step = values, 1
    while len(wide):
        size = last[wide] - first[wide] + 1
        now = wide[size < 2 * step]
        out[now] = np.minimum(level[first[now]], level[last[now] - step + 1])
        wide = wide[size >= 2 * step]
        level = np.minimum(level[: len(level) - step], level[step:]) if len(wide) else level
        step *= 2
    return out


def column_wise(group: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each window column and piece: whether another piece of the group has the same LENGTH bytes there.

    columns[x] holds the symbols of column x, NO_BYTE where a piece has none. ``order`` is the order of the suffixes that begin in the
    column inserted last, group by group, and ``common`` what each shares with the one before it."""
    order = np.argsort(group, kind="stable")
    common = np.zeros(len(order), np.int32)
    repeated = np.zeros((BEFORE + 1, len(order)), bool)
    for x in range(WIDEST - 1, -1, -1):
        symbol = columns[x][order]
        key = group[order] * 512 + symbol
        move = np.argsort(key, kind="stable")
        key = key[move]
        equal = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 512 != NO_BYTE)) + 1
        new = np.zeros(len(order), np.int32)
        new[equal] = least_between(common, move[equal - 1] + 1, move[equal]) + 1
        order, common = order[move], new
        if x <= BEFORE:
            long = common >= LENGTH
            long[:-1] |= common[1:] >= LENGTH
            repeated[x, order[long]] = True
    return repeated


def repeated_windows(bucket: pa.Table) -> pa.Table:
    """doc_id, th, lo, hi: ranges of repeated window starts of the pieces that stand for one place only; the others are repeated as a whole."""
    bucket = bucket.combine_chunks()
    p, lo, hi, c, ah = (bucket[n].to_numpy() for n in ("p", "lo", "hi", "c", "ah"))
    rows = np.full((len(p), WIDEST), NO_BYTE, np.int16)
    for r, (body, at) in enumerate(zip(bucket["body"], lo - p + BEFORE)):
        body = np.frombuffer(body.as_buffer(), np.uint8)
        rows[r, at : at + len(body)] = body
    found = column_wise(np.unique(ah, return_inverse=True)[1].astype(np.int64), np.ascontiguousarray(rows.T)) & (c == 1)
    edge = np.zeros((len(p), BEFORE + 3), np.int8)
    edge[:, 1:-1] = found.T
    edge = np.diff(edge, axis=1)
    (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    take = pa.array(row)
    start = p[row] - BEFORE
    return pa.table({"doc_id": bucket["doc_id"].take(take), "th": bucket["th"].take(take), "lo": pa.array((start + first).astype(np.int32)), "hi": pa.array((start + last - 1).astype(np.int32))})


def classes(batches):
    """Level 1: doc_id, th, lo and hi of each class, c, and the hashes of what its windows share and of what they cover."""
    for batch in batches:
        rows, counts, out = [], [], []
        for r, data, (p, lo, hi, c) in spread(batch, 3, "p", "lo", "hi", "c"):
            h = prefix_hash(data)
            first, last = (p - hi) // CLASS, (p - lo) // CLASS
            k = last - first + 1
            j = np.repeat(first, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            q = np.repeat(p, k)
            early, late = q - (j * CLASS + CLASS - 1), q - j * CLASS
            core = sub_hash(h, late, early + LENGTH) + j.astype(np.uint64)
            inside = (early >= 0) & (late + LENGTH <= len(data))
            a, b = np.where(inside, early, 0), np.where(inside, late + LENGTH, 1)
            union = sub_hash(h, a, b) + j.astype(np.uint64)
            rows.append(r)
            counts.append(len(j))
            out.append((np.maximum(early, np.repeat(lo, k)), np.minimum(late, np.repeat(hi, k)), np.repeat(c, k), mix64(core).view(np.int64), mix64(union).view(np.int64), ~inside))
        if rows:
            lo, hi, c, core, union, none = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([*repeat_rows(batch, rows, counts), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(c), pa.array(core), pa.array(union, mask=none)], names=["doc_id", "th", "lo", "hi", "c", "core", "cover"])


def windows(batches):
    """Level 2: doc_id, th, start, c, hash of each window."""
    for batch in batches:
        rows, counts, out = [], [], []
        for r, data, (lo, hi, c) in spread(batch, 3, "lo", "hi", "c"):
            h = prefix_hash(data)
            k = hi - lo + 1
            s = np.repeat(lo, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            rows.append(r)
            counts.append(len(s))
            out.append((s, np.repeat(c, k), sub_hash(h, s, s + LENGTH).view(np.int64)))
        if rows:
            s, c, h = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([*repeat_rows(batch, rows, counts), pa.array(s.astype(np.int32)), pa.array(c), pa.array(h)], names=["doc_id", "th", "start", "c", "h"])


def digests(batches):
    for batch in batches:
        out = []
        for _, data, (lo, hi) in spread(batch, 3, "lo", "hi"):
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "th", "n_removed", "n_spans", "kept_sha256"])


def by_text(rows: DataFrame, texts: DataFrame, *fields: str) -> DataFrame:
    """doc_id, th, text and the rows' fields as a list, for each text that has rows."""
    lists = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("held"))
    same = texts["doc_id"].eqNullSafe(lists["doc_id"]) & (texts["th"] == lists["th"])
    return texts.join(lists, same).select(texts["doc_id"], texts["th"], "text", "held")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    found = materialize(texts.mapInArrow(anchors, "doc_id long, th long, p int, lo int, hi int, ah long, ch long"), "repeat-anchors")
    runs = found.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "p", "lo", "hi")).alias("at"))
    totals = runs.groupBy("ah").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    runs = materialize(runs.join(totals, "ah"), "repeat-runs")
    whole = found.join(runs.filter("c > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("doc_id", "th", "lo", "hi")
    open_runs = runs.filter("kinds > 1").select("at.*", "c", "ah", "kinds")
    wanted = whole.select("doc_id", "th").union(open_runs.select("doc_id", "th")).distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    some = materialize(texts.join(wanted, same(texts, wanted), "left_semi").dropDuplicates(["doc_id", "th"]), "repeat-texts")
    bounded, hot = open_runs.filter(F.col("kinds") <= HOT), open_runs.filter(F.col("kinds") > HOT)
    pieces = by_text(bounded, some, "p", "lo", "hi", "c", "ah").mapInArrow(pieces_of, "doc_id long, th long, p int, lo int, hi int, c long, ah long, body binary")
    buckets = -(-bounded.count() // BUCKET) or 1
    level0 = materialize(pieces.withColumn("bucket", F.pmod(F.xxhash64("ah"), F.lit(buckets))).groupBy("bucket").applyInArrow(repeated_windows, "doc_id long, th long, lo int, hi int"), "repeat-columns")
    parts = materialize(by_text(hot, some, "p", "lo", "hi", "c").mapInArrow(classes, "doc_id long, th long, lo int, hi int, c long, core long, cover long"), "repeat-classes")
    cores = parts.groupBy("core").agg(F.sum("c").alias("shared"), (F.count("*") == F.count("cover")).alias("covered"), F.min("cover").alias("least"), F.max("cover").alias("most")).filter("shared > 1")
    covers = parts.filter("cover is not null").groupBy("cover").agg(F.sum("c").alias("times")).filter("times > 1")
    parts = materialize(parts.join(cores, "core").join(covers, "cover", "left"), "repeat-shared")
    level1 = parts.filter("c = 1 and times > 1").select("doc_id", "th", "lo", "hi")
    left = parts.filter("not (covered and least = most)").select("doc_id", "th", "lo", "hi", "c")
    single = materialize(by_text(left, some, "lo", "hi", "c").mapInArrow(windows, "doc_id long, th long, start int, c long, h long"), "repeat-windows")
    twice = single.groupBy("h").agg(F.sum("c").alias("times")).filter("times > 1").select("h")
    level2 = single.filter("c = 1").join(twice, "h", "left_semi").select("doc_id", "th", F.col("start").alias("lo"), F.col("start").alias("hi"))
    gone = whole.union(level0).union(level1).union(level2)
    cut = by_text(gone, some, "lo", "hi").mapInArrow(digests, "doc_id long, th long, n_removed long, n_spans long, kept_sha256 string")
    facts = texts.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return facts.join(cut, same(facts, cut), "left").select(facts["doc_id"], "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
