"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

Two collections of HALVES short keys (ROWS minima each) are computed for every set; a table key joins one key of either
collection, so HALVES * HALVES tables of 2 * ROWS minima take 2 * HALVES * ROWS minima in all. At the threshold of 0.85 a pair
misses every table with a chance of 8e-7, at 0.80 with one of 5e-5. Half keys that no other set holds are dropped before they are combined.

Equal sets (128 bits of hash) are one node. Links come in two rounds, both confirmed on full sets:
  1. every set with the head that shares most of its half keys, which links most copies with one comparison a set;
  2. half keys that still span several components are combined into tables; sets that meet in tables are a family, and every member
     outside its family's largest component is compared with all members. Families beyond FAMILY members are taken table by table.
Comparisons are made in blocks, each a bounded number of sets and shingles on either side: a hot head, family or table is many
blocks. A block counts common shingles for all its pairs at once and gives back only links that join components, so neither pairs
nor texts of pairs are ever rows.

Defined results: a text without words (or null) has an empty set, is linked with nothing and kept; fewer words than a
shingle are one shingle; repeated rows are equal sets, so one component; a null id is never a component's name unless
nothing else is; ids are cast to long; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialize, mix64, text_chunks, word_hashes
from .graph import components

HALVES, ROWS = 20, 4
MINIMA = 2 * HALVES * ROWS
#: Families up to so many sets are compared whole, larger ones table by table. Either way every pair that meets in a table is compared.
FAMILY = 20_000
#: Sets and shingles on one side of a block.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1 << 20
#: Sets whose texts are fetched by a broadcast, beyond by a shuffle.
BROADCAST_SETS = 200_000
#: Signatures are alike that are within so many standard deviations of a pair at the threshold; others wait for the second round.
DEVIATIONS = 5.3
SEEDS = mix64(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
XOR, ODD = SEEDS[:MINIMA], SEEDS[MINIMA:] | np.uint32(1)


def least_alike(percent: int) -> int:
    """Equal minima, of MINIMA, that a pair at the threshold has almost surely."""
    p = percent / 100
    return max(0, math.floor(MINIMA * p - DEVIATIONS * math.sqrt(MINIMA * p * (1 - p))))


def shingle_sets(column, k: int):
    """(first row, list of sorted distinct shingle hashes of each row) chunk by chunk."""
    for i, offsets, data in text_chunks(column):
        words, first = word_hashes(data, offsets)
        grams = gram_hashes(words, k)
        out = []
        for s, e in zip(first[:-1], first[1:]):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            else:
                out.append(gram_hashes(words[s:e], e - s) if e > s else np.zeros(0, np.uint64))
        yield i, out


def as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit hashes as one Arrow column of lists."""
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def sketch(k: int):
    """id, text hash, n_shingles, set_id and check (together the set's 128-bit hash) and half keys: each packs ROWS minima of 16 bits, so
    together they are the signature."""

    def run(batches):
        for batch in batches:
            for i, sets in shingle_sets(batch.column(2), k):
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                set_ids, checks = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                minima = np.zeros((len(sets), MINIMA), np.uint16)
                if len(full):
                    h = np.concatenate([sets[r] for r in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    set_ids[full] = mix64(np.add.reduceat(mix64(h.copy()), starts) + sizes[full].astype(np.uint64)).view(np.int64)
                    checks[full] = np.add.reduceat(mix64(h ^ np.uint64(0xD6E8FEB86659FD93)), starts).view(np.int64)
                    low = (h >> np.uint64(32)).astype(np.uint32)
                    least = np.stack([np.minimum.reduceat((low ^ x) * a, starts) for x, a in zip(XOR, ODD)], axis=1)
                    minima[full] = (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 2 * HALVES, pa.int32()), pa.array(minima.view(np.int64).reshape(-1)))
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), batch.column(1).slice(i, len(sets)), pa.array(sizes.astype(np.int64)), pa.array(set_ids, mask=empty), pa.array(checks, mask=empty), lists], names=["doc_id", "th", "n", "set_id", "check", "halves"])

    return run


def shingles(k: int):
    """(node, text) to (node, set)."""

    def run(batches):
        for batch in batches:
            for i, sets in shingle_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), as_lists(sets)], names=["node", "set"])

    return run


def alike(batches):
    """a, b, n_b and the number of equal minima of two signatures."""
    for batch in batches:
        c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        x, y = (np.ascontiguousarray(c[s].flatten().to_numpy()).view(np.uint16).reshape(-1, MINIMA) for s in ("halves_a", "halves_b"))
        yield pa.RecordBatch.from_arrays([c["a"], c["b"], c["n_b"], pa.array((x == y).sum(axis=1).astype(np.int32))], names=["a", "b", "n_b", "alike"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets. Shingles held by many sets on both sides go through a matrix product, the others are paired one by one."""
    out = np.zeros(len(left) * len(right), np.float32)
    sides = []
    vocabulary = np.intersect1d(*(np.unique(np.concatenate(s)) for s in (left, right)), assume_unique=True)
    for side in (left, right):
        values, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(vocabulary, values)
        held = np.flatnonzero(np.append(vocabulary, 0)[at] == values) if len(vocabulary) else np.zeros(0, np.int64)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], owner[held][order], np.bincount(at[held], minlength=len(vocabulary))))
    (token, one, n_one), (token2, two, n_two) = sides
    dense = n_one * n_two > max(64, len(out) // 64)
    columns = np.flatnonzero(dense)
    place = np.cumsum(dense) - 1
    for c in range(0, len(columns), 2048):
        part = []
        for t, owner, rows in ((token, one, len(left)), (token2, two, len(right))):
            m = np.zeros((rows, min(2048, len(columns) - c)), np.float32)
            mine = np.flatnonzero(dense[t] & (place[t] >= c) & (place[t] < c + 2048))
            m[owner[mine], place[t[mine]] - c] = 1
            part.append(m)
        out += (part[0] @ part[1].T).reshape(-1)
    mine = np.flatnonzero(~dense[token])
    begins, times = (np.cumsum(n_two) - n_two)[token[mine]], n_two[token[mine]]
    upto = np.cumsum(times)
    for lo, hi in chunks_of(upto, 1 << 22):
        t, n = mine[lo:hi], times[lo:hi]
        at = np.repeat(begins[lo:hi], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(one[t], n) * len(right) + two[at], minlength=len(out)).astype(np.float32)
    return out.reshape(len(left), len(right)).astype(np.int64)


def chunks_of(upto: np.ndarray, most: int):
    """Ranges of positions with a sum of at most ``most`` (one position at least), from running sums."""
    lo, before = 0, 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, "right")))
        yield lo, hi
        lo, before = hi, int(upto[hi - 1])


def joined(percent: int):
    """One block: of the pairs of its two sides with 100 * intersection >= percent * union, those that join components, as (a, b)."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        side, node, comp = (block[c].to_numpy() for c in ("side", "node", "comp"))
        sets = [s.values.to_numpy().view(np.uint64) for s in block["set"]]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(one) and len(two):
            n = np.array([len(s) for s in sets])
            both = common_counts([sets[i] for i in one], [sets[i] for i in two])
            linked = (100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)) & (comp[one][:, None] != comp[two][None, :])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            for r in np.flatnonzero(linked.any(axis=1)):
                met = two[linked[r]]
                for at in np.unique(comp[met], return_index=True)[1]:
                    x, y = root(int(comp[one[r]])), root(int(comp[met[at]]))
                    if x != y:
                        parent[x] = y
                        a.append(node[one[r]])
                        b.append(node[met[at]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_id, th (text hash) for every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = materialize(texts.mapInArrow(sketch(k), "doc_id long, th long, n long, set_id long, check long, halves array<long>"), "near-sketches")
    sets = rows.filter("set_id is not null").groupBy("set_id", "check").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "near-sets")
    halves = sets.select("node", F.posexplode("halves").alias("half", "key"))
    heads = halves.groupBy("half", "key").agg(F.count("*").alias("c"), F.min("node").alias("head")).filter("c > 1").select("half", "key", "head")
    shared = materialize(halves.join(heads, ["half", "key"]), "near-halves")

    def linked(places: DataFrame) -> DataFrame:
        """Links found in blocks, from (kind, g, i, j, side, node, comp)."""
        nodes = materialize(places.select("node").distinct(), "near-nodes")
        wanted = nodes.join(sets.select("node", "at.*"), "node").withColumnRenamed("doc_id", "at_id").withColumnRenamed("th", "at_th")
        wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST_SETS else wanted
        fetched = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["at_id"]) & (texts["th"] == wanted["at_th"])).select("node", "text")
        fetched = materialize(fetched.mapInArrow(shingles(k), "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set")), "near-shingles")
        return materialize(places.join(fetched, "node").groupBy("kind", "g", "i", "j").applyInArrow(joined(percent), "a long, b long"), "near-links")

    def dealt(node: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")

    def blocks_for(sets: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).alias("blocks")

    def all_of(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))

    # first round: each set with one head
    met = shared.filter("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))
    best = met.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a"))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("halves").alias(f"halves_{c}"))
    sized = best.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = materialize(sized.mapInArrow(alike, "a long, b long, n_b long, alike int").filter(F.col("alike") >= least_alike(percent)).select("a", "b", "n_b"), "near-pairs")
    loads = pairs.groupBy("a").agg(blocks_for(F.count("*"), F.sum("n_b")))
    place = lambda df, side, node, comp, *keys: df.select(*keys, F.lit(side).alias("side"), F.col(node).alias("node"), F.col(comp).alias("comp"))
    keys = (F.lit(0).alias("kind"), F.col("a").alias("g"), F.col("i"), F.lit(0).alias("j"))
    members = pairs.join(loads, "a").withColumn("i", dealt("b", "blocks"))
    checked = linked(place(loads.withColumn("i", all_of("blocks")), 0, "a", "a", *keys).union(place(members, 1, "b", "b", *keys)))

    # second round: families of tables that span components
    comps = components(checked)
    named = shared.select("node", "half", "key").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = lambda df, *keys: df.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(*keys, "lo")
    still = named.join(mixed(named, "half", "key"), ["half", "key"])
    of = lambda first: F.collect_list(F.when((F.col("half") < HALVES) if first else (F.col("half") >= HALVES), F.struct("half", "key")))
    own = still.groupBy("node", "component").agg(of(True).alias("one"), of(False).alias("two"))
    tables = own.select("node", "component", F.explode("one").alias("x"), "two").select("node", "component", "x", F.explode("two").alias("y"))
    tables = materialize(tables.select("node", "component", F.xxhash64("x", "y").alias("table")), "near-tables")
    tables = materialize(tables.join(mixed(tables, "table"), "table"), "near-open")
    held = tables.select("node", "component").distinct()
    families = components(tables.select(F.col("lo").alias("a"), F.col("component").alias("b")).filter("a <> b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("family"))
    placed = held.join(families, "component")
    placed = placed.join(placed.groupBy("family").agg((F.count("*") > FAMILY).cast("int").alias("kind")), "family")
    whole = placed.filter("kind = 0").select("kind", F.col("family").alias("g"), "node", "component")
    by_table = placed.filter("kind = 1").join(tables.select("node", "table"), "node").select("kind", F.col("table").alias("g"), "node", "component")
    held = materialize(whole.union(by_table).join(sets.select("node", "n"), "node"), "near-families")
    parts = held.groupBy("kind", "g", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    groups = parts.groupBy("kind", "g").agg(F.max_by("component", F.struct("c", "component")).alias("main"), blocks_for(F.sum("c"), F.sum("w")))
    held = held.join(groups, ["kind", "g"]).withColumn("at", dealt("node", "blocks")).withColumn("each", all_of("blocks"))
    keys = (F.col("kind"), F.col("g"))
    asked = place(held.filter("component <> main"), 0, "node", "component", *keys, F.col("at").alias("i"), F.col("each").alias("j"))
    among = place(held, 1, "node", "component", *keys, F.col("each").alias("i"), F.col("at").alias("j"))
    more = linked(materialize(asked.union(among), "near-places"))

    comps = components(checked.union(more))
    by_comp = sets.select("node", "set_id", "check", "first_id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = by_comp.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = by_comp.join(least, "component").select("set_id", "check", "component_id")
    out = rows.select("doc_id", "th", F.col("n").alias("n_shingles"), "set_id", "check").join(by_set, ["set_id", "check"], "left").withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "set_id", "th")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 85, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id. Rows without words stay; equal rows of one id are one."""
    kept = near_duplicates(docs, k, percent, id_col=id_col, text_col=text_col).filter("kept and set_id is not null").select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th")).distinct()
    rows = docs.withColumn("near_th", F.xxhash64(text_col))
    full = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = rows[id_col].cast("long").eqNullSafe(kept["kept_id"]) & (rows["near_th"] == kept["kept_th"])
    out = rows.filter(full).join(kept, same, "left_semi").dropDuplicates([id_col, "near_th"])
    return out.unionByName(rows.filter(~full)).select(*docs.columns)
