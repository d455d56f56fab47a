"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Rates r minimise the sum of r ln r - r over documents under one token constraint a source, sum(r * size) = target,
and r <= cap. The convex dual has one multiplier a source: r = min(cap, exp(lambda * size / mean size)). Guarded
Newton steps solve it, each one aggregation over the (source, size) histogram. Copies come from rates by systematic
rounding in descending size (the error telescopes below half the largest size), then the words still missing or too
many are settled by adding or removing copies of smaller documents.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows are
separate documents; an empty table gives an empty result; documents of size 0 have no words to take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, source_key, word_count

#: Rows of one (source, size) are ranked in so many buckets, so that a large group of copies is not one task.
BUCKETS = 1024


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row a source: its size, and the target that weights give it, at most ``cap`` times its size (water-filling)."""
    per = sized.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everywhere = Window.partitionBy(F.lit(1))
    by_name = everywhere.orderBy(F.col("sk") == "0", "sk")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    fill = everywhere.orderBy("ratio", "sk")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("rn", F.row_number().over(fill))
    per = per.withColumn("level", (share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.col("rn"))).over(everywhere)
    per = per.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most"))))
    return per.select("sk", "source_size", "n_docs", "target", "most")


def solve_dual(hist: DataFrame, targets: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """targets with ``lam``, each source's multiplier, by Newton steps guarded by a bracket. Sums are decimal, so reruns agree."""
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    hist = hist.filter("size > 0")
    state = targets.withColumns({"lam": F.lit(0.0), "lo": F.lit(-1e9), "hi": F.lit(1e9)})
    for _ in range(steps):
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(F.lit(float(cap)), raw)
        tokens = F.col("n") * F.col("size") * rate
        exact = lambda c: F.sum(c.cast("decimal(30,6)")).cast("double")
        sums = hist.join(state.select("sk", "lam", "n_docs", "source_size"), "sk").groupBy("sk").agg(exact(tokens).alias("sum0"), exact(F.when(raw < cap, tokens * x).otherwise(0.0)).alias("sum1"))
        f, slope = F.coalesce("sum0", F.lit(0.0)) - F.col("target"), F.coalesce("sum1", F.lit(0.0))
        state = state.join(sums, "sk", "left").withColumns({"f": f, "slope": slope})
        state = state.withColumns({"lo": F.when(F.col("f") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")), "hi": F.when(F.col("f") > 0, F.least("hi", "lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.col("f") / F.col("slope")
        wide = F.when(F.col("f") < 0, F.col("lam") + 1 + F.abs("lam")).otherwise(F.col("lam") - 1 - F.abs("lam"))
        middle = F.when((F.col("lo") > -1e9) & (F.col("hi") < 1e9), (F.col("lo") + F.col("hi")) / 2).otherwise(wide)
        good = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 4 + 4 * F.abs("lam"))
        done = (F.abs("f") <= tolerance * F.col("target")) | (F.col("target") >= F.col("most")) | (F.col("source_size") == 0)
        state = state.withColumn("lam", F.when(done, F.col("lam")).when(good, newton).otherwise(middle)).withColumn("done", done)
        state = materialize(state.drop("sum0", "sum1"), "mix-dual")
        if state.filter(~F.col("done")).isEmpty():
            break
        state = state.drop("f", "slope", "done")
    return state.select("sk", "source_size", "n_docs", "target", "most", "lam")


def copies_by_size(hist: DataFrame, dual: DataFrame, cap: float, settle: int) -> DataFrame:
    """(sk, size, n, k, rate): k copies in all for the n documents of that source and size, near the target in words."""
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") >= F.col("most"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(50.0)))))
    h = hist.join(dual, "sk").withColumn("rate", rate)
    all_of, down = Window.partitionBy("sk"), Window.partitionBy("sk").orderBy(F.desc("size"))
    upto, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("c", F.sum(F.col("n") * F.col("rate")).over(upto))
    h = h.withColumn("k", (F.floor(F.col("c") + 0.5) - F.floor(F.coalesce(F.lag("c").over(down), F.lit(0.0)) + 0.5)).cast("long"))
    most = (F.col("n") * int(cap)).cast("long")
    h = h.withColumn("k", F.greatest(F.lit(0).cast("long"), F.least(F.col("k"), most)))
    for _ in range(settle):
        h = h.withColumn("gap", F.round(F.col("target")).cast("long") - F.sum(F.col("k") * F.col("size")).over(all_of))
        room = F.when((F.col("size") == 0) | (F.col("size") > F.abs("gap")), 0).when(F.col("gap") > 0, most - F.col("k")).otherwise(F.col("k"))
        h = h.withColumn("room", room.cast("long")).withColumn("sofar", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0)))
        take = F.when(F.col("room") > 0, F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("gap") - F.col("sofar")) / F.col("size"))))).otherwise(0).cast("long")
        h = h.withColumn("k", F.col("k") + F.signum("gap").cast("long") * take)
    return h.select("sk", "size", "n", "k", "rate", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", steps: int = 40, tolerance: float = 1e-7, settle: int = 5) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, rate; weights go round over the sources in code-point order."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("sk"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    hist = materialize(sized.groupBy("sk", "size").agg(F.count("*").alias("n")), "mix-histogram")
    targets = materialize(source_targets(hist.select("sk", (F.col("size") * F.col("n")).alias("size")).join(hist.groupBy("sk").agg(F.sum("n").alias("n_all")), "sk"), weights, share, cap), "mix-targets")
    targets = targets.drop("n_docs").join(hist.groupBy("sk").agg(F.sum("n").alias("n_docs")), "sk").select("sk", "source_size", "n_docs", "target", "most")
    dual = solve_dual(hist, targets, cap, steps, tolerance)
    plan = copies_by_size(hist, dual, cap, settle)
    keyed = sized.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    cells = keyed.groupBy("sk", "size", "b").agg(F.count("*").alias("cell")).join(plan, ["sk", "size"])
    before = Window.partitionBy("sk", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("extra", F.col("k") % F.col("n") - F.coalesce(F.sum("cell").over(before), F.lit(0))).withColumn("base", F.floor(F.col("k") / F.col("n")))
    rank = F.row_number().over(Window.partitionBy("sk", "size", "b").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    ranked = keyed.withColumn("rank", rank).join(cells.drop("cell", "n", "k"), ["sk", "size", "b"])
    copies = (F.col("base") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return ranked.withColumn("copies", copies).select("doc_id", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate", "sk")


def take_copies(docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row repeated as often as the plan of ``mix_sources`` takes it. Rows that agree in id, source and size share their copies by rank."""
    keys = ["mix_id", "mix_sk", "mix_size"]
    alike = Window.partitionBy(*keys)
    rows = docs.withColumns({"mix_id": F.col(id_col), "mix_sk": source_key(F.col(source_col)), "mix_size": word_count(F.col(text_col))})
    rows = rows.withColumn("mix_rank", F.row_number().over(alike.orderBy(F.col(text_col))))
    counts = plan.select(F.col("doc_id").alias("mix_id"), F.col("sk").alias("mix_sk"), F.col("size").alias("mix_size"), F.col("copies").alias("mix_copies")).withColumn("mix_rank", F.row_number().over(alike.orderBy(F.desc("mix_copies"))))
    same = (rows["mix_id"].eqNullSafe(counts["mix_id"])) & (rows["mix_sk"] == counts["mix_sk"]) & (rows["mix_size"] == counts["mix_size"]) & (rows["mix_rank"] == counts["mix_rank"])
    out = rows.join(counts, same).filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return out.select(*[rows[c] for c in docs.columns])
