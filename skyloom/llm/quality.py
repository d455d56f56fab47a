"""Quality classifier by co-training of two views: the text's content and the page's metadata.

Content: shares of character classes, word lengths, repetition of words and word pairs, and signed hashes of words and word pairs. Metadata:
recorded length, and the log-odds of good among the labelled training documents of the same source and of the same language. Every
value of these is a category of its own, null too; their table is computed by Spark and joined, so their number has no bound.
Each view is a regularised logistic model. Round 0 fits both on labelled documents; in later rounds each view also learns from
unlabelled documents, by the confident labels of the other view's model of the round before. Every Newton step is one pass over the
feature table: partitions send partial gradients and Hessians, Spark sums them, and the driver solves a system whose size is
fixed by the number of features. All labelled and all confident rows take part, but for two folds of ten that train nothing: fold 0
calibrates and combines the views, fold 1 measures accuracy (``held_out``). All documents are scored.

Defined results: a null text is empty; a document with several labels takes their mean, at least half counting as good; a score of
exactly ``least`` is kept; repeated rows are scored alike; ids are cast to long; a category without labelled documents says nothing; with no labels
every score is the prior of 0.5 (kept); empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, materialize, mix64, source_key, text_chunks, word_hashes

ROUNDS, STEPS, CONFIDENT, PSEUDO_WEIGHT, RIDGE = 3, 4, 0.97, 0.3, 1.0
CLASSES = np.zeros((256, 8), np.float64)
for _b in range(256):
    CLASSES[_b] = [0x41 <= _b <= 0x5A, 0x61 <= _b <= 0x7A, 0x30 <= _b <= 0x39, IS_SPACE[_b], _b >= 0x80, _b in b".,;:'\"-()?", _b in b"#$%&*|!@^~<>={}[]\\/+_", _b in b"\n"]
SHAPE, HASHED = 1 + 8 + 7, 64
CONTENT, METADATA = SHAPE + HASHED, 10
#: Labelled documents' worth of the overall share that each category's share is mixed with.
SMOOTH = 4.0
BROADCAST_CATEGORIES = 100_000
SIZES = (CONTENT, METADATA, 3)


def content_features(column) -> np.ndarray:
    """One row a text."""
    out = []
    for _, offsets, data in text_chunks(column):
        words, first = word_hashes(data, offsets)
        for r in range(len(offsets) - 1):
            own, body = words[first[r] : first[r + 1]], data[offsets[r] : offsets[r + 1]]
            n, size = len(own), max(1, len(body))
            share = np.bincount(body, minlength=256) @ CLASSES / size
            _, counts = np.unique(own, return_counts=True)
            pairs = len(np.unique(own[:-1] * np.uint64(3) + own[1:])) if n > 1 else 1
            extra = [np.log1p(n) / 5, np.log(max(1, size) / max(1, n)) - 1.7, len(counts) / max(1, n), counts.max(initial=0) / max(1, n), pairs / max(1, n - 1), float(n < 8), np.sqrt(share[6])]
            tokens = mix64(np.concatenate([own, own[:-1] * np.uint64(3) + own[1:]]))
            signs = np.where(tokens >> np.uint64(63), 1.0, -1.0)
            hashed = np.bincount((tokens & np.uint64(HASHED - 1)).astype(np.int64), signs, HASHED)
            out.append([1.0, *np.sqrt(share), *extra, *(hashed / np.sqrt(max(1, len(tokens))))])
    return np.array(out, np.float32).reshape(-1, CONTENT)


def metadata_features(source_odds, lang_odds, n_chars) -> np.ndarray:
    """From Arrow columns: log-odds of source and language (null: unknown) and the recorded length."""
    out = np.zeros((len(n_chars), METADATA), np.float32)
    out[:, 0] = 1
    n = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    log = np.where(n >= 0, np.log1p(np.where(n >= 0, n, 0)), 0)
    out[:, 1], out[:, 2] = np.where(n >= 0, log / 8 - 1, 0), np.isnan(n)
    for j, bend in enumerate((4, 6, 8)):
        out[:, 3 + j] = np.maximum(0, log - bend) / 4
    for j, odds in enumerate((source_odds, lang_odds)):
        x = odds.to_numpy(zero_copy_only=False)
        out[:, 6 + 2 * j], out[:, 7 + 2 * j] = np.nan_to_num(x), np.isnan(x)
    return out


def features(batches):
    """doc_id, fold and both views' features, from (doc_id, fold, text, source odds, lang odds, n_chars)."""
    for batch in batches:
        a, b = content_features(batch.column(2)), metadata_features(*(batch.column(k) for k in (3, 4, 5)))
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(a), lists(b)], names=["doc_id", "fold", "content", "metadata"])


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    both: np.ndarray

    def logits(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        za, zb = np.clip(a @ self.content, -20, 20), np.clip(b @ self.metadata, -20, 20)
        return za, zb, np.stack([np.ones_like(za), za, zb], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def arrays(batch):
    a = batch.column(batch.schema.get_field_index("content")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, CONTENT)
    b = batch.column(batch.schema.get_field_index("metadata")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, METADATA)
    return a, b


def partial_sums(model: Model, teacher: Model | None, calibrate: bool):
    """Gradients and Hessians of a partition, as (place, value) rows."""

    def run(batches):
        sums = [np.zeros((p, p + 1)) for p in SIZES]
        for batch in batches:
            a, b = arrays(batch)
            y = batch.column(batch.schema.get_field_index("good")).to_numpy(zero_copy_only=False).astype(np.float64)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            known = ~np.isnan(y)
            za, zb, both = model.logits(a, b)
            train = known & (fold > 1)
            if calibrate:
                tasks = [(2, both, np.where(known & (fold == 0), 1.0, 0.0), np.nan_to_num(y), model.both)]
            else:
                weights, targets = [train * 1.0, train * 1.0], [np.nan_to_num(y), np.nan_to_num(y)]
                if teacher:
                    ta, tb, _ = teacher.logits(a, b)
                    for view, z in ((0, tb), (1, ta)):  # each view learns from the other
                        p = sigmoid(z)
                        sure = ~known & (np.maximum(p, 1 - p) >= CONFIDENT)
                        weights[view] = weights[view] + PSEUDO_WEIGHT * sure
                        targets[view] = np.where(sure, p >= 0.5, targets[view])
                tasks = [(0, a, weights[0], targets[0], model.content), (1, b, weights[1], targets[1], model.metadata)]
            for k, x, w, t, theta in tasks:
                p = sigmoid(x @ theta)
                sums[k][:, 0] += x.T @ (w * (t - p))
                sums[k][:, 1:] += (x * (w * p * (1 - p))[:, None]).T @ x
        flat = np.concatenate([s.reshape(-1) for s in sums])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["place", "value"])

    return run


def newton(table: DataFrame, model: Model, teacher: Model | None, calibrate: bool) -> Model:
    """One Newton step; the driver gets a number of sums that the features fix."""
    flat = np.zeros(sum(p * (p + 1) for p in SIZES))
    for r in table.mapInArrow(partial_sums(model, teacher, calibrate), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        flat[r["place"]] = r["value"]
    new, at = [], 0
    for p, theta in zip(SIZES, (model.content, model.metadata, model.both)):
        s = flat[at : at + p * (p + 1)].reshape(p, p + 1)
        at += p * (p + 1)
        if s[:, 1:].any():
            prior = np.array([0.0, 1.0, 0.0]) if p == 3 else np.zeros(p)
            step = np.linalg.solve(s[:, 1:] + RIDGE * np.eye(p), s[:, 0] - RIDGE * (theta - prior))
            theta = np.round(theta + np.clip(step, -8, 8), 9)
        new.append(theta)
    return Model(*new)


def train(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """The co-trained model from a table of features with ``good`` (null where unlabelled)."""
    model, teacher = Model(np.zeros(CONTENT), np.zeros(METADATA), np.array([0.0, 1.0, 0.0])), None
    for r in range(rounds + 1):
        for _ in range(STEPS + 2 * (r == 0)):
            model = newton(table, model, teacher, False)
        teacher = model
    for _ in range(STEPS):
        model = newton(table, model, None, True)
    return model


def scores(model: Model):
    def run(batches):
        for batch in batches:
            za, zb, both = model.logits(*arrays(batch))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sigmoid(za)), pa.array(sigmoid(zb)), pa.array(sigmoid(both @ model.both)), batch.column(batch.schema.get_field_index("fold")), batch.column(batch.schema.get_field_index("good"))], names=["doc_id", "p_content", "p_metadata", "score", "fold", "good"])

    return run


def keep_rows(model: Model, least: float):
    """Whole rows (a struct) whose score reaches ``least``."""

    def run(batches):
        for batch in batches:
            text, *metadata = (batch.column(k) for k in range(1, 5))
            _, _, both = model.logits(content_features(text).astype(np.float64), metadata_features(*metadata).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sigmoid(both @ model.both) >= least))], names=["quality_row"])

    return run


def good_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    return labels.filter(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("good"))


def category_odds(docs: DataFrame, known: DataFrame, id_col: str, columns: dict[str, str]) -> dict[str, DataFrame]:
    """For each column name a table (key, odds): the smoothed log-odds of good among labelled documents of the training folds."""
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[source_key(F.col(c).cast("string")).alias(n) for n, c in columns.items()])
    rows = keys.join(known, "doc_id").filter(fold_of("doc_id") > 1)
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("key")) for n in columns]))
    table = materialize(rows.select("good", kinds.alias("k")).groupBy("k.kind", "k.key").agg(F.sum("good").alias("good"), F.count("*").alias("n")), "quality-categories")
    good, n = table.groupBy("kind").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).select("good", "n").first() or (0.0, 0)
    prior = (good + 1) / (n + 2)
    odds = F.log((F.col("good") + SMOOTH * prior) / (F.col("n") - F.col("good") + SMOOTH * (1 - prior)))
    out = {}
    for name in columns:
        part = table.filter(F.col("kind") == name).select(F.col("key").alias(f"quality_{name}"), odds.alias(f"quality_{name}_odds"))
        out[name] = F.broadcast(part) if part.count() <= BROADCAST_CATEGORIES else part
    return out


def fold_of(c: str):
    return F.pmod(F.xxhash64(c), F.lit(10)).cast("int")


def with_odds(rows: DataFrame, odds: dict[str, DataFrame]) -> DataFrame:
    for name, part in odds.items():
        rows = rows.join(part, f"quality_{name}", "left")
    return rows


def prepared(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", label_col: str = "quality"):
    """(rows with the inputs of both views beside the whole row, labels)."""
    known = materialize(good_labels(labels, label_col), "quality-labels")
    columns = {"source": source_col, "lang": lang_col}
    odds = category_odds(docs, known, id_col, columns)
    rows = docs.select(F.struct("*").alias("quality_row"), F.col(id_col).cast("long").alias("quality_id"), F.col(text_col).alias("quality_text"), F.col(length_col).cast("long").alias("quality_length"), *[source_key(F.col(c).cast("string")).alias(f"quality_{n}") for n, c in columns.items()])
    return with_odds(rows, odds), known


INPUTS = ("quality_text", "quality_source_odds", "quality_lang_odds", "quality_length")


def feature_table(rows: DataFrame, known: DataFrame) -> DataFrame:
    made = rows.select(F.col("quality_id").alias("doc_id"), fold_of("quality_id"), *INPUTS).mapInArrow(features, "doc_id long, fold int, content array<float>, metadata array<float>")
    return materialize(made.join(known, "doc_id", "left"), "quality-features")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **columns: str) -> DataFrame:
    """doc_id, p_content, p_metadata, score, kept, fold, good for every row."""
    table = feature_table(*prepared(docs, labels, **columns))
    scored = table.mapInArrow(scores(train(table)), "doc_id long, p_content double, p_metadata double, score double, fold int, good double")
    return scored.withColumn("kept", F.col("score") >= least)


def held_out(classified: DataFrame) -> DataFrame:
    """One row: n labelled documents of fold 1, which neither trained nor calibrated, and the accuracy of the views and of both together on them."""
    right = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("good") >= 0.5)).cast("double"))
    return classified.filter("fold = 1 and good is not null").agg(F.count("*").alias("n"), right("p_content").alias("content"), right("p_metadata").alias("metadata"), right("score").alias("both"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows that the classifier rejects. Features are computed again for the decision: that costs less than a shuffle of all texts."""
    rows, known = prepared(docs, labels)
    model = train(feature_table(rows, known))
    return rows.select("quality_row", *INPUTS).mapInArrow(keep_rows(model, least), rows.select("quality_row").schema).select("quality_row.*")
