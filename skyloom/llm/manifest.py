"""Merkle manifest of a dataset by sibling-shift self-joins; DataFrame functions only.

Leaves ascend by id within a group; every ``arity`` consecutive nodes (the last run may hold fewer, even one) become the hash of their digests.
A level is a table of (group, idx, n, digest). Its nodes are joined with their siblings by equality of computed indices: idx XOR 1 for binary
trees, otherwise slot offsets 1 to arity - 1 within the run. Each node thereby holds its siblings' digests, and the nodes of slot zero
emit the parents. A group is done when it has one node, its subroot; the subroots, in order of their groups, are the leaves of an upper tree
that is built in the same way. Proofs come down again: a node's path is its siblings before its parent's path, joined on the parent's index.

Scale: leaves are numbered by range partitions and offsets of counts, so no group is sorted in one task; keys of the joins are (group, idx),
which a large group does not skew; every level is written to the shared folder, all levels together hold at most two rows a leaf for
binary trees (the text is read once, for its hash).

Defined results: null values of a field are "-"; null ids come first; rows of one id are ordered by their leaves, so repeated rows have proofs
of their own places; a null group is a group of its own, and the first; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, source_key

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MOST_ARITY = 100


def framed(value: Column) -> Column:
    """A field of a leaf: its UTF-8 byte count, a colon and the value; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    """Binary sha256 of the parts' concatenation."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(digest: Column) -> Column:
    """A digest as lowercase hex, as it enters further hashes."""
    return F.lower(F.hex(digest))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``idx``, the place within its group by ``order``, and ``n``, the group's size; the groups are dealt by ranges."""
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    rows = materialize(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "numbered")
    counts = rows.groupBy(group, "part").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    w = Window.partitionBy(group)
    offsets = counts.select(group, "part", "first", F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(w).alias("n"))
    return rows.join(offsets, [group, "part"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Each node of (group, idx, n, digest) with ``siblings``: one byte for its own slot, then the other digests of its run in order."""
    slot = F.col("idx") % arity
    side = lambda j: nodes.select("group", F.col("idx").alias(f"at{j}"), F.col("digest").alias(f"d{j}"))
    out, offsets = nodes, range(1, arity)
    for j in offsets:
        index = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + j) % arity
        out = out.withColumn(f"at{j}", index).join(side(j), ["group", f"at{j}"], "left")
    empty = F.lit(b"")
    at_slot = lambda s: F.coalesce(*[F.when((slot + j) % arity == s, F.col(f"d{j}")) for j in offsets], empty)
    slot_byte = F.unhex(F.lpad(F.hex(slot), 2, "0"))
    return out.select("group", "idx", "n", "digest", F.concat(slot_byte, *[at_slot(s) for s in range(arity)]).alias("siblings"))


def around(run: Column, middle: Column) -> Column:
    """The digests of a run as text, with ``middle`` in the node's own place."""
    left = F.conv(F.hex(F.substring(run, 1, 1)), 16, 10).cast("int") * 32
    return F.concat(text_of(F.substring(run, F.lit(2), left)), middle, text_of(F.substring(run, left + 2, F.octet_length(run))))


@dataclass
class Climb:
    """The levels of a forest, from the leaves up; each is a written table of (group, idx, n, digest, siblings)."""

    levels: list[DataFrame]
    arity: int

    def subroots(self) -> DataFrame:
        """(group, digest): what remains of every group."""
        out = self.levels[0].filter("n = 1").select("group", "digest")
        for level in self.levels[1:]:
            out = out.union(level.filter("n = 1").select("group", "digest"))
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(group, idx, digest, path, *others) of the leaves; above(group, path, *others) has the path of each subroot from there on."""
        others = [c for c in above.columns if c not in ("group", "path")]
        down = None
        for depth, level in enumerate(reversed(self.levels)):
            own = level.filter("n = 1").join(above, "group").select("group", "idx", "digest", "path", *others)
            if down is not None:
                parents = down.select("group", F.col("idx").alias("up"), "path", *others)
                inner = level.filter("n > 1").withColumn("up", F.floor(F.col("idx") / self.arity)).join(parents, ["group", "up"])
                own = own.union(inner.select("group", "idx", "digest", F.concat(F.array("siblings"), "path").alias("path"), *others))
            down = materialize(own, "path") if depth % 6 == 5 else own
        return down


def climb(leaves: DataFrame, arity: int) -> Climb:
    """Levels over leaves(group, idx, n, digest) until every group has one node."""
    most = leaves.agg(F.max("n")).first()[0]  # one number
    levels, nodes = [], leaves
    while most:
        level = materialize(with_siblings(nodes, arity), "level")
        levels.append(level)
        if most == 1:
            break
        emitters = level.filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
        nodes = emitters.select("group", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), hashed(around(F.col("siblings"), text_of(F.col("digest")))).alias("digest"))
        most = -(-most // arity)
    return Climb(levels, arity)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf (hex) and the siblings on its path."""
    return F.aggregate(path, leaf, lambda digest, run: F.sha2(around(run, digest), 256))


def manifest(docs: DataFrame, group_col: str = "lang", arity: int = 2, *, id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root (hex) and path (an array, a binary a level: slot byte and siblings) of every row. ``also`` names columns over ``docs`` to take along."""
    if not 2 <= arity <= MOST_ARITY:
        raise ValueError(f"the arity must be from 2 to {MOST_ARITY}")
    also = also or {}
    rows = docs.select(F.col(id_col).alias("id"), source_key(F.col(group_col).cast("string")).alias("group"), hashed(*[framed(F.col(c)) for c in fields]).alias("digest"), *[c.alias(f"also_{k}") for k, c in also.items()])
    leaves = materialize(numbered(materialize(rows, "leaves"), "group", "id", "digest"), "leaves")
    lower = climb(leaves.select("group", "idx", "n", "digest"), arity)
    if not lower.levels:
        return leaves.select("id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root")], F.array().cast("array<binary>").alias("path"), *[F.col(f"also_{k}").alias(k) for k in also])
    tops = numbered(materialize(lower.subroots().select(F.lit("").alias("all"), F.col("group").alias("key"), "digest"), "subroots"), "all", "key")
    tops = materialize(tops, "subroots")
    upper = climb(tops.select(F.col("all").alias("group"), "idx", "n", "digest"), arity)
    root = text_of(F.lit(bytes(upper.subroots().first()["digest"])))
    start = tops.select(F.col("all").alias("group")).limit(1).withColumn("path", F.array().cast("array<binary>"))
    above = upper.paths(start).join(tops.select("idx", F.col("key")), "idx").select(F.col("key").alias("group"), "path", F.col("digest").alias("subroot"))
    down = lower.paths(materialize(above, "above")).drop("digest")
    out = leaves.join(down, ["group", "idx"])
    return out.select("id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"), "path", *[F.col(f"also_{k}").alias(k) for k in also])


def verify(docs: DataFrame, tampered: dict[str, Column], group_col: str = "lang", arity: int = 2, *, id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. ``tampered`` gives, for some fields, the value now found in place of the recorded one; the root
    is folded again from that leaf and the recorded siblings."""
    now = hashed(*[framed(tampered.get(c, F.col(c))) for c in fields])
    recorded = hashed(*[framed(F.col(c)) for c in fields])
    rows = manifest(docs, group_col, arity, id_col=id_col, fields=fields, also={"now": F.when(now != recorded, now)})
    proof = F.sha2(F.concat(F.lit(""), F.array_join(F.transform("path", lambda run: around(run, F.lit(""))), "")), 256)
    root = folded(F.coalesce(text_of(F.col("now")), F.col("leaf")), F.col("path"))
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_more_char() -> dict[str, Column]:
    """The tampering of the registered query: n_chars grows by one where 7 divides the crc32 of the decimal id."""
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def oracle() -> str:
    """DuckDB SQL for binary trees over documents."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n_chars: "sha256(" + " || ".join(field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"
    bits = "xor(c, b)"
    byte = f"list_reduce(list_prepend({bits}, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda c, b: {byte}), 4294967295)"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (
  SELECT g, i, n, d, 0 AS level FROM {leaves}
  UNION ALL
  SELECT g, i // 2, (n + 1) // 2, sha256(d || coalesce(sib, '')), level + 1
  FROM (SELECT *, lead(d) OVER (PARTITION BY g, i // 2 ORDER BY i) AS sib FROM {name}) WHERE n > 1 AND i % 2 = 0
)"""

    return f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id, {leaf('n_chars')}) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, {leaf('n_chars')} AS d,
    CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS now
  FROM documents
), {tree('low', 'leaves')}, tops AS (
  SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, g AS lang FROM low WHERE n = 1
), {tree('up', 'tops')}, nodes AS (
  SELECT 0 AS tree, g AS lang, i, n, d, level FROM low UNION ALL SELECT 1, NULL, i, n, d, level FROM up
), walk AS (
  SELECT doc_id, l.g AS lang, 0 AS tree, 0 AS level, l.i, l.n, l.d AS leaf, now AS fold, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.lang, CASE WHEN w.n = 1 THEN 1 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN t.i ELSE w.i // 2 END, CASE WHEN w.n = 1 THEN t.n ELSE (w.n + 1) // 2 END, w.leaf,
    CASE WHEN w.n = 1 THEN fold WHEN w.i % 2 = 0 THEN sha256(fold || coalesce(s.d, '')) ELSE sha256(s.d || fold) END, CASE WHEN w.n = 1 THEN proof ELSE proof || coalesce(s.d, '') END
  FROM walk w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang
    LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) AND (w.tree = 1 OR s.lang IS NOT DISTINCT FROM w.lang)
  WHERE NOT (w.tree = 1 AND w.n = 1)
)
SELECT w.doc_id, w.leaf, t.d AS subroot, r.d AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = r.d AS verified
FROM walk w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang JOIN up r ON r.n = 1 WHERE w.tree = 1 AND w.n = 1"""
