"""The manifest against a plain Merkle tree, for binary and wider trees."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from skyloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, k):
    """The root and each leaf's path: (siblings left of it, siblings right of it) a level."""
    paths, level = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), k):
            run = level[a : a + k]
            for s, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(([d for d, _ in run[:s]], [d for d, _ in run[s + 1 :]]))
            above.append((H(*[d for d, _ in run]), [i for _, b in run for i in b]))
        level = above
    return level[0][0], paths


def brute(rows, k):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf_of(r))))
        made[g] = (members, *tree([leaf_of(r) for r in members], k))
    root, tops = tree([made[g][1] for g in order], k)
    out = []
    for g, top in zip(order, tops):
        members, subroot, paths = made[g]
        for r, path in zip(members, paths):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            fold = leaf_of((*r[:3], r[3] + 1, r[4])) if tampered else leaf_of(r)
            for left, right in path:
                fold = H(*left, fold, *right)
            out.append((str(r[0]), leaf_of(r), subroot, root, H(*[d for a, b in path for d in a + b]), fold, fold == root))
    return sorted(out)


def rows_of(n):
    r = random.Random(n)
    langs = ["en"] * 6 + ["de", "é", "Z", "z", "fr"]
    rows = [(i, r.choice(["web", None]), r.choice(langs), r.choice([None, i, 7]), r.choice([None, "", "text é\n" * r.randint(0, 9), "x"])) for i in r.sample(range(10 * n), n)]
    return rows + [(1, None, None, None, None), (2, "s", None, 3, "a" * 5000)] + [(3, "s", "en", 1, "same")] * 3 + [(3, "s", "en", 1, "other"), (None, "s", "en", 1, "x"), (None, None, "lone", None, None), (5, "s", "", 2, "y")]


@pytest.mark.parametrize("n, arity", [(60, 2), (0, 2), (33, 3), (80, 5)])
def test_proofs(spark, n, arity):
    docs = spark.createDataFrame(rows_of(n), SCHEMA).withColumns({c: F.lit("clash") for c in ("group", "idx", "n", "digest", "siblings", "path", "id", "key", "leaf", "root", "tie", "part", "place", "now")}).repartition(3)
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.verify(docs, manifest.one_more_char(), arity=arity).collect())
    want = brute(rows_of(n), arity)
    assert got == want and (n == 0 or 0 < sum(not w[-1] for w in want) < len(want) / 2)


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([(7, None, "en", 1, None)], SCHEMA)
    (r,) = manifest.verify(one, {}).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf_of((7, None, "en", 1, None)) and r.proof_sha256 == H() and r.verified
    assert manifest.verify(one.limit(0), manifest.one_more_char()).count() == 0
    with pytest.raises(ValueError):
        manifest.verify(one, {}, arity=1)
