"""Secret scan: named patterns, and a battery of randomness tests over long tokens with length-aware false-discovery control.

A candidate is a run of 20 or more encoding characters, however long. Its encoding is the smallest of ALPHABETS that has all
characters it holds, else base64: random tokens of a larger alphabet that happen to fit a smaller one are uniform over that too. Three tests
ask how likely an ordinary token would look as random as this one: chi-squared distance from uniformity over the encoding (ordinary
tokens lie EXCESS a character away), correlation of neighbouring symbols (ordinary tokens have SERIAL at least), and the number of
runs of character classes (ordinary tokens change class at CHANGE_RATE at most; not asked of an encoding with one class). Stouffer's method makes
one p-value of the three, so that what looks ordinary to one test outweighs what looks random to another (paths of words change class often).
Benjamini-Hochberg, weighted by length (longer tokens carry more evidence) with the mean weight 1, decides over all
candidates of the table: counts of p-values in fine logarithmic bins, rounded towards no discovery, set one threshold.

Defined results: a null text is empty; repeated rows stay; ids are cast to long; an empty table gives an empty result. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is a match of [0-9a-f]+ that is long enough, and no other is
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
#: Character classes change this often within ordinary tokens (identifiers, paths, long words), at most.
CHANGE_RATE = 0.15
#: How far ordinary tokens lie from uniformity (chi-squared a character) and from independent neighbours (correlation), at least.
EXCESS, SERIAL = 0.7, 0.3
BINS_A_DECADE, MOST_BIN = 20, 6000
LETTERS = string.ascii_lowercase
#: Decimal, hexadecimal, base32, base36, base58 and base62.
ALPHABETS = [frozenset(a) for a in ("0123456789", "0123456789abcdef", "0123456789ABCDEF", LETTERS + "234567", LETTERS.upper() + "234567", LETTERS + string.digits, LETTERS.upper() + string.digits, "".join(c for c in string.ascii_letters + string.digits if c not in "0OIl"), string.ascii_letters + string.digits)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the named patterns, leftmost and non-overlapping within a kind; matches that are too short are dropped after they are found."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def log_tail(n: int, least: int, rate: float) -> float:
    """Natural logarithm of the chance of at least ``least`` hits in n draws. Terms are summed away from the mean, relative to the first."""
    if least <= 0:
        return 0.0
    if least > n:
        return -math.inf
    odds, upper = rate / (1 - rate), least > n * rate
    k = first = least if upper else least - 1
    term = total = 1.0
    while term > 1e-17 * total and (k < n if upper else k > 0):
        term *= (n - k) / (k + 1) * odds if upper else k / ((n - k + 1) * odds)
        total += term
        k += 1 if upper else -1
    log = math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1) + first * math.log(rate) + (n - first) * math.log1p(-rate) + math.log(total)
    return min(log, 0.0) if upper else math.log1p(-min(math.exp(log), 1 - 1e-16))


def log_normal_tail(z: float) -> float:
    """Natural logarithm of the chance of a standard normal value below z."""
    if z > -30:
        return math.log(math.erfc(-z / math.sqrt(2)) / 2)
    return -z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))


def normal_quantile(log_p: float) -> float:
    """The value below which a standard normal one lies with the given logarithm of a chance."""
    if log_p > -600:
        return NormalDist().inv_cdf(min(math.exp(log_p), 1 - 1e-16))
    return -math.sqrt(-2 * log_p - math.log(-2 * log_p) - math.log(2 * math.pi))


def battery(token: str) -> float | None:
    """-log10 of the p-value that an ordinary token looks as random as this one; None for tokens of less than 16 characters without padding."""
    body = token.rstrip("=")
    n, symbols = len(body), set(body)
    if n < 16:
        return None
    size = next((len(alphabet) for alphabet in ALPHABETS if symbols <= alphabet), 64)
    expected = n / size
    chi = sum((k - expected) ** 2 for k in Counter(body).values()) / expected + (size - len(symbols)) * expected
    z = [(abs(chi - (size - 1)) - EXCESS * n) / math.sqrt(2 * (size - 1) + 4 * EXCESS * n)]
    codes = [ord(c) for c in body]
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    correlation = abs(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread) if spread else 1.0
    z.append((correlation - SERIAL) * math.sqrt(n))
    if size > 10:
        classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in body]
        z.append(normal_quantile(log_tail(n - 1, sum(a != b for a, b in zip(classes, classes[1:])), CHANGE_RATE)))
    return min(-log_normal_tail(sum(z) / math.sqrt(len(z))) / math.log(10), 300.0)


def scan(batches):
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            base = base_spans(text)
            tokens = [(m.start(), m.end(), p) for m in TOKEN.finditer(text) if (p := battery(m.group())) is not None]
            out.append((doc_id, *(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest(), [{"start": s, "kind": k, "end": e} for s, k, e in base], [{"start": s, "end": e, "p": p} for s, e, p in tokens]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, ARROW)], names=NAMES)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(SPAN), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))]
NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens"]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, tokens array<struct<start: long, end: long, p: double>>"


def false_discovery_threshold(scanned: DataFrame, rate: float) -> tuple[float, float]:
    """(mean candidate length, least weighted -log10 p that is a discovery) of weighted Benjamini-Hochberg over all candidates. Two numbers reach the driver."""
    tokens = scanned.select(F.explode("tokens").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("length"), "t.p")
    n, mean = tokens.agg(F.count("*"), F.avg("length")).first()
    if not n:
        return 1.0, math.inf
    weighted = F.col("p") + F.log10(F.col("length") / mean)
    bins = tokens.groupBy(F.least(F.lit(MOST_BIN), F.greatest(F.lit(0), F.floor(weighted * BINS_A_DECADE))).alias("bin")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("bin")))
    least = bins.withColumn("above", above).filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) <= rate * F.col("above") / n).agg(F.min("bin")).first()[0]
    return mean, math.inf if least is None else least / BINS_A_DECADE


def scan_secrets(docs: DataFrame, rate: float = 0.01, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end of all spans, by start, then kind), n_random."""
    scanned = materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, SCHEMA), "secrets")
    mean, least = false_discovery_threshold(scanned, rate)
    found = F.filter("tokens", lambda t: t["p"] + F.log10((t["end"] - t["start"]) / F.lit(mean)) >= F.lit(least))
    random = F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    spans = F.transform(F.array_sort(F.concat("base", random)), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size(found).alias("n_random"))
