"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host and path together with the literal tokens any match must hold. Token counts
over all URLs choose each rule's rarest token as its index key; a URL's tokens fetch candidate rules by an equi-join, and
only those run regular expressions. Host rules (longest wins) decide first, then pattern rules: a URL is blocked
if a block pattern and no allow pattern fits it.

Defined results: a null URL or one without '://' has an empty host and path, no rule, and verdict allow. Repeated rows
stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

TOKEN = "[a-z0-9]+"
#: The index is broadcast up to so many rules, and joined by a shuffle beyond.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path starts with ``path``. The last token of a path prefix may go on, so it is no key unless '/' ends it."""
    tokens = re.findall(TOKEN, host.lower()) + [t.lower() for t in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), host + path)


def word_rule(verdict: str, *words: str) -> Rule:
    """Fits where the words stand as neighbouring tokens."""
    return Rule(verdict, "(?i)(?<![A-Za-z0-9])" + "[^A-Za-z0-9]+".join(words) + "(?![A-Za-z0-9])", words)


HOST_RULES = (host_rule("allow", "org", "/"), host_rule("block", "example.org", "/es/"), host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"), host_rule("block", "com", "/de/"))
PATTERN_RULES = tuple(word_rule("block", *w.split()) for w in ("casino", "poker", "viagra", "porn", "xxx", "torrent", "warez", "payday loans", "free spins")) + (word_rule("allow", "responsible", "gambling"),)


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(rest_of(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substr(url, at + 3))


def rule_index(tokens: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[str, str, str, str | None, int]]:
    """(key, verdict, pattern, name, length) for each rule; its key is its rarest token among all URLs. At most one count a rule token reaches the driver."""
    known = sorted({t for r in rules for t in r.tokens})
    counts = {r["token"]: r["n"] for r in tokens.filter(F.col("token").isin(known)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r.verdict, r.pattern, r.name, len(r.name or "")) for r in rules]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    places = rows.select("host", "path").distinct().withColumn("place", F.concat("host", "path"))
    tokens = places.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("place", UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1)))))
    index = spark.createDataFrame(rule_index(tokens, rules), "token string, verdict string, pattern string, name string, length int")
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    fits = tokens.join(index, "token").filter(F.expr("place rlike pattern"))
    named = F.col("name").isNotNull()
    found = fits.groupBy("host", "path").agg(F.max_by("name", F.when(named, F.col("length"))).alias("rule"), F.max_by("verdict", F.when(named, F.col("length"))).alias("by_rule"), F.coalesce(F.bool_or(~named & (F.col("verdict") == "block")), F.lit(False)).alias("bad"), F.coalesce(F.bool_or(~named & (F.col("verdict") == "allow")), F.lit(False)).alias("good"))
    method = F.when(F.col("bad") & ~F.col("good"), "block").otherwise("allow")
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))


def oracle(rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES) -> str:
    """The same result in DuckDB SQL, rule by rule."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    named = sorted((r for r in rules if r.name), key=lambda r: -len(r.name))
    fits = lambda r: "((host = {0} OR ends_with(host, {1})) AND starts_with(path, {2}))".format(lit(r.name.split("/", 1)[0]), lit("." + r.name.split("/", 1)[0]), lit("/" + r.name.split("/", 1)[1]))
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN {f(r)}" for r in named) + " END"
    hit = lambda v: "(" + " OR ".join(f"regexp_matches(concat(' ', regexp_replace(translate(host || path, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), {lit(' ' + ' '.join(r.tokens) + ' ')})" for r in rules if not r.name and r.verdict == v) + ")"
    return f"""WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, {case(lambda r: lit(r.name))} AS rule, coalesce({case(lambda r: lit(r.verdict))}, CASE WHEN {hit('block')} AND NOT {hit('allow')} THEN 'block' ELSE 'allow' END) AS verdict FROM b"""
