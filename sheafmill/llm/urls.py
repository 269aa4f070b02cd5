"""URL rules: a blocked Bloom filter of listed canonical URLs passes possible hits on to an exact hash join.

A list entry is a host and a path prefix (``example.org/es/``). A URL's candidates are its host and every parent
domain, each with the first n characters of the path for every length n that occurs in the list. Candidates go
through the filter (a 256-bit block for each eight keys, four bits a key), then possible hits meet the list itself.

Only DataFrame functions. Edge cases: a null URL or one without "://" has an empty host and path and fits no rule
(verdict: the default); of equally long fitting rules the alphabetically last verdict, then rule, wins; repeated rows are judged
each; empty tables and empty lists work; other columns pass through, and the names added here replace their namesakes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The list is broadcast up to this many entries, the filter up to that many (4 bytes an entry in blocks of 32); longer ones are shuffled.
MAX_BROADCAST_RULES, MAX_BROADCAST_FILTER = 200_000, 5_000_000
KEYS_A_BLOCK = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule string, verdict string"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(63).cast("int")) for j in range(4)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: block number and its four words."""
    at = [f"__b{j}" for j in range(4)]
    return (
        keys.select(_block(F.col("key"), n_blocks).alias("__block"), *[b.alias(a) for a, b in zip(at, _bits(F.col("key")), strict=True)])
        .groupBy("__block")
        .agg(*[F.bit_or(a).alias(a) for a in at])
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: RULE_SCHEMA, a rule being host and path prefix in one string."""
    spark: SparkSession = pages.sparkSession
    rules = rules.select("rule", "verdict").filter("rule is not null").distinct()
    listed = rules.select(
        F.concat_ws("\x01", F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), UPPER, LOWER), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("key"), "rule", "verdict"
    ).withColumn("path_chars", F.length(F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)))
    n_rules = listed.count()
    lengths = sorted(r[0] for r in listed.select("path_chars").distinct().collect())  # bounded by the longest path of the list
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not n_rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    small = (lambda x: F.broadcast(x)) if n_rules <= MAX_BROADCAST_RULES else (lambda x: x)
    small_filter = (lambda x: F.broadcast(x)) if n_rules <= MAX_BROADCAST_FILTER else (lambda x: x)
    n_blocks = -(-n_rules // KEYS_A_BLOCK)
    labels = F.split("host", r"\.")
    parents = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    places = out.select("host", "path").filter("host <> ''").distinct()
    candidates = (
        places.withColumn("__parent", F.explode(parents))
        .withColumn("__n", F.explode(fits))
        .select("host", "path", F.concat_ws("\x01", "__parent", F.expr("substring(path, 1, __n)")).alias("key"))
    )
    words = _bits(F.col("key"))
    possible = (
        candidates.withColumns({"__block": _block(F.col("key"), n_blocks)} | {f"__k{j}": words[j] for j in range(4)})
        .join(small_filter(bloom_blocks(listed, n_blocks)), "__block")
        .filter(" and ".join(f"(__b{j} & __k{j}) = __k{j}" for j in range(4)))
        .select("host", "path", "key")
    )
    best = (
        possible.join(small(listed.drop("path_chars")), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), "verdict", "rule")).alias("__best"))
        .select("host", "path", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"))
    )
    known = out.filter("host <> ''").join(best, ["host", "path"], "left").select(*out.columns, "rule", "verdict")
    rest = out.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return known.unionByName(rest).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
