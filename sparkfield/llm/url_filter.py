"""Operator 2: URL rules behind a blocked Bloom filter.

A rule (host, path, verdict) holds for its host and all subdomains, on paths that start
with its path; of the rules that hold, the one with the longest host, then the longest
path, decides. So a URL can only match keys (host suffix, path prefix), of the label
counts and path lengths that rules have. Those keys go through a blocked Bloom filter
of the listed keys, eight 32-bit words a block with one bit each; what passes goes to
an exact hash join with the rules, which removes the false positives.

Each distinct (host, path) is looked up once. Filter and rules are broadcast up to
``BROADCAST_BLOCKS`` and ``BROADCAST_RULES`` rows, and joined by key beyond that.

Defined cases: a null url, or one without "://", has empty host and path and no rule;
repeated rules count once, and block wins over allow for the same key; without a rule
the verdict is allow; repeated pages are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS_PER_KEY = 16
BLOCK_BITS = 256
BROADCAST_BLOCKS = 1 << 15  # 64 bytes each: 2 MB
BROADCAST_RULES = 100_000
WORDS = [f"w{k}" for k in range(8)]
KEY = ["host", "path"]

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a URL as it stands: no decoding, no port or user removed."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(common.ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _bits(host: Column, path: Column, blocks: int) -> list[Column]:
    """The block of a key, and its bit in each of the block's words."""
    first, second = F.xxhash64(host, path), F.xxhash64(path, host, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * k).bitwiseAND(31).cast("int")) for k in range(8)]
    return [F.pmod(first, F.lit(blocks)).alias("block"), *[m.alias(w) for m, w in zip(masks, WORDS)]]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row a block that has a key: the union of its keys' bits."""
    return keys.select(*_bits(F.col("host"), F.col("path"), blocks)).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible_keys(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, key_host, key_path): suffixes and prefixes of the sizes that rules have.

    Label counts and path lengths are at most as many as a host has labels and a path has characters.
    """
    sizes = rules.agg(F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    hosts = [F.substring_index("host", ".", -n) for n in sorted(sizes.labels)]
    paths = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(sizes.lengths)]
    if not hosts or not paths:
        return urls.limit(0).withColumns({"key_host": F.col("host"), "key_path": F.col("path")})
    some = urls.withColumn("key_host", F.explode(F.array_distinct(F.array(*hosts))))
    return some.withColumn("key_path", F.explode(F.array_distinct(F.array_compact(F.array(*paths)))))


def judge(pages: DataFrame, rules: DataFrame, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    rules = rules.groupBy(*KEY).agg(F.max("verdict").alias("verdict"))
    n = rules.count()
    blocks = max(1, -(-n * bits_per_key // BLOCK_BITS))
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = possible_keys(parsed.select(*KEY).where("host <> ''").distinct(), rules)
    bits = _bits(F.col("key_host"), F.col("key_path"), blocks)
    probes = keys.select("*", bits[0], *[b.alias(f"k{w}") for b, w in zip(bits[1:], WORDS)])
    table = bloom_filter(rules, blocks)
    passed = probes.join(F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table, "block")
    for w in WORDS:
        passed = passed.where(F.col(w).bitwiseAND(F.col(f"k{w}")) != 0)
    passed = passed.select(*KEY, "key_host", "key_path")
    exact = rules.withColumnsRenamed({"host": "key_host", "path": "key_path"})
    held = passed.join(F.broadcast(exact) if n <= BROADCAST_RULES else exact, ["key_host", "key_path"])
    order = F.struct(F.length("key_host"), F.length("key_path"))
    best = held.groupBy(*KEY).agg(F.max_by(F.struct(F.concat("key_host", "key_path").alias("rule"), "verdict"), order).alias("best"))
    # Written, so that a url on very many pages is split over tasks; what has no host is not joined at all.
    best = common.written(best, "best")
    unknown = parsed.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    out = parsed.where("host <> ''").join(best.hint("merge"), KEY, "left").unionByName(unknown)
    return out.select("page_id", *KEY, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op2_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), rule_table(spark, RULES))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), raw AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host FROM rests
), parsed AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(translate(raw_host, '{common.UPPER}', '{common.LOWER}'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1), '') AS path
  FROM raw
), rules(rule_host, rule_path, rule_verdict) AS (VALUES {_VALUES}),
best AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parsed JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (r)
"""
