"""URL filtering: a blocked Bloom filter passes possible hits to an exact hash join.

The list holds canonical URLs `host/path` with a verdict each. An entry fits a page whose host is the entry's
or a subdomain of it and whose path starts with the entry's path; of several the longest wins. A page is
therefore looked up under each suffix of its host, and for listed hosts under those prefixes of its path that are
as long as one of the host's entries. Nearly all lookups find nothing: they are answered by two filters, 512 bits in
a block and one bit in each of its eight words, before anything is multiplied, and only the rest goes on to the joins
with the list, which remove the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import table

#: The filter has at most 2**18 blocks of 64 bytes (16 MB), however long the list is; beyond about a bit for
#: each four entries it passes more rows to the join, and nothing else changes.
MIN_BLOCK_BITS, MAX_BLOCK_BITS = 4, 18
BITS_PER_ENTRY = 24
WORDS = 8
#: A list of at most so many entries is sent whole to the executors; a longer one is joined by a shuffled hash join.
BROADCAST_ENTRIES = 50_000

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_list(listed: DataFrame) -> DataFrame:
    """rule, verdict -> rule, verdict, key, host_labels, path_length; one row per key.

    Keys are the entry with its host lower-cased. Of entries with one key `block` wins, then the smaller text.
    Entries that are null or have no `/` after a host are not valid and are left out.
    """
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    path = F.expr("substring(rule, instr(rule, '/'))")
    return (
        listed.where("rule IS NOT NULL AND instr(rule, '/') > 1 AND verdict IS NOT NULL")
        .select("rule", "verdict", F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("host_labels"),
                F.length(path).alias("path_length"))
        .groupBy("key")
        .agg(F.min(F.struct(F.col("verdict") != "block", "rule", "verdict", "host_labels", "path_length")).alias("e"))
        .select("key", "e.rule", "e.verdict", "e.host_labels", "e.path_length")
    )


def _block(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("mask"), key)
    # an SQL shift takes its distance from a column; each distance is six bits of the hash
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """The filter's blocks (block, w0 .. w7), built by partial aggregates, and the number of block bits."""
    bits = min(MAX_BLOCK_BITS, max(MIN_BLOCK_BITS, (entries * BITS_PER_ENTRY // 512).bit_length()))
    rows = keys.select(_block(F.col("key"), bits).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), bits


def possible_hits(candidates: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Candidates whose bits are all set: every listed key, and few others."""
    masks = _masks(F.col("key"))
    inside = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    keyed = candidates.withColumn("block", _block(F.col("key"), bits))
    return keyed.join(F.broadcast(blocks), "block").where(inside).select(*candidates.columns)


def lookup_host(host: Column) -> Column:
    """A host without user, default port and final dots, for look-ups."""
    plain = F.regexp_replace(host, "^.*@", "")
    return F.regexp_replace(F.regexp_replace(plain, r":(?:80|443)?$", ""), r"\.+$", "")


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url", canonical: bool = False) -> DataFrame:
    """One row per page: key, host, path, rule (null where no entry fits), verdict.

    `listed` has rule and verdict. A page that no entry fits gets `default`. A null url, or one without `://`,
    has an empty host and path and is fitted by nothing. Repeated rows stay. Of entries that fit, the longest
    text wins, then the longer host. With `canonical`, user, default port and final dots of a page's host don't
    count, and an empty path is `/`; the columns stay as they are. An empty list or page table is fine. Other columns
    of `pages` are left out.
    """
    pages = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    entries = canonical_list(listed)
    exact = lambda df: F.broadcast(df) if sizes["n"] <= BROADCAST_ENTRIES else df.hint("shuffle_hash")
    # as many numbers as a host has labels
    sizes = entries.agg(F.count(F.lit(1)).alias("n"), F.collect_set("host_labels").alias("labels")).first()
    hosts = entries.groupBy(F.substring_index("key", "/", 1).alias("host")).agg(F.collect_set("path_length").alias("paths"))
    host_blocks, host_bits = bloom_filter(hosts.select(F.col("host").alias("key")), sizes["n"])
    blocks, bits = bloom_filter(entries, sizes["n"])

    urls = pages.where("_url IS NOT NULL").select("_url").distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    if canonical:
        urls = urls.select("_url", lookup_host(F.col("host")).alias("host"), F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"))
    labels = F.split("host", r"\.")
    counts = F.array(*[F.lit(int(x)) for x in sorted(sizes["labels"])]).cast("array<int>")
    suffixes = F.transform(
        F.filter(counts, lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    suffixed = urls.where("host <> ''").select("_url", "path", F.explode(suffixes).alias("key"))
    on_host = possible_hits(suffixed, host_blocks, host_bits).join(exact(hosts), F.col("key") == hosts["host"]).select("_url", "path", "host", "paths")
    lengths = F.filter("paths", lambda n: n <= F.length("path"))
    candidates = on_host.select("_url", "path", "host", F.explode(lengths).alias("n")).select(
        "_url", F.concat("host", F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("key"))

    hits = possible_hits(candidates, blocks, bits)
    best = (
        hits.join(exact(entries), "key").groupBy("_url")
        .agg(F.max(F.struct(F.length("rule"), F.length("rule") - F.col("path_length"), "rule", "verdict")).alias("best"))
    )
    return pages.join(best, "_url", "left").select(
        key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op3_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule, rule_host, rule_path, rule_verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
)
SELECT u.page_id, u.host, u.path,
       (SELECT max_by(rule, length(rule)) FROM r
        WHERE (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)) AS rule,
       coalesce((SELECT max_by(rule_verdict, length(rule)) FROM r
        WHERE (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)), 'allow') AS verdict
FROM u
"""
