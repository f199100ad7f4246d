"""Substring search by an index of three-character pieces.

A text that contains a term contains all pieces of the term. So of each term the few pieces that the fewest texts
have are looked up, and only texts that have them all are read and tested. Postings are lists of keys, each of a
bounded number of texts, in a table partitioned by a hash of the piece and sorted by piece, so a search reads the
partitions and row groups of its own pieces. Case doesn't count. Terms of one or two characters are looked up under
every piece that holds them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.session import shared_folder

PIECE = 3
BUCKETS = 64
#: Pieces of a term that are looked up; further ones hardly make fewer candidates.
LOOKED_UP = 4
#: Texts that a list of keys may cover.
LISTED = 2048
#: Rows of pieces that may be sent to every task.
SMALL = 100_000


def pieces(text: Column) -> Column:
    """Distinct pieces of a lower-cased text; one that is shorter than a piece is a piece itself."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{{PIECE}}}))"), 1)  # one pass, whatever the length
    return F.array_distinct(F.when(F.length(low) >= PIECE, found).otherwise(F.array(low)))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    postings: DataFrame  # bucket, piece, keys: one list for every so many texts
    sizes: DataFrame  # bucket, piece, texts


def build_index(df: DataFrame, key: str, text: str, folder: str | None = None) -> Index:
    """Writes the index of a table whose `key` names its rows. Null and empty texts are in no posting."""
    spark = df.sparkSession
    base = folder or f"{shared_folder(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    texts = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"), F.floor(F.monotonically_increasing_id() / LISTED).alias("chunk"))
    # neighbouring texts share their lists, so what is moved is a list for each piece and chunk
    lists = texts.select("key", "chunk", F.explode(pieces(F.col("text"))).alias("piece")).groupBy("chunk", "piece").agg(F.collect_list("key").alias("keys"))
    lists = lists.select("chunk", "piece", "keys", _bucket(F.col("piece")).alias("bucket"))
    # a common piece has postings of nearly all texts, so it is dealt by the chunk as well
    spread = F.pmod(F.xxhash64("chunk"), F.lit(8))
    lists.repartition("bucket", spread).sortWithinPartitions("bucket", "piece").drop("chunk").write.partitionBy("bucket").parquet(f"{base}/postings")
    postings = spark.read.parquet(f"{base}/postings")
    postings.groupBy("bucket", "piece").agg(F.sum(F.size("keys")).alias("texts")).write.parquet(f"{base}/sizes")
    return Index(postings, spark.read.parquet(f"{base}/sizes"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def candidates(index: Index, terms: DataFrame) -> DataFrame:
    """term_id, key of every text that may contain the term, and few others. `terms`: term_id, term."""
    asked = terms.where("term <> ''").select("term_id", F.lower("term").alias("term"))
    long = asked.where(F.length("term") >= PIECE)
    wanted = long.select("term_id", F.explode(pieces(F.col("term"))).alias("piece")).withColumn("bucket", _bucket(F.col("piece")))
    sized = wanted.join(index.sizes, ["bucket", "piece"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    # a term has few pieces, so its pieces are gathered by the term
    rare = sized.groupBy("term_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("texts", "piece", "bucket"))), 1, LOOKED_UP).alias("p"))
    rare = rare.where(F.col("p")[0]["texts"] > 0).select("term_id", F.size("p").alias("n"), F.explode("p").alias("p")).select("term_id", "n", "p.piece", "p.bucket")
    by_all = index.postings.join(_small(rare), ["bucket", "piece"]).select("term_id", "n", F.explode("keys").alias("key")).groupBy("term_id", "key").agg(
        F.count(F.lit(1)).alias("hits"), F.min("n").alias("n")).where("hits = n").select("term_id", "key")
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PIECE - 1)), lambda w: F.transform(
        F.sequence(F.lit(1), F.lit(PIECE)), lambda i: F.substring(F.col("piece"), i, w)))))
    holding = index.sizes.select("bucket", "piece", F.explode(inner).alias("term")).join(_small(asked.where(F.length("term") < PIECE)), "term")
    by_any = index.postings.join(_small(holding.select("term_id", "bucket", "piece").distinct()), ["bucket", "piece"]).select(
        "term_id", F.explode("keys").alias("key")).distinct()
    return by_all.unionByName(by_any)


def search(index: Index, terms: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """term_id and key of every row whose text contains the term, in any case. Empty and null terms find nothing."""
    found = candidates(index, terms).join(terms.select("term_id", F.lower("term").alias("term")), "term_id")
    texts = df.select(F.col(key).alias("key"), F.lower(text).alias("text"))  # once a text, however many terms it may contain
    return found.join(texts, "key").where(F.contains("text", F.col("term"))).select("term_id", F.col("key").alias(key)).distinct()
