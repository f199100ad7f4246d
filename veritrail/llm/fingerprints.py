"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane, modulo powers of two. The order of paragraphs doesn't matter, paragraphs can be put in or taken
out of a fingerprint by adding or subtracting their vectors, and fingerprints of parts add up to that of the
whole. A vector has two sections:

* 16 lanes of 64 bits from a cryptographic hash of the paragraph, which tell multisets of paragraphs apart;
* 128 lanes of 32 bits, to which each run of GRAM bytes of the paragraph adds +1 or -1 at a hashed lane. The
  inner product of two such sections estimates how many runs two documents share, so likeness can be read
  off fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import slices, table
from veritrail.session import cut_lineage

EXACT, LIKE, GRAM = 16, 128, 16
#: Bytes of a text whose runs are hashed at once.
CHUNK = 1 << 18
#: Documents that are ordered together; in a very large corpus more, so that there are at most MAX_BLOCKS blocks.
BLOCK_DOCS, MAX_BLOCKS = 1024, 16384

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _like(body: bytes) -> np.ndarray:
    """Signed lane counts of the byte runs; a run never reaches over a paragraph's start."""
    pad = b"\0" * (GRAM - 1)
    data = pad + body.replace(b"\n", b"\n" + pad)
    lanes = np.zeros(LIKE, np.int64)
    for a in range(0, len(data) - GRAM + 1, CHUNK):
        part = np.frombuffer(data[a:a + CHUNK + GRAM - 1], np.uint8)
        n = len(part) - GRAM + 1
        x = np.zeros(n + 8, np.uint64)
        for i in range(8):  # little-endian words of eight bytes at every position
            x |= part[i:i + n + 8].astype(np.uint64) << np.uint64(8 * i)
        h = _mixed(x[:n] + _mixed(x[8:8 + n]))
        last = part[GRAM - 1:]
        h = h[(last != 10) & (last != 0)]
        slot = (h >> np.uint64(32)).astype(np.int64)
        lanes += np.bincount(slot & (LIKE - 1), weights=1 - 2 * (slot >> 31 & 1), minlength=LIKE).astype(np.int64)
    return lanes


class Fingerprint:
    """Sums of paragraph vectors; equal multisets of paragraphs have equal fingerprints."""

    __slots__ = ("exact", "like")

    def __init__(self, exact: np.ndarray, like: np.ndarray):
        self.exact, self.like = exact, like

    @staticmethod
    def of(paragraphs: bytes) -> Fingerprint:
        """Of UTF-8 text whose paragraphs are its lines; an empty text has one empty paragraph."""
        wide = b"".join(hashlib.shake_128(p).digest(8 * EXACT) for p in paragraphs.split(b"\n"))
        exact = np.frombuffer(wide, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
        return Fingerprint(exact, _like(paragraphs).astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.like - other.like)

    def __eq__(self, other) -> bool:
        return np.array_equal(self.exact, other.exact) and np.array_equal(self.like, other.like)

    def __str__(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).decode()

    @staticmethod
    def parse(text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return Fingerprint(np.frombuffer(raw, "<u8", EXACT), np.frombuffer(raw, "<u4", LIKE, 8 * EXACT))

    def likeness(self, other: Fingerprint) -> float:
        """Estimated share of byte runs in common, 0 to 1; exactly 1 for equal fingerprints."""
        if self == other:
            return 1.0
        a, b = (x.like.view(np.int32).astype(np.float64) for x in (self, other))
        whole = float(a @ a + b @ b)
        return min(1.0, max(0.0, 2 * float(a @ b) / whole)) if whole else 0.0


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter of code points replaced by the first as many of `following`, and where it changes."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n], len(text) - n


def edit_fingerprint(own: Fingerprint, text: str, changed: str, at: int) -> Fingerprint:
    """Of `changed`, which is `text` up to `at`: takes out the paragraphs from there on and puts in the new ones."""
    line = text.rfind("\n", 0, at) + 1
    return own - Fingerprint.of(text[line:].encode()) + Fingerprint.of(changed[line:].encode())


def in_order(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> block, id, text, guest: runs of the order by id, each with the row that follows it.

    Block bounds are estimated quantiles of the ids; rows of one id stay together. The first row of a block (after the last block: of the first) is added to the block before as
    a guest. Texts move once.
    """
    ids = docs.select("id")
    n = ids.count()
    cuts = min(MAX_BLOCKS, max(1, -(-n // BLOCK_DOCS)))
    bounds = []
    if cuts > 1:
        bounds = sorted(set(ids.agg(F.percentile_approx("id", [i / cuts for i in range(1, cuts)], 10 * cuts)).first()[0] or []))
    edges = np.array(bounds)

    @F.pandas_udf("long")
    def block_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), 0, np.searchsorted(edges, x.fillna(0).to_numpy(), side="right")))

    rows = docs.withColumn("block", block_of("id") if bounds else F.lit(0).cast("long"))
    # the least row of each block in the order (id, hash of text, text): one a block, at most MAX_BLOCKS
    heads = rows.groupBy("block").agg(F.min(F.struct("id", F.xxhash64("text").alias("h"))).alias("head"))
    before = Window.orderBy("block")
    firsts = F.broadcast(cut_lineage(
        heads.select("head", F.coalesce(F.lag("block").over(before), F.max("block").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))))
    guests = (
        docs.join(firsts, docs["id"].eqNullSafe(F.col("head.id")) & (F.xxhash64("text") == F.col("head.h")))
        .select(F.col("to").alias("block"), "id", "text", F.lit(True).alias("guest"))
    )
    both = rows.select("block", "id", "text", F.lit(False).alias("guest")).unionAll(guests)
    return both.repartition("block").sortWithinPartitions("block", "guest", F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the text's code points replaced by the first as many (or all) of the
    next document's, in the order of keys; after the last comes the first. Null texts are empty. Null keys come
    first; equal keys follow each other in an order fixed by their texts. A document alone is its own next.
    An empty table gives no rows. Other columns of `docs` are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before, which waits for its successor
        for pdf in slices(batches):
            made = []
            for block, i, body, guest in zip(pdf["block"], pdf["id"], pdf["text"], pdf["guest"], strict=True):
                if held is not None and held[0] == block:
                    own = Fingerprint.of(body.encode()) if body != held[2] else held[3]
                    changed, at = edited(held[2], body)
                    new = edit_fingerprint(held[3], held[2], changed, at)
                    made.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), str(held[3]), str(new),
                                 held[3].likeness(new), held[3].likeness(own)))
                elif not guest:
                    own = Fingerprint.of(body.encode())
                # of guests with one key and one hash the first counts
                held = None if guest else (block, i, body, own)
            yield pd.DataFrame(made, columns=["id", *[c.split()[0] for c in RESULT.split(", ")]])

    return in_order(docs).mapInPandas(run, f"id {kind}, {RESULT}").withColumnRenamed("id", key)


def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
