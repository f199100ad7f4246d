"""SimHash near-duplicates, linked exactly by deletion-variant signatures.

Fingerprints that differ in at most `distance` bits are found without comparing all pairs: a fingerprint is
cut into distance // 2 + 1 segments (three for four bits), fewer than the usual distance + 1, so that of two
such fingerprints some segment differs in at most one bit. Each segment is indexed as it is and once for each
of its bits with that bit deleted. Two fingerprints meet under the whole segment if it is equal, and under
exactly one deletion, from opposite sides, if it differs in one bit; each meeting is then verified on all 64
bits. Equal fingerprints are merged first, so groups of exact copies cost one fingerprint.

Of a group of fingerprints under one key only stars are kept, never all its pairs: a task compares the rows of
a key block by block and returns at most one edge a row. Keys with more than KEY_ROWS rows are put off and
compared as pairs of blocks, spread over tasks, with every pair of rows in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import slices, table
from veritrail.llm.components import components
from veritrail.session import cut_lineage

BITS = 64
#: Rows of one key that one task compares at once.
KEY_ROWS = 4096
#: Shingle hashes that are counted at once.
COUNTED = 1 << 15
WHOLE = 63  # the position that stands for "no bit deleted"


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash; words are runs without ASCII white space, A-Z lower-cased, shingles count as often as they occur."""
    tokens = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not tokens:
        return 0
    body = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    if len(tokens) < words:
        spans = [(0, len(body))]
    else:
        spans = [(a, b - 1) for a, b in zip(starts, ends[words - 1:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), COUNTED):
        h = np.array([digest(body[a:b], 42) for a, b in spans[i:i + COUNTED]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """key, fp (signed 64-bit). Every whole text is read once, in Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            fps = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "fp": fps})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signatures(nodes: DataFrame, distance: int) -> DataFrame:
    """fp -> (key, side, fp): each segment whole (side 2), and with each bit deleted (side: that bit)."""
    made = []
    for i, (first, width) in enumerate(segments(distance)):
        ones = (1 << width) - 1 if width < BITS else -1
        seg = f"(shiftrightunsigned(fp, {first}) & {ones}L)"
        tag = lambda p, i=i: f"{(i << 6 | p)}L"
        made.append(f"named_struct('key', xxhash64({tag(WHOLE)}, {seg}), 'side', 2Y)")
        made += [
            f"named_struct('key', xxhash64({tag(p)}, {seg} & ~shiftleft(1L, {p})), 'side', cast(shiftrightunsigned({seg}, {p}) & 1L as tinyint))"
            for p in range(width)
        ]
    return nodes.select("fp", F.explode(F.expr(f"array({', '.join(made)})")).alias("s")).select("s.key", "s.side", "fp")


def stars(key: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, reduced to edges (fingerprint, smallest fingerprint joined to it here)."""
    nodes, at = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    row = np.arange(len(key))
    step = 1
    while len(row):
        row = row[row + step < len(key)]
        row = row[key[row] == key[row + step]]
        if not len(row):
            break
        a, b = at[row], at[row + step]
        meets = (label[a] != label[b]) & ((side[row] == 2) | (side[row] != side[row + step]))
        a, b = a[meets], b[meets]
        near = np.bitwise_count(fp_bits(nodes[a]) ^ fp_bits(nodes[b])) <= distance
        a, b = a[near], b[near]
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label = further
        step += 1
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def fp_bits(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


LINKS = "u long, v long, key long, side byte, block long"


def _links(distance: int, key_rows: int):
    """Sorted signatures -> edges (u, v), and rows of large keys (key, side, block, u) that are put off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = (np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64))
        large, seen = None, 0  # the key that is put off just now, and its rows so far

        def edges(rows):
            u, v = stars(*rows, distance)
            return pd.DataFrame({"u": u, "v": v, "key": None, "side": None, "block": None})

        def put_off(rows):
            nonlocal seen
            block = (seen + np.arange(len(rows[0]))) // key_rows
            seen += len(rows[0])
            return pd.DataFrame({"u": rows[2], "v": None, "key": rows[0], "side": rows[1], "block": block})

        for pdf in batches:
            rows = tuple(np.concatenate([k, pdf[c].to_numpy()]) for k, c in zip(kept, ("key", "side", "fp"), strict=True))
            if large is not None:
                n = int(np.argmax(rows[0] != large)) if (rows[0] != large).any() else len(rows[0])
                if n:
                    yield put_off(tuple(x[:n] for x in rows))
                    rows = tuple(x[n:] for x in rows)
                if not len(rows[0]):
                    kept = rows
                    continue
                large = None
            # keys that are complete, apart from a key inside the batch that is itself too large
            heads = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if len(rows[0]) else np.empty(0, np.int64)
            if not len(heads):
                continue
            sizes = np.diff(np.r_[heads, len(rows[0])])
            for i in np.flatnonzero(sizes[:-1] > key_rows):
                seen = 0
                yield put_off(tuple(x[heads[i]:heads[i] + sizes[i]] for x in rows))
            small = np.repeat(sizes <= key_rows, sizes)
            small[heads[-1]:] = False
            yield edges(tuple(x[small] for x in rows))
            kept = tuple(x[heads[-1]:] for x in rows)
            if sizes[-1] > key_rows:
                large, seen = kept[0][0], 0
                yield put_off(kept)
                kept = tuple(x[:0] for x in kept)
        if len(kept[0]):
            yield edges(kept)

    return run


def near_edges(nodes: DataFrame, distance: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) with the same components as all pairs within `distance`."""
    by_key = signatures(nodes, distance).repartition("key").sortWithinPartitions("key")
    found = cut_lineage(by_key.mapInPandas(_links(distance, key_rows), LINKS))
    edges = found.where("key IS NULL").select("u", "v")
    off = found.where("key IS NOT NULL").select("key", "side", "block", F.col("u").alias("fp"))
    if off.isEmpty():
        return edges
    blocks = off.groupBy("key").agg((F.max("block") + 1).alias("n"))
    pairs = (
        off.join(blocks, "key")
        .select("key", "side", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "side", "fp")
    )
    # a pair of blocks has at most twice the rows of a block
    more = pairs.repartition("key").sortWithinPartitions("key").mapInPandas(_links(distance, 2 * key_rows), LINKS)
    return edges.unionAll(more.select("u", "v"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in at most `distance` bits, and component_id is the
    smallest key that can be reached over links, the document's own included. Null and empty texts, and texts
    of white space, have fingerprint zero and are linked like any other; texts of fewer than `words` words have
    their whole word sequence as the one shingle. Documents with a null key take part and have the component
    of the others; a component of null keys only has a null id. Repeated rows stay. An empty table gives no
    rows. Other columns of `docs` are left out.
    """
    prints = cut_lineage(with_fingerprints(docs, words, key, text))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_edges(nodes.select("fp"), distance, key_rows))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = cut_lineage(placed)
    least = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(placed.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The document with the smallest key of each component, with all its columns.

    Of repeated rows of that key one stays. Documents with a null key can't be named as anyone's copy and stay.
    """
    kept = near_duplicates(docs, key=key, **how).where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = docs.join(kept, key, "left_semi").dropDuplicates([key])
    return named.unionByName(docs.where(F.col(key).isNull()))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
