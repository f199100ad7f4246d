"""Near-duplicates by exact similarity of shingle sets.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more, and no such pair is
missed. With all sets in one order, two that are so alike share a shingle among the first n - ceil(0.8 n) + 1 of
each, so only these are indexed. The order is by shingle hash, with common shingles (license lines, shared passages)
last; so they are indexed only for texts that hold little else.

Sets themselves are never stored. They are made again from the texts, for the members of candidate pairs only. In the
first round each set is compared with the one it meets most often among the heads of its shingles; that joins most
groups of copies. In the second, sets of different groups that meet under a shingle are compared, unless their
sizes, the places of the shingle or the parities of 1024 groups of shingles show that they can't be alike. A shingle
with more than KEY_ROWS sets is cut into blocks by size, and blocks whose sizes fit are compared pair by pair over
tasks. Sets that are to be compared meet at the home of their family, where each moves once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import char_slices
from veritrail.llm.components import components
from veritrail.llm.wordhash import mix, words
from veritrail.session import cut_lineage, forget

WORDS = 5
SKETCH = 16  # longs of parities
#: A shingle is common if more than one in so many entries of the index is its; there can be no more than twice as many.
COMMON_SHARE = 1 << 13
#: Sets under one shingle that a task compares at once, and heads that a set is first held against.
KEY_ROWS, HEADS = 4096, 3
#: Shingles of the sets that a task holds of one block.
TILE_SHINGLES = 1 << 20
#: Ids that may be sent to every task; larger lists are joined.
SENT_IDS = 200_000
BATCH_CHARS = 1 << 20


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each text; of fewer words, the whole sequence is the one shingle."""
    h, _, per_text = words(texts)
    ends = np.cumsum(per_text)
    runs = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        runs += mix(h[i:len(h) - WORDS + 1 + i] + np.uint64(i + 1)) * np.uint64(2 * i + 1)
    runs = mix(runs)
    out = []
    for end, n in zip(ends.tolist(), per_text.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(runs[end - n:end - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[end - n:end].tobytes(), 42)] if n else [], np.uint64))
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """Whether the shingles in each of 1024 groups are an odd number: sets differ in no fewer shingles than bits."""
    odd = np.bincount((grams & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def alike(common, n, m):
    """Whether sets of n and m shingles with `common` shared ones have similarity 0.8 or more, in whole numbers."""
    return 9 * common >= 4 * (n + m)


def first_of(grams: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The indexed shingles of a set, the sorted `last` ones after all others."""
    if not len(grams):
        return grams
    if len(last):
        late = np.isin(grams, last)
        grams = np.concatenate([grams[~late], grams[late]])
    return grams[:len(grams) - (4 * len(grams) + 4) // 5 + 1]


def name_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 7)


def _longs(values) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


def _index(last: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in char_slices(batches, "text", BATCH_CHARS):
            sets = shingle_sets(pdf["text"].tolist())
            yield pd.DataFrame({
                "id": pdf["id"].to_numpy(), "th": pdf["th"].to_numpy(), "fp": _longs(map(name_of, sets)), "n": np.array([len(s) for s in sets], np.int32),
                "first": [first_of(s, last).view(np.int64) for s in sets], "sketch": [sketch(s) for s in sets]})

    return run


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles that may be common, and how often each was seen at least, by decreasing counters of bounded number."""
    most = 4 * COMMON_SHARE
    keys, counts, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for pdf in batches:
        lists = [x for x in pdf["first"] if len(x)]
        if not lists:
            continue
        new = np.concatenate(lists)
        seen += len(new)
        keys, at = np.unique(np.r_[keys, new], return_inverse=True)
        counts = np.bincount(at, np.r_[counts, np.ones(len(new), np.int64)], len(keys)).astype(np.int64)
        if len(keys) > most:
            # each round takes the same number from at least `most` counters, so no count falls by more than seen / most
            counts -= np.partition(counts, -most)[-most]
            keys, counts = keys[counts > 0], counts[counts > 0]
    yield pd.DataFrame({"key": keys, "times": counts, "seen": np.where(np.arange(len(keys)) == 0, seen, 0)})


def common_shingles(nodes: DataFrame) -> np.ndarray:
    """Sorted. At most 2 * COMMON_SHARE of them, since each has at least so great a share of all entries."""
    found = nodes.select("first").mapInPandas(_frequent, "key long, times long, seen long")
    found = cut_lineage(found.groupBy("key").agg(F.sum("times").alias("times"), F.sum("seen").alias("seen")))
    total = found.agg(F.sum("seen")).first()[0] or 0
    rows = found.where((F.col("times") > 2) & (F.col("times") * 2 * COMMON_SHARE >= total)).select("key").toPandas()
    forget(found)
    return np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, without those of a key that has one row."""
    before, held = None, None  # the key of the last row, and that row if it may yet be alone
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        if held is not None and held["key"].iloc[0] == key[0]:
            yield held
        same = np.r_[key[0] == before if before is not None else False, key[1:] == key[:-1]]
        twin = same.copy()
        twin[:-1] |= same[1:]
        yield pdf[twin]
        before, held = key[-1], None if twin[-1] else pdf.iloc[-1:]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _room(n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b, which share the shingle at `at`, can be alike by their sizes and its places."""
    return alike(np.minimum(np.minimum(n[a] - at[a], n[b] - at[b]), np.minimum(n[a], n[b])), n[a], n[b])


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries sorted by key and set -> (v, u): each set with the first of HEADS heads of its key that it may be like.

    A key that goes on over batches has heads in each; what isn't found here is left to the second round.
    """
    for pdf in batches:
        key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
        n, at = pdf["n"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
        if not len(key):
            continue
        starts = _starts(key)
        start = np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        open_rows = np.arange(len(key))
        for step in range(HEADS):
            open_rows = open_rows[start[open_rows] + step < open_rows]
            heads = start[open_rows] + step
            fits = (fp[heads] != fp[open_rows]) & _room(n, at, heads, open_rows)
            yield pd.DataFrame({"v": fp[open_rows[fits]], "u": fp[heads[fits]]})
            open_rows = open_rows[~fits]


PARITIES = [f"s{i}" for i in range(SKETCH)]


def _candidates(pdf: pd.DataFrame, sides: bool) -> Iterator[pd.DataFrame]:
    """Pairs to compare among rows sorted by key and size; with `sides`, only those of one row of each side."""
    key, fp, root = (pdf[c].to_numpy() for c in ("key", "fp", "root"))
    n, at = (pdf[c].to_numpy(np.int64) for c in ("n", "at"))
    side = pdf["side"].to_numpy() if sides else None
    parity = pdf[PARITIES].to_numpy().view(np.uint64)
    rows, step = np.arange(len(key)), 1
    while len(rows):
        rows = rows[rows + step < len(key)]
        # rows of a key go by size, so once a partner is too large all later ones are
        rows = rows[(key[rows] == key[rows + step]) & alike(n[rows], n[rows], n[rows + step])]
        a, b = rows, rows + step
        fits = (root[a] != root[b]) & _room(n, at, a, b)
        if sides:
            fits &= side[a] != side[b]
        a, b = a[fits], b[fits]
        total = n[a] + n[b]
        odd = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
        near = odd <= total - 2 * -(-4 * total // 9)
        if near.any():
            yield pd.DataFrame({"u": fp[a[near]], "v": fp[b[near]]})
        step += 1


def _across(sides: bool):
    """Rows sorted by key and size, of at most KEY_ROWS rows (or two blocks) a key -> candidate pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = int(_starts(pdf["key"].to_numpy())[-1])
            yield from _candidates(pdf.iloc[:last], sides)
            held = pdf.iloc[last:]
        if held is not None:
            yield from _candidates(held, sides)

    return run


#: Sets of at most so many shingles are compared by half of each hash. Up to SLACK shingles more than are shared can
#: then seem to be; pairs for which that decides are compared again by whole hashes.
HALVED, SLACK = 1 << 15, 8


def packed(grams: np.ndarray, whole: bool) -> bytes:
    return grams.tobytes() if whole or len(grams) > HALVED else np.unique((grams >> np.uint64(32)).astype(np.uint32)).tobytes()


def _read(raw: bytes, n: int, whole: bool) -> np.ndarray:
    return np.frombuffer(raw, np.uint64 if whole or n > HALVED else np.uint32)


TILE = ["home", "low", "high"]


def _compare(whole: bool):
    """Rows sorted so that the sets of a tile come before its pairs -> pairs that are alike, or may be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held = None, {}
        for pdf in batches:
            found = []
            for here, is_pair, u, v, n, raw in zip(
                    zip(*[pdf[c] for c in TILE], strict=True), pdf["is_pair"], pdf["u"], pdf["v"], pdf["n"], pdf["grams"], strict=True):
                if here != tile:
                    tile, held = here, {}
                if not is_pair:
                    held[u] = (n, _read(raw, n, whole))
                    continue
                (size, a), (other, b) = held[u], held[v]
                if a.dtype != b.dtype:
                    a, b = (np.unique((x >> np.uint64(32)).astype(np.uint32)) if x.dtype == np.uint64 else x for x in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                exact = a.dtype == np.uint64
                sure = alike(common if exact else common - SLACK, size, other)
                if sure or not exact and alike(common + SLACK, size, other):
                    found.append((u, v, bool(sure)))
            yield pd.DataFrame(found, columns=["u", "v", "sure"])

    return run


class Sets:
    """The shingle sets of `docs`, which are read again when some are needed."""

    def __init__(self, docs: DataFrame):
        self.docs = docs  # th, text, id

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """One text for each of the nodes (fp, th)."""
        wanted = nodes.select("th")
        if nodes.count() <= SENT_IDS:
            wanted = F.broadcast(wanted)
        return self.docs.join(wanted, "th", "left_semi").dropDuplicates(["th"])

    def of(self, nodes: DataFrame, whole: bool) -> DataFrame:
        """fp, n, grams"""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in char_slices(batches, "text", BATCH_CHARS):
                sets = shingle_sets(pdf["text"].tolist())
                yield pd.DataFrame({
                    "fp": _longs(map(name_of, sets)), "n": np.array([len(x) for x in sets], np.int32), "grams": [packed(x, whole) for x in sets]})

        return self.texts_of(nodes).select("text").mapInPandas(run, "fp long, n int, grams binary")


def possible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) without those whose sizes or parities show that they can't be alike."""
    side = lambda name, to: nodes.select(
        F.col("fp").alias(name), F.col("n").cast("long").alias(f"n{to}"), *[F.col("sketch")[i].alias(f"{p}{to}") for i, p in enumerate(PARITIES)])
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    total = F.col("na") + F.col("nb")
    odd = sum((F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in PARITIES), F.lit(0))
    least = F.ceil(4 * total / 9)  # shared shingles of a pair that is alike
    return both.where((odd <= total - 2 * least) & (F.least("na", "nb") >= least)).select(*pairs.columns)


def alike_pairs(pairs: DataFrame, nodes: DataFrame, sets: Sets, whole: bool = False) -> DataFrame:
    """Those of the pairs (u, v) that are alike.

    A pair is compared at the home of its family, the least set that one of its two meets, so that a set moves
    once for all its pairs there. A home with many sets is cut into blocks of TILE_SHINGLES shingles, and
    a task holds two of them.
    """
    pairs = cut_lineage(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    both = pairs.select(F.col("u").alias("fp"), F.col("v").alias("other")).unionAll(pairs.select(F.col("v").alias("fp"), F.col("u").alias("other")))
    met = both.groupBy("fp").agg(F.min("other").alias("least")).select("fp", F.least("fp", "least").alias("home"))
    met = cut_lineage(met.join(nodes.select("fp", "th", "n"), "fp"))
    of = lambda name: met.select(F.col("fp").alias(name), F.col("home").alias(f"h{name}"))
    homed = cut_lineage(pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", F.least("hu", "hv").alias("home")))
    ends = lambda df: df.select("*", F.explode(F.array("u", "v")).alias("fp"))
    blocks = ends(homed).select("home", "fp").distinct().join(met.select("fp", "n"), "fp").groupBy("home").agg(
        F.floor((F.sum("n") - 1) / TILE_SHINGLES + 1).alias("blocks"))
    block = lambda name: F.pmod(F.xxhash64(name), "blocks")
    tiled = homed.join(blocks, "home").select("u", "v", "home", F.least(block("u"), block("v")).alias("low"), F.greatest(block("u"), block("v")).alias("high"))
    tiled = cut_lineage(tiled)
    places = cut_lineage(ends(tiled).select("fp", *TILE).distinct())
    made = sets.of(met.select("fp", "th"), whole).join(F.broadcast(places) if places.count() <= SENT_IDS else places, "fp").select(
        *TILE, F.lit(False).alias("is_pair"), F.col("fp").alias("u"), F.col("fp").alias("v"), "n", "grams")
    asked = tiled.select(*TILE, F.lit(True).alias("is_pair"), "u", "v", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("grams"))
    dealt = made.unionByName(asked).repartition(*TILE).sortWithinPartitions(*TILE, "is_pair")
    found = cut_lineage(dealt.mapInPandas(_compare(whole), "u long, v long, sure boolean"))
    sure = found.where("sure").select("u", "v")
    unsure = found.where("NOT sure").select("u", "v")
    if not whole and not unsure.isEmpty():
        sure = sure.unionAll(alike_pairs(unsure, nodes, sets, True))
    forget(pairs, met, homed, tiled, places)
    return sure


def across_groups(entries: DataFrame, roots: DataFrame, nodes: DataFrame, key_rows: int) -> DataFrame:
    """Candidate pairs of sets that share an indexed shingle and have different roots."""
    rooted = entries.join(roots, entries["fp"] == roots["node"], "left").select("key", "fp", "n", "at", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).where("low <> high")
    sketches = nodes.select("fp", *[F.col("sketch")[i].alias(p) for i, p in enumerate(PARITIES)])
    rows = cut_lineage(rooted.join(mixed.select("key", "rows"), "key").join(sketches, "fp"))
    small = rows.where(F.col("rows") <= key_rows).drop("rows")
    found = small.repartition("key").sortWithinPartitions("key", "n", "fp").mapInPandas(_across(False), "u long, v long")
    large = rows.where(F.col("rows") > key_rows)
    if large.isEmpty():
        return found
    # blocks by size: range partitions, each cut again into runs of key_rows; pairs of blocks whose sizes fit
    ranged = cut_lineage(large.repartitionByRange("key", "n", "fp").sortWithinPartitions("key", "n", "fp").withColumn(
        "block", F.floor(F.monotonically_increasing_id() / key_rows)))
    sizes = cut_lineage(ranged.groupBy("key", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    facing = sizes.alias("a").join(sizes.alias("b"), F.expr("a.key = b.key AND a.block <= b.block AND 5 * a.most >= 4 * b.least")).select(
        F.col("a.key").alias("key"), F.col("a.block").alias("left"), F.col("b.block").alias("right"))
    facing = cut_lineage(facing)
    sides = facing.select("key", "left", "right", F.col("left").alias("block"), F.lit(0).alias("side")).unionAll(
        facing.where("left < right").select("key", "left", "right", F.col("right").alias("block"), F.lit(1).alias("side")))
    dealt = ranged.join(sides, ["key", "block"]).withColumn("key", F.xxhash64("key", "left", "right"))
    whole = lambda df, apart: df.repartition("key").sortWithinPartitions("key", "n", "fp").mapInPandas(_across(apart), "u long, v long")
    return found.unionAll(whole(dealt.where(F.col("left") == F.col("right")), False)).unionAll(whole(dealt.where(F.col("left") < F.col("right")), True))


def near_edges(nodes: DataFrame, sets: Sets, key_rows: int = KEY_ROWS) -> DataFrame:
    """nodes(fp, th, n, first, sketch) -> edges (u, v) of alike sets, with the components of all alike pairs."""
    last = common_shingles(nodes)
    indexed = nodes.select("fp", "n", "first")
    if len(last):

        def hit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                held = [bool(np.isin(x.view(np.uint64), last).any()) for x in pdf["first"]]
                yield pdf.loc[held, ["fp", "th"]]

        changed = cut_lineage(nodes.select("fp", "th", "first").mapInPandas(hit, "fp long, th long"))
        anew = sets.texts_of(changed).mapInPandas(_index(last), _index_schema("long")).select("fp", "n", "first")
        few = F.broadcast(changed.select("fp")) if changed.count() <= SENT_IDS else changed.select("fp")
        indexed = indexed.join(few, "fp", "left_anti").unionByName(anew)
    entries = indexed.select("fp", "n", F.posexplode("first").alias("at", "key")).select("key", "fp", "n", "at")
    entries = cut_lineage(entries.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_shared, "key long, fp long, n int, at int"))
    met = entries.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_heads, "v long, u long")
    met = met.groupBy("v", "u").agg(F.count(F.lit(1)).alias("times")).groupBy("v").agg(F.max_by("u", F.struct("times", "u")).alias("u"))
    first = alike_pairs(possible_pairs(met, nodes), nodes, sets)
    roots = cut_lineage(components(first))
    rest = alike_pairs(across_groups(entries, roots, nodes, key_rows), nodes, sets)
    forget(entries, roots)
    return first.unionAll(rest)


def _index_schema(kind: str) -> str:
    return f"id {kind}, th long, fp long, n int, first array<long>, sketch array<long>"


def alike_components(docs: DataFrame, key: str = "doc_id", text: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per document: key and component_id, the smallest key that can be reached over links.

    Texts without words are alike; texts of fewer than five words have their whole word sequence as the one shingle.
    A component of null keys only has a null id. Repeated rows stay. An empty table gives no rows. Other columns
    are left out. Tables it writes are deleted as soon as later ones hold what they are for.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), texts.alias("text"), F.xxhash64(texts).alias("th"))
    index = cut_lineage(rows.mapInPandas(_index(np.empty(0, np.uint64)), _index_schema(kind)))
    nodes = cut_lineage(index.groupBy("fp").agg(
        F.min("id").alias("least"), F.min("th").alias("th"), F.min("n").alias("n"), F.first("first").alias("first"), F.first("sketch").alias("sketch")))
    prints = cut_lineage(index.select("id", "fp"))
    forget(index)
    edges = near_edges(nodes, Sets(rows.select(F.lit(0).cast("long").alias("id"), "text", "th")), key_rows)
    roots = cut_lineage(components(edges))
    placed = cut_lineage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    forget(nodes, roots)
    least = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(placed.join(least, "root").select("fp", "component_id"))
    forget(placed, least)
    return prints.join(named, "fp").select(F.col("id").alias(key), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of each component, with all its columns.

    Of repeated rows of that key one stays. Documents with a null key can't be named as anyone's copy and stay.
    """
    kept = alike_components(docs, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = docs.join(kept, key, "left_semi").dropDuplicates([key])
    return named.unionByName(docs.where(F.col(key).isNull()))
