"""The prefix trie of conversations, with totals of subtrees by time-forward processing.

Nodes. Turns are numbered within their conversation after one range partitioning by (conversation, turn), so no
task holds a conversation. A prefix is known by the sum of hashes of its (place, role, text): 128 bits, added up in
chunks of CHUNK turns. Grouping prefixes gives the nodes; texts themselves never move.

Runs. A node and its child with the same members are one run: the smallest member and the number of members name
it, all but its lowest node have one child, and conversations end only at the lowest. There are at most two runs a
conversation, however long it is. Runs are the nodes of the tree that totals pass through.

Totals. Runs go through in reverse level order, lowest first (by the depth of their lowest node, then smallest
member); each takes from a priority queue what its children sent to its place in that order, and sends its own
totals to its parent's place. The queue holds what is on its way and spills. A subtree of at most `shard_convs`
members, hanging from a larger one, is a shard; shards are dealt over partitions and each partition's runs are sorted
by Spark (which spills too). What shard roots send to larger runs is summed by receiver, and the few larger runs (a
sum over at most total/shard_convs branches) go through one queue in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import table
from veritrail.llm.spillqueue import SpillingQueue
from veritrail.session import cut_lineage

GROUP, SHARED_TURNS = 5, 9
#: Turns of a conversation that one task orders together.
CHUNK = 4096
#: Members of a subtree that is processed in one piece, at least; and at most so many such subtrees side by side.
SHARD_CONVS, SHARDS = 1024, 4096
#: Messages a queue holds before it spills.
QUEUE_ROWS = 1 << 18
#: Ids that are hashed as one piece.
PIECE_IDS = 4096
#: Keys with more rows than this share of a side are joined by themselves; there can be no more keys than the share's inverse.
HOT_SHARE, HOT_ROWS = 10_000, 1000
#: Rows that may be sent to every task.
SMALL_ROWS = 50_000
#: SHA-256 of nothing.
EMPTY = hashlib.sha256(b"").hexdigest()

ORDERED = "conv_id long, at long, t1 long, t2 long, bytes long"


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows -> with `at`, their number from 1 within the rows of their conversation in this partition."""
    last, seen = None, 0
    for pdf in batches:
        conv = pdf["conv_id"].to_numpy()
        if not len(conv):
            continue
        heads = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        sizes = np.diff(np.r_[heads, len(conv)])
        at = np.arange(len(conv)) - np.repeat(heads, sizes) + 1
        if conv[0] == last:
            at[:sizes[0]] += seen
        last, seen = conv[-1], int(at[-1])
        yield pd.DataFrame({"conv_id": conv, "at": at, "t1": pdf["t1"], "t2": pdf["t2"], "bytes": pdf["bytes"]})


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (hashes of role and text), bytes (of the text), for rows with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_number, ORDERED)
    placed = cut_lineage(placed.withColumn("part", F.spark_partition_id()))
    # a conversation that goes on from one partition into the next: at most one row a partition
    ends = placed.groupBy("part", "conv_id").agg(F.max("at").alias("n"))
    edges = ends.groupBy("part").agg(F.max_by("n", "conv_id").alias("n"), F.max("conv_id").alias("last"), F.min("conv_id").alias("first"))
    starts, carried, going = [], 0, None
    for r in edges.orderBy("part").toLocalIterator():  # three numbers a partition
        if r["first"] == going:
            starts.append((r["part"], going, carried))
        carried = r["n"] + (carried if r["last"] == going else 0)
        going = r["last"]
    before = placed.sparkSession.createDataFrame(starts, "part int, conv_id long, before long")
    return placed.join(F.broadcast(before), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def _chunk(at: Column) -> Column:
    return F.floor(at / CHUNK)


def _chunks(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(_chunk(low), _chunk(high)))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs: c, length; rows: c, chunk, d, t1, t2, bytes, length) of the rebuilt conversations."""
    sizes = cut_lineage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    keep = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    convs = sizes.withColumn("base", base).withColumn("h", keep).join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = cut_lineage(convs.select(
        F.col("conv_id").alias("c"), "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    # a conversation's row stands once for each chunk of its turns, so a long one is many small keys
    own = (
        turns.withColumn("chunk", _chunk(F.col("pos"))).withColumnRenamed("conv_id", "c")
        .join(convs.select("c", "h", "taken", "length", _chunks(F.lit(1), F.col("own")).alias("chunk")), ["c", "chunk"])
        .where("pos > h").select("c", "chunk", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "t1", "t2", "bytes", "length")
    )
    lent = turns.where((F.col("pos") < SHARED_TURNS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    lent = lent.join(convs.select("base", "c", "taken", "length"), "base").where("pos <= taken").select(
        "c", F.lit(0).cast("long").alias("chunk"), F.col("pos").alias("d"), "t1", "t2", "bytes", "length")
    return convs.select("c", "length"), own.unionByName(lent)


def prefixes(rows: DataFrame) -> DataFrame:
    """c, d, k1, k2 (the prefix), p1, p2 (the one before it), bytes, upto (bytes of the whole prefix), ending."""
    h1, h2 = F.xxhash64("d", "t1"), F.xxhash64(F.lit(3), "d", "t2")
    # halves of 32 bits, so that their sums stay whole
    lanes = {"v1": h1.bitwiseAND(0xFFFFFFFF), "v2": F.shiftrightunsigned(h1, 32), "v3": h2.bitwiseAND(0xFFFFFFFF), "v4": F.shiftrightunsigned(h2, 32)}
    names = [*lanes, "bytes"]
    marked = cut_lineage(rows.select("c", "chunk", "d", "bytes", "length", *[v.alias(n) for n, v in lanes.items()]))
    sums = marked.groupBy("c", "chunk").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("c", "chunk", *[F.sum(n).over(earlier).alias(f"b_{n}") for n in names]).where("chunk > 0")
    here = Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.select("*", *[F.sum(n).over(here).alias(f"r_{n}") for n in names]).join(starts, ["c", "chunk"], "left")
    upto = {n: F.col(f"r_{n}") + F.coalesce(f"b_{n}", F.lit(0)) for n in names}
    whole, before = [upto[n] for n in lanes], [upto[n] - F.col(n) for n in lanes]
    return cut_lineage(running.select(
        "c", "d", F.xxhash64(F.lit(1), *whole).alias("k1"), F.xxhash64(F.lit(2), *whole).alias("k2"),
        F.xxhash64(F.lit(1), *before).alias("p1"), F.xxhash64(F.lit(2), *before).alias("p2"), "bytes", upto["bytes"].alias("upto"),
        (F.col("d") == F.col("length")).alias("ending")))


def _root() -> list[Column]:
    """Key of the empty prefix."""
    return [F.xxhash64(F.lit(i), *[F.lit(0).cast("long")] * 4).alias(k) for i, k in ((1, "k1"), (2, "k2"))]


def trie_nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """m (smallest member), n (members), d, k1, k2, p1, p2, bytes, upto of every node, the root with d = 0."""
    nodes = paths.groupBy("k1", "k2", "d").agg(
        F.min("c").alias("m"), F.count(F.lit(1)).alias("n"), *[F.min(x).alias(x) for x in ("p1", "p2", "bytes", "upto")])
    root = convs.agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        *_root(), F.lit(0).cast("long").alias("d"), "m", "n",
        *[F.lit(None).cast("long").alias(x) for x in ("p1", "p2")], F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("upto"))
    return cut_lineage(nodes.unionByName(root))


def _with_parents(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds pm, pn: smallest member and members of the parent of each run's top. Parents of very many are joined apart."""
    total = runs.count()
    kids = runs.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("kids")).where(F.col("kids") > total // HOT_SHARE + HOT_ROWS)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("pm"), F.col("n").alias("pn"))
    hot = cut_lineage(parents.join(F.broadcast(kids.drop("kids")), ["p1", "p2"], "left_semi"))  # fewer than HOT_SHARE rows
    near = runs.join(F.broadcast(hot), ["p1", "p2"], "left")
    rest = near.where("pm IS NULL").drop("pm", "pn").join(parents, ["p1", "p2"], "left")
    return cut_lineage(near.where("pm IS NOT NULL").unionByName(rest))


def trie_runs(nodes: DataFrame) -> DataFrame:
    """One row per run: m, n, low, high (depths of its ends), own (saved by its nodes), through (bytes down to its end), b1, b2 (key of the lowest), pm, pn."""
    runs = nodes.groupBy("m", "n").agg(
        F.min("d").alias("low"), F.max("d").alias("high"), ((F.col("n") - 1) * (F.max("upto") - F.min(F.col("upto") - F.col("bytes")))).alias("own"),
        F.min_by(F.struct("p1", "p2"), "d").alias("top"), F.max_by(F.struct("k1", "k2"), "d").alias("bottom"), F.max("upto").alias("through"))
    runs = cut_lineage(runs.select("m", "n", "low", "high", "own", "through", "top.p1", "top.p2", F.col("bottom.k1").alias("b1"), F.col("bottom.k2").alias("b2")))
    return _with_parents(runs, nodes).drop("p1", "p2")


#: A run as it goes through the queue: its place is (-high, m), its parent's (-(low - 1), pm); `away` if that is elsewhere.
PASSED = ["high", "m", "n", "low", "own", "pm", "away"]
SENT = "m long, n long, kids long, leaves long, below long, to_high long, to_m long"


def _totals(queue_rows: int):
    """Runs (n not null) and summed messages from elsewhere (n null), in reverse level order -> totals of the runs.

    kids, leaves: of the lowest node; below: saved under the run. to_high, to_m: the place elsewhere that these go to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = SpillingQueue(5, queue_rows)
        for pdf in batches:
            done = []
            columns = [pdf[c].to_numpy(np.int64).tolist() for c in (*PASSED, "kids", "leaves", "below")]
            for high, m, n, low, own, pm, away, kids, leaves, below in zip(*columns, strict=True):
                place = (-high, m)
                if n < 0:  # a message, which comes before its receiver
                    queue.push((*place, kids, leaves, below))
                    continue
                kids = leaves = below = 0
                while (row := queue.least()) is not None and row[:2] == place:
                    queue.pop()
                    kids, leaves, below = kids + row[2], leaves + row[3], below + row[4]
                leaves = leaves or 1
                if away:
                    done.append((m, n, kids, leaves, below, low - 1, pm))
                else:
                    if low:
                        queue.push((1 - low, pm, 1, leaves, below + own))
                    done.append((m, n, kids, leaves, below, None, None))
            made = pd.DataFrame(done, columns=["m", "n", "kids", "leaves", "below", "to_high", "to_m"])
            yield made.astype({"to_high": "Int64", "to_m": "Int64"})

    return run


def subtree_totals(runs: DataFrame, paths: DataFrame, total: int, shard_convs: int, queue_rows: int) -> DataFrame:
    """m, n, kids, leaves, below of every run."""
    limit = max(shard_convs, -(-total // SHARDS))
    blank = [F.lit(0).cast("long").alias(x) for x in ("kids", "leaves", "below")]
    ready = runs.select(
        "high", "m", "n", "low", "own", F.coalesce("pm", F.lit(0)).alias("pm"), ((F.col("pn") > limit) & (F.col("n") <= limit)).alias("away").cast("int"), *blank)
    ready = ready.withColumn("away", F.coalesce("away", F.lit(0)))
    small, large = ready.where(F.col("n") <= limit), ready.where(F.col("n") > limit)
    # the shard of a run is the first prefix of its smallest member that has few members
    bottoms = runs.where(F.col("n") > limit).select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))
    bottoms = cut_lineage(bottoms)
    if bottoms.count() <= SMALL_ROWS:
        bottoms = F.broadcast(bottoms)
    depth = paths.join(bottoms, ["k1", "k2"], "left_semi").groupBy("c").agg(F.max("d").alias("under"))
    members = small.select(F.col("m").alias("c")).distinct().join(depth, "c", "left").select("c", (F.coalesce("under", F.lit(0)) + 1).alias("d"))
    if total > limit:
        shard = members.join(paths.select("c", "d", "k1", "k2"), ["c", "d"], "left").select(F.col("c").alias("m"), "k1", "k2")
        small = small.join(shard, "m")
    else:  # the whole trie is one shard
        small = small.withColumns({"k1": F.lit(0), "k2": F.lit(0)})
    order = [F.col("high").desc(), F.col("m"), F.col("n")]
    dealt = small.repartition("k1", "k2").sortWithinPartitions(*order).drop("k1", "k2")
    inside = cut_lineage(dealt.mapInPandas(_totals(queue_rows), SENT))
    sent = inside.where("to_high IS NOT NULL").join(small.select("m", "n", "own"), ["m", "n"]).groupBy("to_high", "to_m").agg(
        F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum(F.col("below") + F.col("own")).alias("below"))
    zero = F.lit(0).cast("long")
    sent = sent.select(
        F.col("to_high").alias("high"), F.col("to_m").alias("m"), F.lit(-1).cast("long").alias("n"), zero.alias("low"), zero.alias("own"), zero.alias("pm"),
        F.lit(0).alias("away"), "kids", "leaves", "below")
    above = large.unionByName(sent).repartition(1).sortWithinPartitions(*order).mapInPandas(_totals(queue_rows), SENT)
    return inside.unionByName(above).select("m", "n", "kids", "leaves", "below")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (k1, k2, c) -> (k1, k2, first, ids): comma-joined ids of at most PIECE_IDS rows of a key."""
    for pdf in batches:
        k1, k2, c = (pdf[x].to_numpy() for x in ("k1", "k2", "c"))
        if not len(c):
            continue
        heads = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        cuts = np.concatenate([np.arange(a, b, PIECE_IDS) for a, b in zip(heads, np.r_[heads[1:], len(c)], strict=True)])
        texts = [",".join(map(str, c[a:b].tolist())) for a, b in zip(cuts, np.r_[cuts[1:], len(c)], strict=True)]
        yield pd.DataFrame({"k1": k1[cuts], "k2": k2[cuts], "first": c[cuts], "ids": texts})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces -> (k1, k2, sha): one hash at a time, fed piece by piece."""
    key, digest = None, None
    for pdf in batches:
        done = []
        for k1, k2, ids in zip(pdf["k1"], pdf["k2"], pdf["ids"], strict=True):
            if (k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["k1", "k2", "sha"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["k1", "k2", "sha"])


def end_digests(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """b1, b2, sha: of each node at which conversations end, SHA-256 of their ids in order, comma-joined.

    Ids are sorted and written into pieces over all tasks; only the hash of a node, which is sequential, is
    one task's, and it reads one piece at a time.
    """
    ends = paths.where("ending").select("k1", "k2", "c").unionByName(convs.where("length = 0").select(*_root(), "c"))
    ends = cut_lineage(ends)
    pieces = cut_lineage(ends.repartitionByRange("k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInPandas(
        _pieces, "k1 long, k2 long, first long, ids string"))
    done = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(_digests, "k1 long, k2 long, sha string")
    return done.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "sha")


def prefix_trie(conversations: DataFrame, shard_convs: int = SHARD_CONVS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; columns as in the last line.

    A conversation c begins with the first crc32(c) % 9 turns of c - c % 5 and goes on with its own after as many.
    Turns are ordered by `turn`, nulls first; rows of equal turns by role, then by a hash of role and text, each a
    turn of its own, so repeated rows stay. Null roles and texts are empty. Rows with a null conv_id belong to no
    conversation and take no part; for negative ids the remainder is negative, as in SQL. An empty table has no conversations and gives no rows, also no root. Other
    columns are left out. Texts of any length are hashed where they are read.
    """
    turns = cut_lineage(numbered_turns(conversations))
    convs, rows = rebuilt_turns(turns)
    paths = prefixes(rows)
    total = convs.count()
    nodes = trie_nodes(convs, paths)
    runs = trie_runs(nodes)
    totals = subtree_totals(runs, paths, total, shard_convs, queue_rows)
    lower = runs.join(totals, ["m", "n"]).join(end_digests(convs, paths), ["b1", "b2"], "left")
    lower = cut_lineage(lower.select("m", "n", "low", "high", "through", "pm", "kids", "leaves", "below", "sha"))
    lows = lower.select("*", _chunks(F.col("low"), F.col("high")).alias("chunk"))
    last = F.col("d") == F.col("high")
    joined = nodes.select("m", "n", "d", "bytes", "upto", _chunk(F.col("d")).alias("chunk")).join(lows, ["m", "n", "chunk"])
    return joined.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("low"), F.col("pm")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("through") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"))


#: The CRC-32 of a decimal number, bit by bit, is a list reduction in SQL.
OP13_SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
    SELECT conv_id AS c, count(*) AS own FROM turns GROUP BY 1
), hashed AS (
    SELECT c, own, c - c % 5 AS base, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
    FROM sizes
), convs AS (
    SELECT a.c, a.base, a.h, least(a.h, coalesce(b.own, 0)) AS taken, least(a.h, coalesce(b.own, 0)) + greatest(a.own - a.h, 0) AS length
    FROM hashed a LEFT JOIN sizes b ON b.c = a.base
), rebuilt AS (
    SELECT v.c, t.pos AS d, t.role, t.text FROM convs v JOIN turns t ON t.conv_id = v.base AND t.pos <= v.taken
    UNION ALL
    SELECT v.c, t.pos - v.h + v.taken AS d, t.role, t.text FROM convs v JOIN turns t ON t.conv_id = v.c AND t.pos > v.h
), paths AS (
    SELECT c, d, octet_length(encode(text)) AS bytes,
        string_agg(md5(md5(role) || md5(text)), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS k,
        CASE WHEN d = 1 THEN '' ELSE string_agg(md5(md5(role) || md5(text)), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS p
    FROM rebuilt
    UNION ALL SELECT c, 0, 0, '', NULL FROM convs
), nodes AS (
    SELECT k, d, min(c) AS m, count(*) AS n, min(bytes) AS bytes, min(p) AS p FROM paths GROUP BY 1, 2
), kids AS (
    SELECT p AS k, count(*) AS kids FROM nodes WHERE p IS NOT NULL GROUP BY 1
), below AS (
    SELECT a.k, sum(CASE WHEN y.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.bytes) AS saved
    FROM nodes x LEFT JOIN kids y ON y.k = x.k JOIN paths a ON a.c = x.m AND a.d <= x.d GROUP BY 1
), ends AS (
    SELECT a.k, string_agg(a.c::VARCHAR, ',' ORDER BY a.c) AS ids FROM paths a JOIN convs v ON v.c = a.c AND v.length = a.d GROUP BY 1
)
SELECT x.m AS conv_id, CAST(x.d AS BIGINT) AS depth, parent.m AS parent_conv_id, x.n AS n_convs, coalesce(y.kids, 0) AS n_children,
    CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x JOIN below b ON b.k = x.k LEFT JOIN nodes parent ON parent.k = x.p LEFT JOIN kids y ON y.k = x.k LEFT JOIN ends e ON e.k = x.k
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
