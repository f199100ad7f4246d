"""Packing of token pieces into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one rest, so a piece's place in its document, its length and
its checksum are known where the document is read, and ids never move. What is left is to fill windows with
rests. That needs only how many pieces there are of each length, at most `window` numbers however large the
corpus: window patterns are built from these counts, each used as often as the counts allow, and every piece
finds its place from its rank among the pieces of its length.

A pattern starts with the longest length left and gets the multiset of remaining lengths whose sum comes
closest to the space that is left: a subset-sum dynamic program over bit sets (bit s: sum s can be made), with
a length's count added in halving steps and the chosen counts found by walking the bit sets backwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import slices, table
from veritrail.llm.wordbpe import encoder
from veritrail.session import cut_lineage

WINDOW = 4096
END_ID = 2
#: Pieces of one length that are ranked together.
RANKED = 1024


def closest_fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """Lengths and how many of each, of those at hand, whose sum comes closest to `space` from below."""
    reach, steps = 1, []
    mask = (1 << (space + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], space // length)
        take = 1
        while left > 0 and not reach >> space & 1:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left -= n
            take *= 2
        if reach >> space & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + n
            total -= length * n
    return chosen


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times used, length -> how many) until all pieces are placed.

    Each pattern is used until one of its lengths runs short, so there are few patterns: a length can run
    short about log2(window) times.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    found = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = closest_fill({k: n for k, n in left.items() if n and k <= window - longest}, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        found.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return found


def places(found: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each length, runs of ranks [first_rank, ..) with `per` pieces a window from `first_sequence` at `offset`."""
    rows, used, sequence = [], {}, 0
    for times, chosen in found:
        offset = 0
        for length in sorted(chosen, reverse=True):
            per = chosen[length]
            rows.append((length, used.get(length, 0), per, sequence, offset))
            used[length] = used.get(length, 0) + times * per
            offset += length * per
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "per", "first_sequence", "offset"]).sort_values(["length", "first_rank"])


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for pdf in slices(batches):
            rows, ids = [], []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                body = memoryview(encode(text or "") + end)
                for a in range(0, len(body), 4 * window):
                    piece = body[a:a + 4 * window]
                    rows.append((i, a // 4, len(piece) // 4, zlib.crc32(piece), len(body) // 4))
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
            made = pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens"])
            if with_ids:
                made["ids"] = ids
            yield made

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema)


def ranked(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """pieces with `rank`, a gapless number from 0 among the pieces of a length.

    A length with many pieces is cut into parts by a hash of the piece, ranked part by part; counts of
    parts give where each starts.
    """
    spread = F.pmod(F.xxhash64("id", "start"), F.ceil(F.col("n") / RANKED)).cast("int")
    parted = pieces.join(F.broadcast(counts), "length").withColumn("part", spread).drop("n")
    sizes = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32"))
    return parted.join(starts, ["length", "part"]).withColumn("rank", F.col("first") + own - 1).drop("part", "first")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on request).

    Pieces of a sequence fill it from 0 without gaps; at its end it is padded to `window`. A null or empty
    text is the one id `end_id`. Texts of any length are read whole. Repeated rows and null keys are documents
    of their own. An empty table gives no rows. Other columns of `docs` are left out.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer, window, end_id, key, text, with_ids))
    counts = cut_lineage(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")))  # at most `window` rows
    at = places(patterns({r["length"]: r["n"] for r in counts.collect()}, window))
    base = 1 << 48
    starts = at["length"].to_numpy(np.int64) * base + at["first_rank"].to_numpy(np.int64)
    per, first, offset = (at[c].to_numpy(np.int64) for c in ("per", "first_sequence", "offset"))
    rank_at = at["first_rank"].to_numpy(np.int64)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        run = np.searchsorted(starts, length.to_numpy() * base + rank.to_numpy(), side="right") - 1
        past = rank.to_numpy() - rank_at[run]
        return pd.DataFrame({"sequence_id": first[run] + past // per[run], "offset": offset[run] + past % per[run] * length.to_numpy()})

    rows = ranked(pieces, counts).withColumn("at", place("length", "rank"))
    return rows.select(F.col("id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def op2_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
