"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child of the current node draws from a hash of the row's key and the child's name:
`-ln(u) / weight`, and the smallest draw wins, so a child gets rows in proportion to its weight. A child's
draw depends on nothing but the key, its own name and its own weight. When a weight grows, a row can only
change to the child that grew, and below children whose weights are unchanged nothing moves: movement is
confined to the subtrees whose weights change. `Tree.grown()` adds shards as a region of their own, so that
every weight on the old paths stays and rows move to the new shards only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import table

#: Parts of a shard that are numbered apart, so that no task orders a whole shard.
NUMBERING_PARTS = 16384


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> (shard number, weight); weights are positive and finite."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def __post_init__(self):
        leaves = [leaf for region in self.regions for rack in region for leaf in rack]
        if not leaves or any(not rack for region in self.regions for rack in region) or not all(self.regions):
            raise ValueError("every region needs a rack and every rack a shard")
        if len({s for s, _ in leaves}) != len(leaves):
            raise ValueError("a shard stands in the tree once")
        if any(not 0 < w < float("inf") for _, w in leaves):
            raise ValueError("weights are positive and finite")

    @staticmethod
    def even(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Tree:
        """Shards 0 to n-1 of weight 1, filled into racks and regions in order."""
        racks = [tuple((s, 1.0) for s in range(i, min(i + per_rack, shards))) for i in range(0, shards, per_rack)]
        return Tree(tuple(tuple(racks[i:i + racks_per_region]) for i in range(0, len(racks), racks_per_region)))

    def grown(self, weights: tuple[float, ...] = (1.0,)) -> Tree:
        """One more region with new shards, numbered on from the largest."""
        top = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (tuple((top + i, w) for i, w in enumerate(weights)),)))


def _nodes(children: list[tuple[int, str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for i, name, w in children])


def _draw(children: Column, key: Column) -> Column:
    """`at` of the child with the smallest draw; equal draws go to the smaller `at`."""
    def one(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(c["name"], key), 11).cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["at"].alias("at"))

    return F.array_min(F.transform(children, one))["at"]


def shard_of(tree: Tree, key: Column) -> Column:
    """The shard of a key. A null key is a key like any other: such rows share one shard."""
    regions, racks, shards = [], [], []
    for r, region in enumerate(tree.regions):
        own = []
        for rack in region:
            # names come from the members, so that a node keeps its draws when others are added beside it
            own.append((len(shards), f"rack of {rack[0][0]}", sum(w for _, w in rack)))
            shards.append(_nodes([(s, f"shard {s}", w) for s, w in rack]))
        regions.append((r, f"region of {region[0][0][0]}", sum(w for _, _, w in own)))
        racks.append(_nodes(own))
    at_region = _draw(_nodes(regions), key)
    at_rack = _draw(F.element_at(F.array(*racks), at_region + 1), key)
    return _draw(F.element_at(F.array(*shards), at_rack + 1), key)


def number_within(df: DataFrame, group: str, order: list[str], spread: str, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each group, without ordering a whole group in one task.

    Rows of a group are dealt by a hash of `spread` into parts; each part is numbered by itself and starts
    where the parts before it end. The counts are a small table of at most NUMBERING_PARTS rows a group.
    """
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(spread)), F.lit(NUMBERING_PARTS)).cast("int")
    df = df.withColumn("_part", part)
    counts = df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (df.join(starts, [group, "_part"]).withColumn(slot, (F.col("_start") + own - 1).cast("long"))
            .drop("_part", "_start"))


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot and, with `grown`, grown_shard.

    `size` is the UTF-8 bytes of the text plus 8, `slot` a gapless number from 0 inside the shard. A null text
    counts as no bytes (size 8, crc 0), like an empty one. Null keys share one shard. Repeated rows share a
    shard and get slots of their own. An empty table gives no rows. Other columns of `docs` are left out, so
    names that clash with those made here don't matter. Texts are measured where they are read and never move.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(tree, F.col(key)).alias("shard"),
        (shard_of(grown, F.col(key)) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_within(rows, "shard", [key, "size", "text_crc32"], key)


def write_shards(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """Whole rows as Parquet, one folder per shard (`_shard=...`)."""
    docs.withColumn("_shard", shard_of(tree, F.col(key))).write.partitionBy("_shard").parquet(path)


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Tree.even(24)
    return shard_documents(table(spark, sf_dir, "documents"), tree, tree.grown())
