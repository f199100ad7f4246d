import zlib
from collections import Counter

import pytest

from veritrail.llm.sharding import Tree, op10_hash_tree_sharding, shard_documents, write_shards


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_hash_tree_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        body = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 8, zlib.crc32(body), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_movement_is_confined(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' as text")
    tree = Tree(((((0, 1.0), (1, 3.0)), ((2, 4.0),)), (((3, 8.0),),)))
    heavier = Tree(((((0, 1.0), (1, 3.0)), ((2, 8.0),)), (((3, 8.0),),)))
    a = {r["doc_id"]: r["shard"] for r in shard_documents(keys, tree).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard_documents(keys, heavier).collect()}
    share = Counter(a.values())
    for shard, weight in ((0, 1), (1, 3), (2, 4), (3, 8)):
        assert abs(share[shard] / 40_000 - weight / 16) < 0.01
    moved = Counter((a[i], b[i]) for i in a if a[i] != b[i])
    # only into the subtree that grew: its region gets rows from the other, its rack from the racks beside it
    assert all(to != 3 and (source == 3 or to == 2) for source, to in moved)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    keys = spark.range(5_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' as text")
    tree = Tree.even(24)
    rows = shard_documents(keys, tree, tree.grown()).collect()
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {24}
    assert 120 < sum(r["grown_shard"] == 24 for r in rows) < 280


def test_odd_rows(odd_docs, no_docs):
    rows = shard_documents(odd_docs, Tree.even(3)).collect()
    assert len(rows) == odd_docs.count() and {r["size"] for r in rows if r["doc_id"] == 3} == {8}
    assert all(r["grown_shard"] is None for r in rows)
    assert shard_documents(no_docs, Tree.even(3)).count() == 0


def test_folders(spark, odd_docs, tmp_path):
    docs = odd_docs.drop("_part")
    write_shards(docs, Tree.even(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


@pytest.mark.parametrize("regions", [(), ((),), (((),),), ((((0, 0.0),),),), ((((0, 1.0), (0, 1.0)),),)])
def test_bad_trees(regions):
    with pytest.raises(ValueError):
        Tree(regions)
