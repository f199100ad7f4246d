"""Substring search by pieces against a scan."""

import random

from veritrail.operators import textindex


def test_same_rows_as_a_scan(spark, tmp_path):
    rng = random.Random(4)
    letters = "abcAB é\n_%"
    texts = {i: "".join(rng.choices(letters, k=rng.randrange(0, 60))) for i in range(200)} | {900: None, 901: "", 902: "a", 903: "é", 904: "ab" * 30_000}
    terms = ["a", "B", "é", "ab", "_", "%a", "abc", "ABc", "a b", "abab" * 20, "zzz", "", None, "abz", "\n", "cab é"] + ["".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(40)]
    df = spark.createDataFrame(list(texts.items()), "id long, body string").repartition(4)
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id long, term string")
    index = textindex.build_index(df, "id", "body", str(tmp_path / "index"))
    got = {tuple(r) for r in textindex.search(index, asked, df, "id", "body").collect()}
    assert got == {(i, j) for i, t in enumerate(terms) if t for j, x in texts.items() if x and t.lower() in x.lower()}


def test_postings_are_lists_of_a_bounded_number_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "LISTED", 128)
    df = spark.range(0, 1024, 1, 2).selectExpr("id", "'abcd' as body")
    index = textindex.build_index(df, "id", "body", str(tmp_path / "index"))
    assert [len(r["keys"]) for r in index.postings.collect()] == [128] * 16  # two pieces, eight lists each
    assert sorted(tuple(r) for r in index.sizes.select("piece", "texts").collect()) == [("abc", 1024), ("bcd", 1024)]


def test_reads_only_partitions_of_the_terms(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "concat('text number ', id, ' of many') as body")
    index = textindex.build_index(df, "id", "body", str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "ber 2718 o")], "term_id long, term string")
    found = textindex.candidates(index, asked)
    assert found.count() < 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert [tuple(r) for r in textindex.search(index, asked, df, "id", "body").collect()] == [(1, 2718)]
