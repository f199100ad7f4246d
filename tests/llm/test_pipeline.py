import re

import corpus_pipeline
from veritrail.llm import quality, toxicity
from veritrail.llm.common import table
from veritrail.session import cut_lineage
from veritrail.llm.simhash import fingerprint
from tests.llm.test_simhash import brute_components


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, labels, seen = docs.columns, table(spark, sf, "labels"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, docs, sf))
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.toxicity(before, labels).collect() if not r["predicted"]}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: old[i] for i in want} and len(want) < len(old)
        elif name == "quality":
            want = {r["doc_id"] for r in quality.quality(before, labels).collect() if r["predicted"]}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: old[i] for i in want} and len(want) < len(old)
        elif name == "near_dedup":
            ids = sorted(old)
            want = {ids[root] for root in brute_components([fingerprint(old[i]) for i in ids], 4)}  # op9's links among all pairs
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: old[i] for i in want} and len(want) < len(old)
        elif name == "pii":
            new = {r["doc_id"]: r["text"] for r in docs.collect()}
            private = re.compile(r"\S+@\S+\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA\w{16}|\b\d{1,3}(?:\.\d{1,3}){3}\b")
            assert set(new) == set(old)
            for i, text in old.items():
                found = private.findall(text)
                assert not any(f in new[i] for f in found)
                assert found or re.search(r"\d{13}|[0-9a-f]{32}", text) or new[i] == text
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(old)
    assert seen == ["toxicity", "quality", "near_dedup", "pii", "packing"]


def test_run_is_the_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
    key = lambda rows: sorted(map(tuple, rows))
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(docs.collect())


def test_empty_and_odd_documents(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.where("false")):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = cut_lineage(stage(spark, out, "/root/testdata/sf0.001"))
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
