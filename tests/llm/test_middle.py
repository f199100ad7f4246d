import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from veritrail.llm import middle
from veritrail.llm.wavelet import WaveletMatrix

CUTS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\A[^\w🙂]+|[\w🙂]+[^\w🙂]*", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+"}


def test_rank_and_select_count():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 1000, 5000):
        classes = rng.choice(6, size, p=[.5, .2, .1, .1, .05, .05]).astype(np.uint8)
        matrix = WaveletMatrix(classes, 3)
        at = np.arange(size + 1)
        for c in range(8):
            here = np.flatnonzero(classes == c)
            assert np.array_equal(matrix.rank(c, at), np.r_[0, np.cumsum(classes == c)][:size + 1])
            assert np.array_equal(matrix.select(c, np.arange(len(here))), here)


def by_hand(text, key, unit, rate=100, spm_rate=50):
    units = re.findall(CUTS[unit], text)
    assert "".join(units) == text
    h = [int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", CUTS)
def test_transform_is_that_of_lists_of_units(unit):
    rng = random.Random(unit)
    texts = ["", "\n", "\n\n\n", "a", "no end", "a\n", " lead", "<P>", "a<S>b", "<M", "<<", "Ü中🙂\n🙂\n"] + [
        "".join(rng.choices("ab \n.!é<", k=rng.randrange(1, 300))) for _ in range(300)]
    keys = list(range(len(texts)))
    got = middle.transform(texts, keys, middle.UNITS[unit], 7, 60, 30)
    assert got == [by_hand(t, k, unit, 60, 30) for t, k in zip(texts, keys, strict=True)]


def test_documents_go_there_and_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = middle.fill_in_middle(docs).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    rows = {r["doc_id"]: r for r in made.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(rows) == set(texts) and {r["form"] for r in rows.values()} == {"psm", "spm"}
    for i, text in texts.items():
        r = rows[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(text, i, "line") and r["back"] == text


def test_odd_rows(odd_docs, no_docs):
    made = middle.fill_in_middle(odd_docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted(r["back"] for r in rows) == sorted(texts)
    for r in rows:
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert tuple(r)[1:6] == by_hand(r["back"], key, "line")
    assert middle.fill_in_middle(no_docs).count() == 0
