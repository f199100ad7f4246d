import hashlib
import random

import pytest

from veritrail.llm import fingerprints
from veritrail.llm.fingerprints import Fingerprint, edit_fingerprint, edited, fingerprint_documents


def of(text):
    return Fingerprint.of(text.encode())


def test_order_does_not_matter_and_content_does():
    lines = ["first paragraph here", "second one, longer than that", "", "x", "second one, longer than that"]
    shuffled = lines[:]
    random.Random(1).shuffle(shuffled)
    assert of("\n".join(lines)) == of("\n".join(shuffled))
    assert str(of("a\nb")) != str(of("a b")) and of("a\na") != of("a") and of("ab") != of("ba")


def test_parts_are_put_in_and_taken_out():
    a, b, c = "one paragraph of words", "another paragraph of words", "third"
    assert of(f"{a}\n{b}") + of(c) == of(f"{a}\n{b}\n{c}")
    assert of(f"{a}\n{b}\n{c}") - of(b) == of(f"{c}\n{a}")
    assert Fingerprint.parse(str(of(a))) == of(a)


@pytest.mark.parametrize("text", ["", "a", "abcd", "ä\nö\nü\n\n", "line one is here\nline two is there\nline three", "no breaks at all in this text", "\n\n\n\n"])
@pytest.mark.parametrize("following", ["", "z", "next\ntext\nwith lines"])
def test_edits_agree_with_new_sums(text, following):
    changed, at = edited(text, following)
    n = len(text) // 4
    assert changed == text[:len(text) - n] + following[:n]
    assert edit_fingerprint(of(text), text, changed, at) == of(changed)


def test_likeness_follows_shared_text():
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b = text(400), text(400)
    assert of(a).likeness(of(a)) == 1 and of(a).likeness(of(b)) < 0.3
    assert abs(of(a).likeness(of(a[:-700] + b[-700:])) - 0.75) < 0.15
    assert of("").likeness(of("x")) == 0


def test_long_texts_in_pieces(monkeypatch):
    text = "some words and\nlines of them " * 500
    whole = of(text)
    monkeypatch.setattr(fingerprints, "CHUNK", 100)
    assert of(text) == whole


@pytest.mark.parametrize("block_docs", [4096, 20, 1])
def test_documents(spark, sf, monkeypatch, block_docs):
    monkeypatch.setattr(fingerprints, "BLOCK_DOCS", block_docs)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs if block_docs > 1 else docs.where("doc_id % 7 < 2")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        new = text[:len(text) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(of(text)), str(of(new)))
        assert r["near_edited"] == pytest.approx(of(text).likeness(of(new))) and r["near_next"] == pytest.approx(of(text).likeness(of(following)))


@pytest.mark.parametrize("block_docs", [4096, 3])
def test_odd_rows(odd_docs, no_docs, monkeypatch, block_docs):
    monkeypatch.setattr(fingerprints, "BLOCK_DOCS", block_docs)
    rows = fingerprint_documents(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fingerprint_documents(no_docs).count() == 0
    alone = fingerprint_documents(odd_docs.where("doc_id = 8")).first()
    assert alone["near_next"] == 1.0
