import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritrail.llm.packing import closest_fill, op2_minimum_bin_slack, pack, patterns
from veritrail.llm.wordbpe import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(docs, rows, tokenizer, window):
    want = {}
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        want.setdefault(d["doc_id"], []).append(ids)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for i, copies in want.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got[i])
        expected = sorted(
            (a, len(ids[a:a + window]), zlib.crc32(np.array(ids[a:a + window], "<u4").tobytes()), len(ids)) for ids in copies for a in range(0, len(ids), window))
        assert pieces == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    return sum(r["length"] for r in rows), len(sequences)


def test_whole_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens, sequences = check(docs, op2_minimum_bin_slack(spark, sf).collect(), tokenizer, 4096)
    assert sequences == -(-tokens // 4096)


@pytest.mark.parametrize("window", [4096, 16, 1])
def test_odd_rows(odd_docs, no_docs, tokenizer, window):
    docs = odd_docs if window > 1 else odd_docs.where("length(text) < 100 or text is null")
    check(docs.collect(), pack(docs, PATH, window).collect(), tokenizer, window)
    assert pack(no_docs, PATH, window).count() == 0


def test_ids_on_request(odd_docs):
    for r in pack(odd_docs, PATH, 64, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=6), st.integers(0, 60))
def test_closest_fill(counts, space):
    chosen = closest_fill(counts, space)
    assert all(0 < n <= counts[k] for k, n in chosen.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= space}
    assert sum(k * n for k, n in chosen.items()) == max(sums)


@settings(deadline=None, max_examples=100)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_use_every_piece_once(counts):
    used = {}
    for times, chosen in patterns(counts, 64):
        assert times > 0 and sum(k * n for k, n in chosen.items()) <= 64
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + times * n
    assert used == counts


@settings(deadline=None, max_examples=300)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"]), st.sampled_from("'sStT re <|>ſİ\x1c\x85")), max_size=60))
def test_word_encoder(text):
    e = encoder(PATH)
    ids = np.frombuffer(e.encode(text), "<u4").tolist()
    assert ids == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_forgets(monkeypatch):
    from veritrail.llm import wordbpe

    e = wordbpe.WordEncoder(PATH)
    monkeypatch.setattr(wordbpe, "REMEMBERED", 3)
    texts = ["one two", "three four five", "six, seven", "one two"]
    assert [np.frombuffer(b, "<u4").tolist() for b in map(e.encode, texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(e) <= 3
