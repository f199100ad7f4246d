import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrail.llm.piecestream import SLICE_CHARS, SPACE, StreamingViterbi, decode_documents, encode_documents, encoder, op4_streaming_viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return encoder(PATH)


def whole_best_path(v, marked):
    """All of the lattice at once: best sum, then the path whose last piece starts first."""
    best, back = [0], [None]
    for end in range(1, len(marked) + 1):
        options = []
        for start in range(max(0, end - v.longest), end):
            i = v.pieces.get(marked[start:end])
            if i is not None:
                options.append((best[start] + v.score[i], -start, i))
        if marked[end - 1] not in v.pieces:
            options.append((best[end - 1] + v.unknown, -(end - 1), None))
        s, start, i = max(options, key=lambda o: o[:2])
        best.append(s)
        back.append((-start, i))
    ids, end = [], len(marked)
    while end:
        start, i = back[end]
        ids = (v.bytes_of(marked[start]) if i is None else [i]) + ids
        end = start
    return ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(deadline=None, max_examples=200)
@given(st.text(st.one_of(st.sampled_from("abcthe nds.\n "), st.characters(exclude_categories=["Cs"])), max_size=50).filter(lambda t: SPACE not in t))
def test_best_path(text):
    e = encoder(PATH)
    got = ids_of(e.encode(text))
    assert got == (whole_best_path(e.v, SPACE + text.replace(" ", SPACE)) if text else [])


@settings(deadline=None, max_examples=200)
@given(st.text(st.one_of(st.sampled_from("ab ▁\x00\n<s>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_round_trip(text):
    e = encoder(PATH)
    assert e.decode(e.encode(text)) == text


def test_stream_in_any_cuts_gives_the_whole_and_keeps_a_small_window(pieces):
    rng = random.Random(1)
    text = SPACE + "".join(rng.choice(["the", "and", "ing", "x", "qu", ".", "é", "\n", "🙂", "token"]) for _ in range(3_000))
    whole = whole_best_path(pieces.v, text)
    for size in (1, 7, 1000, len(text)):
        search, out, widest = StreamingViterbi(pieces.v), [], 0
        for i in range(0, len(text), size):
            out += search.feed(text[i:i + size])
            widest = max(widest, len(search.best))
        assert search.commits > len(text) // 100
        assert out + search.finish() == whole
        assert widest <= 8 * pieces.v.longest


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("abthend. \n▁é中🙂"), max_size=160).filter(lambda t: "▁" not in t), st.integers(1, 60), st.booleans())
def test_slices_commit_the_best_path(text, size, remember):
    v = encoder(PATH).v
    marked = SPACE + text.replace(" ", SPACE)
    search = StreamingViterbi(v, memory=encoder(PATH).memory if remember else None)
    out = []
    for i in range(0, len(marked), size):
        out += search.feed(marked[i:i + size])
    assert out + search.finish() == whole_best_path(v, marked)


def test_ids_of_given_documents_come_from_commits(sf, pieces):
    for d in pd.read_parquet(f"{sf}/documents.parquet")["text"]:
        search, marked = pieces.search(d)
        committed = []
        for i in range(0, len(marked), SLICE_CHARS):
            committed += search.feed(marked[i:i + SLICE_CHARS])
        commits = search.commits
        last = search.finish()
        assert np.array(committed + last, "<u4").tobytes() == pieces.encode(d)
        if len(marked) > 4 * pieces.v.longest:
            assert commits > 0 and len(committed) > 0


def test_paths_that_never_meet(pieces):
    text = "abc" * 4_000
    assert ids_of(pieces.encode(text)) == whole_best_path(pieces.v, SPACE + text)


def test_whole_table(spark, sf, pieces):
    rows = {r["doc_id"]: r for r in op4_streaming_viterbi(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()
    for d in docs[:25]:
        ids = whole_best_path(pieces.v, SPACE + d["text"].replace(" ", SPACE))
        r = rows[d["doc_id"]]
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_odd_rows(odd_docs, no_docs):
    coded = encode_documents(odd_docs, PATH)
    back = decode_documents(coded, PATH).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    want = odd_docs.selectExpr("doc_id", "coalesce(text, '') as text").collect()
    assert sorted(map(tuple, back), key=str) == sorted(map(tuple, want), key=str) and len(back) == len(want), key
    assert encode_documents(no_docs, PATH).count() == 0
