import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veritrail.llm import maxent
from veritrail.llm.maxent import held_out_tenth, score, train
from veritrail.llm.wordhash import words

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def base(texts):
    """{id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*words_of(t), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for i, ws in tokens.items()}


def by_place(model, counts, text):
    """log10 probability of a text, word by word, from the model's weights."""
    total, before = 0.0, []
    for w in [*words_of(text), None]:
        h, endings, _ = words([" ".join([*before, w or ""])])
        rows = [r[len(before):len(before) + 1] for r in maxent.features(h, np.array([len(h)]))]
        logs = model.log_softmax(rows)[0].astype(float)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
        if w is None:
            k, c = 0, counts[None]
        else:
            found = model.dictionary.find(h[-1:])[0]
            k, c = model.word_class[found] if found >= 0 else model.ending_class[endings[-1]], counts[w]
        total += logs[k] / math.log(10) + math.log10(c + 0.1) - model.log_total[k]
        before.append(w)
    return total


def test_words_are_known_by_their_hashes():
    rng = random.Random(3)
    texts = ["", " ", "\n\t", "a", "Ab aB\tab", "x" * 700_000 + " y", "Ünï code ÄÖ äö \x0b\x1c z", "İ K"] + [
        "".join(rng.choices("abcAB é\n", k=rng.randrange(400))) for _ in range(300)]
    want = [words_of(t) for t in texts]
    h, endings, per_text = words(texts)
    assert per_text.tolist() == [len(w) for w in want]
    named = {}
    for w, x, e in zip([w for ws in want for w in ws], h.tolist(), endings.tolist(), strict=True):
        assert named.setdefault(w, (x, e)) == (x, e)
    assert len({x for x, _ in named.values()}) == len(named)
    assert [x.size for x in words([])] == [0, 0, 0]


@pytest.mark.parametrize("classed,dictionary", [(8192, 1 << 18), (20, 60), (0, 0)])
def test_scores_are_those_of_single_places(spark, monkeypatch, classed, dictionary):
    monkeypatch.setattr(maxent, "CLASSED", classed)
    monkeypatch.setattr(maxent, "DICTIONARY", dictionary)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(150)] + ["Le", "la,", "é."]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)) + [f"own{i}"] * (i % 3)) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    held = held_out_tenth()
    model = train(docs.where(~held))
    rows = {r["doc_id"]: r for r in score(docs, model, held).collect()}
    want = base(texts)
    counts = Counter(w for i, t in texts.items() if not want[i][0] for w in [*words_of(t), None])
    for i, text in texts.items():
        r = rows[i]
        assert tuple(r)[1:5] == want[i][:4] and r["base_score"] == pytest.approx(want[i][4], rel=1e-9)
        if i % 9 == 0:
            assert r["score"] == pytest.approx(by_place(model, counts, text), rel=1e-5)
    # all words and one unknown word under each ending make up the whole of every class
    share = Counter()
    for w, c in counts.items():
        if w is None:
            share[0] += c + 0.1
        else:
            h, e, _ = words([w])
            at = model.dictionary.find(h)[0]
            share[int(model.word_class[at] if at >= 0 else model.ending_class[e[0]])] += c + 0.1
    for k in model.ending_class.tolist():
        share[k] += 0.1
    assert all(math.log10(share[k]) == pytest.approx(model.log_total[k]) for k in share)


def test_contexts_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = maxent.op11_hashed_maxent(spark, "/root/testdata/sf0.01").collect()
    assert list(rows[0].asDict()) == COLUMNS
    want = base({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in rows} == set(want)
    for r in rows:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4] and r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.2 and sum(r["score"] > r["base_score"] for r in held) > 0.8 * len(held)


def test_sums_of_tasks_are_added_up(spark):
    size, tasks = 1000, 9
    rng = np.random.default_rng(1)
    arrays = [rng.random(size).astype(np.float32) * 100 for _ in range(tasks)]
    rows = [(b, t, maxent._halved(a[maxent.block_of(size, b)])) for t, a in enumerate(arrays) for b in range(maxent.BLOCKS)]
    got = maxent.add_up(spark.createDataFrame(rows, maxent.SENT), size, tasks)
    assert np.allclose(got, np.sum(arrays, axis=0), rtol=0.02)


def test_odd_rows(odd_docs, no_docs):
    held = held_out_tenth()
    model = train(odd_docs.where(~held))
    rows = score(odd_docs, model, held)
    assert rows.columns == COLUMNS
    rows = rows.collect()
    assert len(rows) == odd_docs.count() and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert score(no_docs, model, held).count() == 0
    unread = score(odd_docs, train(no_docs), held).collect()
    assert {r["train_tokens"] for r in unread} == {0} and {r["n_known"] for r in unread} == {0}
    assert all(r["base_score"] == pytest.approx(0) and math.isfinite(r["score"]) for r in unread)
