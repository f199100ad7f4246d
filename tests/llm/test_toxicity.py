import zlib

import numpy as np
import pytest

from veritrail.llm import toxicity as t


def test_label_model_tells_good_voters_from_bad():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(int)
    flip = lambda rate: np.where(rng.random(len(y)) < rate, 1 - y, y)
    good, fair = flip(0.05), flip(0.2)
    twin = np.where(rng.random(len(y)) < 0.02, 1 - fair, fair)  # goes with the fair voter, also where that errs
    random_votes = rng.integers(0, 2, len(y))
    abstaining = np.where(rng.random(len(y)) < 0.7, -1, flip(0.1))
    votes = np.stack([good, fair, twin, random_votes, abstaining], axis=1)
    given = flip(0.05)
    model = t.LabelModel()
    p = model.fit(votes, given)
    assert ((p > 0.5) == y).mean() > 0.97
    assert abs(model.prior[1] - 0.2) < 0.03 and abs(model.right - 0.95).max() < 0.04
    linked = {frozenset((j, i)) for j, i in enumerate(model.parent) if i >= 0}
    assert frozenset((1, 2)) in linked and not any(3 in pair for pair in linked)


def test_induced_words_need_many_contexts():
    rng = np.random.default_rng(1)
    word = lambda: "w" + "".join(rng.choice(list("abcdefghij"), 6))
    clean = [" ".join(word() for _ in range(30)) for _ in range(300)]
    toxic = [" ".join([*(word() for _ in range(15)), "zorg" + str(rng.choice(list("abcdef"))), *(word() for _ in range(15))]) for _ in range(30)]
    copied = [f"the very same passage with blib inside {word()}" for _ in range(30)]
    found = t.induce(clean + toxic + copied, np.array([0] * 300 + [1] * 60))
    assert "zorg*" in found and not any(p.startswith("blib") for p in found)


def test_every_alternative_of_the_fixed_patterns_votes():
    patterns = t.Patterns([], set())
    threats = [f"{v} {o}" for v in ("kill", "hurt", "hate", "destroy") for o in ("you", "them", "him", "her", "your")]
    for threat in [*threats, "go to hell", "shut up", "drop dead", "Destroy THEM"]:
        _, summary, votes = patterns.describe(f"they will {threat}!")
        assert summary[-1] == 1 and votes[-3] == 1, threat
    for mask in "*@$#":
        assert patterns.describe(f"an idiot and an id{mask}{mask}t")[2][-2] == 1, mask
    _, summary, votes = patterns.describe("a skilled shutter, an idiot in a C# shop")
    assert summary[-1] == 0 and votes[-3] == -1 and votes[-2] == -1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in t.op7_weak_supervision_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(rows[x["doc_id"]]["predicted"], x["toxic"]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x["doc_id"]]["held_out"]]
    assert np.mean([y for p, y in held if p]) > 0.97  # precision
    assert np.mean([p for p, y in held if y]) > 0.8  # recall


@pytest.mark.parametrize("given", [True, False])
def test_odd_rows(odd_docs, no_docs, labels, given):
    labels = labels if given else labels.where("false")
    rows = t.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: r["predicted"] for r in rows}
    assert got[9] == 1 and sum(r["predicted"] for r in rows) == 1
    assert t.toxicity(no_docs, labels).count() == 0
    kept = t.without_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
