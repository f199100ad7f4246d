import random
import zlib

import numpy as np
import pytest

from veritrail.llm import quality as q


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 8, 255, 256, 257, 480, 481, 5000):
        body = bytes(random.Random(n).choices(range(1, 256), k=n))
        rows, places = q.chunks(body)
        back = bytearray(len(rows) * q.STEP + q.CHUNK)
        for i, row in enumerate(rows):
            back[i * q.STEP:i * q.STEP + q.CHUNK] = row.tobytes()
        assert bytes(back[:n]) == body and not any(back[n:])
        assert places.min() >= 1 and places.max() <= q.PLACES
        if n >= q.WIDTH:  # the last byte stands under some filter place
            assert (len(rows) - 1) * q.STEP + (places[-1] - 1) * q.STRIDE + q.WIDTH >= n


def test_gradients():
    net = q.Network(3)
    for name in q.Network.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    parts = [q.chunks(t.encode()) for t in ("a plain text of some words " * 30, "$$$ @@@ ### %%%", "short")]
    rows, places = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    starts = np.cumsum([0, *[len(p[0]) for p in parts[:-1]]])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        pooled = net.pooled(rows, places)
        sizes = np.diff(np.r_[starts, len(rows)])
        features = np.concatenate([np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / sizes[:, None]], axis=1)
        z = net.head(features)[1]
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    grads = net.gradients(rows, places, starts, labels)
    rng = np.random.default_rng(0)
    for name in q.Network.NAMES:
        value = getattr(net, name)
        order = np.argsort(-np.abs(grads[name]).ravel())[:40]
        for flat in rng.choice(order, min(4, len(order)), replace=False):
            at = np.unravel_index(flat, value.shape)
            keep = value[at]
            value[at] = keep + 1e-5
            up = loss()
            value[at] = keep - 1e-5
            down = loss()
            value[at] = keep
            assert (up - down) / 2e-5 == pytest.approx(grads[name][at], rel=0.02, abs=2e-5), name


def test_score_sees_the_whole_text():
    net = q.Network(1)
    text = "plain words and more of them " * 2_000
    assert net.score(text) != net.score(text + "$%&#@*!")
    assert net.score(text) == net.score(text)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in q.op6_byte_cnn_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = []
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    for x in labels:
        if rows[x["doc_id"]]["held_out"]:
            right.append(rows[x["doc_id"]]["predicted"] == x["quality"])
    assert np.mean(right) > 0.9


def test_odd_rows(odd_docs, no_docs, labels):
    rows = q.quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[2] == by[3]  # empty and null
    assert q.quality(no_docs, labels).count() == 0
    assert len({r["score"] for r in q.quality(odd_docs, labels.where("false")).collect()}) == 1
    kept = q.without_poor(odd_docs, labels)
    assert kept.columns == odd_docs.columns
