"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters
slide over each chunk, and a chunk keeps each filter's largest answer. The document keeps, for each filter, the
largest and the mean answer of its chunks; a small dense layer combines them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import slices, table
from veritrail.llm.samples import training_rows

CHUNK, STEP = 256, 224  # chunks overlap by 32 bytes
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that a task runs at once.
AT_ONCE = 256
#: Training rows: of each label at most so many rows, of at most so many characters together; of a row, an
#: epoch looks at this many chunks, drawn anew each time. Scores always see all chunks.
SAMPLE_EACH, SAMPLE_CHARS, CHUNKS_SEEN, EPOCHS, BATCH = 2000, 20_000_000, 16, 14, 32
#: A small sample is gone through more often, for so many steps.
LEAST_STEPS = 500
THRESHOLD = 0.3


def chunks(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of CHUNK bytes, and how many places of each a filter can stand at; an empty text has one empty row."""
    n = max(1, -(-max(0, len(body) - (CHUNK - STEP)) // STEP))
    data = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    data[:len(body)] = np.frombuffer(body, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]
    lengths = np.minimum(CHUNK, len(body) - STEP * np.arange(n))
    return rows, np.clip(-(-(lengths - WIDTH) // STRIDE) + 1, 1, PLACES)


class Network:
    NAMES = ("embed", "filters", "shift", "dense", "dense_shift", "out", "out_shift")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.embed = normal(256, EMBED, scale=0.5)
        self.filters = normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5)
        self.shift = np.zeros(FILTERS, np.float32)
        self.dense = normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5)
        self.dense_shift = np.zeros(HIDDEN, np.float32)
        self.out = normal(HIDDEN, scale=HIDDEN**-0.5)
        self.out_shift = np.zeros(1, np.float32)
        self.prior = 0.0  # added to the log odds: the table's odds of label 1 against the sample's

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        """(rows, PLACES, WIDTH * EMBED) embedded bytes under each place of a filter."""
        x = self.embed[rows].reshape(len(rows), CHUNK * EMBED)
        at = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
        return np.ascontiguousarray(at)

    def pooled(self, rows: np.ndarray, places: np.ndarray, with_at: bool = False):
        """Largest answer of each filter in each chunk, and where."""
        windows = self._windows(rows)
        answers = (windows.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(rows), PLACES, FILTERS)
        for i in np.flatnonzero(places < PLACES):
            answers[i, places[i]:] = -np.inf
        if not with_at:
            return np.maximum(answers.max(axis=1) + self.shift, 0)
        at = answers.argmax(axis=1)
        top = np.take_along_axis(answers, at[:, None, :], 1)[:, 0] + self.shift
        return np.maximum(top, 0), at, windows, top > 0

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(features @ self.dense + self.dense_shift, 0)
        return hidden, hidden @ self.out + self.out_shift[0]

    def score(self, text: str) -> float:
        rows, places = chunks(text.encode())
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
        for i in range(0, len(rows), AT_ONCE):
            p = self.pooled(rows[i:i + AT_ONCE], places[i:i + AT_ONCE])
            top = np.maximum(top, p.max(axis=0))
            total += p.sum(axis=0)
        z = float(self.head(np.concatenate([top, total / len(rows)])[None].astype(np.float32))[1][0]) + self.prior
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def gradients(self, rows: np.ndarray, places: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over documents, whose chunks begin at `starts`."""
        pooled, at, windows, on = self.pooled(rows, places, True)
        sizes = np.diff(np.r_[starts, len(rows)])
        doc = np.repeat(np.arange(len(starts)), sizes)
        top = np.maximum.reduceat(pooled, starts, axis=0)
        mean = np.add.reduceat(pooled, starts, axis=0) / sizes[:, None]
        features = np.concatenate([top, mean], axis=1).astype(np.float32)
        hidden, z = self.head(features)
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        dh = np.outer(dz, self.out) * (hidden > 0)
        df = dh @ self.dense.T
        first = (pooled == top[doc]).astype(np.float32)  # equal chunks share the largest answer's gradient
        first /= np.add.reduceat(first, starts, axis=0)[doc]
        dp = (df[doc, :FILTERS] * first + df[doc, FILTERS:] / sizes[doc][:, None]) * on
        picked = windows[np.arange(len(rows))[:, None], at]  # (chunks, filters, width * embed)
        dwin = dp[:, :, None] * self.filters.T[None]
        under = rows[np.arange(len(rows))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        dembed = np.zeros_like(self.embed)
        flat = dwin.reshape(-1, EMBED)
        for e in range(EMBED):
            dembed[:, e] = np.bincount(under.ravel(), weights=flat[:, e], minlength=256)
        return {
            "embed": dembed, "filters": np.einsum("cf,cfk->kf", dp, picked), "shift": dp.sum(axis=0),
            "dense": features.T @ dh, "dense_shift": dh.sum(axis=0), "out": hidden.T @ dz, "out_shift": np.array([dz.sum()]),
        }


def train(texts: list[str], labels: np.ndarray, odds: float, seed: int = 7) -> Network:
    """Adam on a sample; `odds` are the odds of label 1 among all labelled rows. Without rows, scores are the odds'."""
    net = Network(seed)
    if not len(texts) or len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.prior = float(np.log(odds)) if 0 < odds < float("inf") else (0.0 if not len(texts) else 5.0 * (1 if labels[0] else -1))
        return net
    rng = np.random.default_rng(seed)
    cut = [chunks(t.encode()) for t in texts]
    state = {k: [np.zeros_like(getattr(net, k), dtype=np.float64)] * 2 for k in Network.NAMES}
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(cut)))
    t, steps = 0, epochs * -(-len(cut) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            parts = []
            for j in some:
                rows, places = cut[j]
                keep = rng.choice(len(rows), CHUNKS_SEEN, replace=False) if len(rows) > CHUNKS_SEEN else slice(None)
                parts.append((rows[keep], places[keep]))
            starts = np.cumsum([0, *[len(r) for r, _ in parts[:-1]]])
            grads = net.gradients(np.concatenate([r for r, _ in parts]), np.concatenate([p for _, p in parts]), starts, labels[some].astype(np.float32))
            t += 1
            rate = 4e-3 * (1 - t / (steps + 1))
            for k, g in grads.items():
                g = g + 1e-5 * getattr(net, k)
                m, v = state[k]
                state[k] = [0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g]
                m, v = state[k][0] / (1 - 0.9**t), state[k][1] / (1 - 0.99**t)
                setattr(net, k, (getattr(net, k) - rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32))
    ones = labels.sum()
    net.prior = float(np.log(odds) - np.log(ones / (len(labels) - ones)))
    return net


def score_documents(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score. Whole texts; null texts are empty, and empty texts are scored like any."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": [net.score(t or "") for t in pdf["text"]]})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", key)


def held_out(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    usable = ~held_out("doc_id")
    rows = training_rows(docs, labels, "quality", usable, 2 * SAMPLE_EACH, SAMPLE_CHARS, SAMPLE_EACH)
    counted = labels.where(usable & F.col("quality").isin(0, 1)).agg(F.count_if(F.col("quality") == 1).alias("ones"), F.count_if(F.col("quality") == 0).alias("zeros")).first()
    return train(rows["text"].tolist(), rows["label"].to_numpy(), (counted["ones"] + 1) / (counted["zeros"] + 1))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= THRESHOLD).

    Learned from labelled rows that are not held out; labels, language, source and id are no input of a score.
    Null texts are empty. Null ids are not held out and are scored. Repeated rows stay. Without labels of both
    kinds every text gets the score of the given label's odds. An empty table gives no rows.
    """
    return score_documents(docs, learn(docs, labels)).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores THRESHOLD or more, with all their columns."""
    net = learn(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([net.score(t or "") for t in texts], dtype=float)

    return docs.where(score("text") >= THRESHOLD)


def op6_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
