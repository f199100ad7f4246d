"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) P(word | class). The class has a softmax over the weights of its context's
features: the word before, the two before, the second and the third before by themselves, each hashed to one of
ROWS rows of weights, and a bias. A word has its share of the counts of its class, with 0.1 added to each count
and one place of 0.1 for each ending under which unknown words come, so all probabilities of a place add up to 1.

Counts of words, the totals of classes and the training are over all training texts. Classes are clusters of the
commonest words and, for all other words, of word endings, by the common words that stand beside them. Training
makes ROUNDS passes, each over its own part of the texts and all together over every one: tasks sum observed and
expected counts of (feature, class), the sums are added up over tasks in two steps, and each weight is moved
by a gradient step on the logarithm of their ratio.

Scores: a bounded dictionary of the commonest words goes with the model; counts of all other words, however many,
are joined on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import char_slices, table
from veritrail.llm.wordhash import ENDINGS, mix, words
from veritrail.session import cut_lineage

ADDED = 0.1
#: Rows of weights, classes (the first is that of the end of a text), passes of training.
ROWS, CLASSES, ROUNDS = 1 << 15, 32, 3
#: How far a weight goes in each round, and the count by which a ratio is drawn towards 1.
STEPS, DRAWN = (0.45, 0.45, 0.35), 4.0
#: Words with a class of their own, words whose counts go with the model, common words that classes are learned from.
CLASSED, DICTIONARY, ANCHORS = 8192, 1 << 18, 31
#: Characters that are looked at together; places whose softmax is computed together; words that are counted together.
BATCH_CHARS, PLACES, COUNTED = 1 << 19, 1 << 14, 1 << 21
#: Pieces in which sums of tasks are sent.
BLOCKS = 64
_EDGE = np.uint64(0x5EED)  # stands before the first word


def features(h: np.ndarray, per_text: np.ndarray) -> list[np.ndarray]:
    """Rows of the hashed features of every place: each text's words, then its end."""
    ends = np.cumsum(per_text + 1)
    starts = ends - per_text - 1
    stream = np.full(int(ends[-1]) if len(ends) else 0, _EDGE)
    inner = np.ones(len(stream), bool)
    inner[ends - 1] = False
    stream[inner] = h
    at = np.arange(len(stream)) - np.repeat(starts, per_text + 1)
    before = []
    for back in (1, 2, 3):
        shifted = np.full(len(stream), _EDGE)
        shifted[back:] = stream[:-back] if len(stream) > back else stream[:0]
        shifted[at < back] = _EDGE
        before.append(shifted)
    one, two, three = before
    u = np.uint64
    made = (one * u(3) + u(1), one * u(0x9E3779B97F4A7C15) + mix(two + u(7)), two * u(5) + u(2), three * u(7) + u(3))
    return [(mix(x) >> u(64 - ROWS.bit_length() + 1)).astype(np.intp) for x in made]


class Dictionary:
    """Place of hashes in a sorted list, by their top bits."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.hashes = sorted_hashes
        self.bits = max(1, len(sorted_hashes).bit_length())
        tops = (sorted_hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(tops, np.arange((1 << self.bits) + 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 where a hash is not in the list."""
        out = np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.hashes[at[todo]] == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


@dataclass
class Model:
    tokens: int  # training tokens, ends included
    known: int  # different ones
    dictionary: Dictionary
    log_count: np.ndarray  # log10(count + ADDED) of its words
    word_class: np.ndarray  # of its words
    ending_class: np.ndarray
    end_log_count: float
    log_total: np.ndarray  # log10 of the summed counts of each class
    weights: np.ndarray
    bias: np.ndarray
    rare: DataFrame | None = field(default=None)  # h, ending, n of all training words outside the dictionary

    def for_tasks(self) -> Model:
        return Model(**{**self.__dict__, "rare": None})

    def classes(self, h: np.ndarray, endings: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the dictionary of each word, class of each place of the texts)."""
        found = self.dictionary.find(h)
        own = self.ending_class[endings]
        if len(self.word_class):
            own = np.where(found >= 0, self.word_class[found], own)
        out = np.zeros(len(h) + len(per_text), np.intp)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(per_text + 1) - 1] = False
        out[inner] = own
        return found, out

    def log_softmax(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the probabilities of the classes at each place."""
        total = self.weights[rows[0]]
        for r in rows[1:]:
            total += self.weights[r]
        total += self.bias
        total -= total.max(axis=1, keepdims=True)
        total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
        return total

    def class_scores(self, rows: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """log10 P(class | before) - log10 of the class's total, at each place."""
        out = np.empty(len(classes))
        for a in range(0, len(classes), PLACES):
            part = slice(a, a + PLACES)
            logs = self.log_softmax([r[part] for r in rows])
            out[part] = logs[np.arange(len(logs)), classes[part]] / math.log(10)
        return out - self.log_total[classes]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return char_slices(batches, "text", BATCH_CHARS, 2048)


def count_words(texts: DataFrame) -> DataFrame:
    """h, ending, n of all words of `text`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def summed():
            h, e = (np.concatenate(x) for x in zip(*held, strict=True))
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            return pd.DataFrame({"h": h.view(np.int64), "ending": e[at], "n": n})

        for pdf in _batches(batches):
            h, e, _ = words(pdf["text"].tolist())
            held.append((h, e))
            size += len(h)
            if size >= COUNTED:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    return texts.select("text").mapInPandas(run, "h long, ending int, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))


def _halved(x: np.ndarray) -> bytes:
    """Upper halves of single-precision numbers: 8 bits of mantissa."""
    return ((np.ascontiguousarray(x, np.float32).view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)).astype(np.uint16).tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, slot, sums) -> one row for each block and slot."""
    total: dict[tuple, np.ndarray] = {}
    for pdf in batches:
        for block, slot, raw in zip(pdf["block"], pdf["slot"], pdf["sums"], strict=True):
            part = _whole(raw).astype(np.float64)
            total[block, slot] = total[block, slot] + part if (block, slot) in total else part
    yield pd.DataFrame([(*k, _halved(x)) for k, x in total.items()], columns=["block", "slot", "sums"])


def add_up(parts: DataFrame, size: int, tasks: int) -> np.ndarray:
    """Arrays of `size` numbers that tasks sent in BLOCKS pieces, added up: first over some tasks each, then over those sums."""
    slots = max(1, math.isqrt(tasks))
    first = parts.withColumn("slot", F.pmod("slot", F.lit(slots))).repartition("block", "slot").mapInPandas(_sums, SENT)
    last = first.withColumn("slot", F.lit(0)).repartition("block").mapInPandas(_sums, SENT)
    out = np.zeros(size)
    for r in last.toLocalIterator():  # BLOCKS rows, whatever the input
        out[block_of(size, r["block"])] = _whole(r["sums"])
    return out


SENT = "block int, slot int, sums binary"


def block_of(size: int, block: int) -> slice:
    return slice(size * block // BLOCKS, size * (block + 1) // BLOCKS)


def _sent(flat: np.ndarray) -> pd.DataFrame:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    return pd.DataFrame([(b, task, _halved(flat[block_of(len(flat), b)])) for b in range(BLOCKS)], columns=["block", "slot", "sums"])


def neighbours(texts: DataFrame, units: Dictionary, unit_of: np.ndarray, anchors: np.ndarray, tasks: int) -> np.ndarray:
    """How often each unit (common word, or ending of the others) has each anchor, or another word, before and after it."""
    n_units, width = len(unit_of) + ENDINGS, 2 * (ANCHORS + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(n_units * width, np.int64)
        for pdf in _batches(batches):
            h, endings, per_text = words(pdf["text"].tolist())
            if not len(h):
                continue
            found = units.find(h)
            unit = len(unit_of) + endings
            anchor = np.zeros(len(h), np.int64)
            if len(unit_of):
                unit = np.where(found >= 0, unit_of[found], unit)
                anchor = np.where(found >= 0, anchors[found], 0)
            text = np.repeat(np.arange(len(per_text)), per_text)
            same = text[1:] == text[:-1]
            cells = np.r_[(unit[1:] * width + anchor[:-1])[same], (unit[:-1] * width + ANCHORS + 1 + anchor[1:])[same]]
            seen += np.bincount(cells, minlength=len(seen))
        yield _sent(seen)

    return add_up(texts.select("text").mapInPandas(run, SENT), n_units * width, tasks).reshape(n_units, width)


def cluster(counts: np.ndarray, n: int, weight: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Cluster of each row by the square roots of its shares, weighted k-means with a fixed beginning."""
    points = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    rng = np.random.default_rng(11)
    weight = weight + 1e-9
    centres = points[[int(np.argmax(weight))]]
    while len(centres) < n:
        far = np.min(((points[:, None, :] - centres[None, -1:, :]) ** 2).sum(axis=2), axis=1) if len(centres) == 1 else np.minimum(
            far, ((points - centres[-1]) ** 2).sum(axis=1))
        odds = np.sqrt(weight) * far + 1e-12
        centres = np.vstack([centres, points[rng.choice(len(points), p=odds / odds.sum())]])
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        total = np.bincount(near, weight, n)
        for j in range(points.shape[1]):
            centres[:, j] = np.where(total > 0, np.bincount(near, weight * points[:, j], n) / np.maximum(total, 1e-12), centres[:, j])
    return near


def expectations(texts: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of (row of weights, class) over all places of the texts."""
    sent = model.for_tasks()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, expected = np.zeros(ROWS * CLASSES, np.float32), np.zeros((ROWS, CLASSES), np.float32)
        for pdf in _batches(batches):
            h, endings, per_text = words(pdf["text"].tolist())
            _, classes = sent.classes(h, endings, per_text)
            rows = features(h, per_text)
            for a in range(0, len(classes), PLACES):
                here, part = classes[a:a + PLACES], [r[a:a + PLACES] for r in rows]
                shares = np.exp(sent.log_softmax(part))
                for r in part:
                    np.add.at(seen, r * CLASSES + here, np.float32(1))
                    order = np.argsort(r.astype(np.uint16), kind="stable")
                    ordered = r[order]
                    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                    expected[ordered[heads]] += np.add.reduceat(shares[order], heads, axis=0)
        yield _sent(np.concatenate([seen, expected.ravel()]))

    both = add_up(texts.select("text").mapInPandas(run, SENT), 2 * ROWS * CLASSES, tasks)
    return both[:ROWS * CLASSES].reshape(ROWS, CLASSES), both[ROWS * CLASSES:].reshape(ROWS, CLASSES)


def _threshold(counted: DataFrame, most: int) -> int:
    """The smallest count that at most `most` words reach. Counts of counts are summed in steps of a hundredth."""
    step = F.when(F.col("n") < 100, F.col("n")).otherwise(F.floor(100 * F.pow(1.01, F.floor(F.log(F.col("n") / 100) / math.log(1.01)))))
    sizes = sorted(((r["step"], r["words"]) for r in counted.groupBy(step.cast("long").alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, held = None, 0
    for n, number in sizes:  # a few thousand at most
        held += number
        if held > most:
            break
        least = n
    return least if least is not None else (sizes[0][0] * 2 + 2 if sizes else 1)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of all texts of `docs`. An empty table gives a model in which every word is unknown."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.lit("round"), F.col(key)), F.lit(ROUNDS)).alias("turn"))
    tasks = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    counted = cut_lineage(count_words(texts))
    ends = texts.count()
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
    least = _threshold(counted, DICTIONARY)
    common = counted.where(F.col("n") >= least).toPandas()  # at most DICTIONARY rows
    common = common.assign(h=common["h"].to_numpy(np.int64).view(np.uint64)).sort_values(["n", "h", "ending"], ascending=[False, True, True])
    # of two words with one hash but different endings, the dictionary keeps the commoner
    common = common.drop_duplicates("h")
    rank = np.arange(len(common))
    order = np.argsort(common["h"].to_numpy(), kind="stable")
    h, n, ending, rank = common["h"].to_numpy()[order], common["n"].to_numpy(np.int64)[order], common["ending"].to_numpy(np.int64)[order], rank[order]
    dictionary = Dictionary(h)
    classed = rank < CLASSED
    anchor = np.where(rank < ANCHORS, rank + 1, 0)
    units, unit_of = Dictionary(h[classed]), rank[classed]
    beside = neighbours(texts, units, unit_of, anchor[classed], tasks)
    weight = np.r_[np.zeros(len(unit_of)), np.zeros(ENDINGS)]
    weight[:] = beside.sum(axis=1)
    found = 1 + cluster(beside, CLASSES - 1, weight)
    ending_class = found[len(unit_of):]
    word_class = ending_class[ending]
    if len(unit_of):
        word_class = np.where(classed, found[np.minimum(rank, len(unit_of) - 1)], word_class)
    # totals of classes: own words, then for each ending all others and the place of unknown ones
    totals = np.zeros(CLASSES)
    totals[0] = ends + ADDED
    np.add.at(totals, word_class, n + ADDED)
    rare = counted.where(F.col("n") < least)
    if len(common) < counted.where(F.col("n") >= least).count():
        own = counted.sparkSession.createDataFrame(pd.DataFrame({"h": h.view(np.int64), "ending": ending.astype(np.int32)}))
        rare = counted.join(F.broadcast(own), ["h", "ending"], "left_anti")
    for r in rare.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # at most ENDINGS rows
        totals[ending_class[r["ending"]]] += r["n"] + ADDED * r["words"]
    np.add.at(totals, ending_class, ADDED)
    totals = np.maximum(totals, ADDED / 2)  # a class without a word is never seen
    share = totals / totals.sum()
    model = Model(
        tokens=int(sums["n"]) + ends, known=int(sums["words"]) + bool(ends), dictionary=dictionary, log_count=np.log10(n + ADDED), word_class=word_class,
        ending_class=ending_class, end_log_count=math.log10(ends + ADDED), log_total=np.log10(totals),
        weights=np.zeros((ROWS, CLASSES), np.float32), bias=np.log(share).astype(np.float32), rare=rare)
    for turn, step in zip(range(ROUNDS), STEPS, strict=True):
        seen, expected = expectations(texts.where(F.col("turn") == turn), model, tasks)
        model.weights += (step * np.log((seen + DRAWN * share) / (expected + DRAWN * share))).astype(np.float32)
    return model


SCORED = "held_out boolean, n_tokens long, n_known long, counts double, classes double, h array<long>, ending array<int>, times array<int>"


def score(docs: DataFrame, model: Model, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has one token, its end. Texts of any length are scored whole. Repeated rows and null keys
    stay rows of their own; an empty table gives no rows. Other columns of `docs` are left out.
    """
    kind, sent = docs.schema[key].dataType.simpleString(), model.for_tasks()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(batches):
            h, endings, per_text = words(pdf["text"].tolist())
            found, classes = sent.classes(h, endings, per_text)
            places = sent.class_scores(features(h, per_text), classes)
            text_of = np.repeat(np.arange(len(per_text)), per_text)
            known = found >= 0
            logs = np.bincount(text_of[known], sent.log_count[found[known]], len(per_text)) + sent.end_log_count
            n_known = np.bincount(text_of[known], minlength=len(per_text)) + (sent.tokens > 0)
            by_text = np.add.reduceat(places, np.cumsum(per_text + 1) - per_text - 1)
            # words outside the dictionary, once a text
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((endings[rare], h[rare], text_of[rare]))]
            t, w, e = text_of[order], h[order], endings[order]
            heads = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (w[1:] != w[:-1]) | (e[1:] != e[:-1])]) if len(order) else order
            times = np.diff(np.r_[heads, len(order)]).astype(np.int32)
            cuts = np.searchsorted(t[heads], np.arange(1, len(per_text)))
            yield pd.DataFrame({
                "id": pdf["id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "n_tokens": per_text + 1, "n_known": n_known, "counts": logs, "classes": by_text,
                "h": np.split(w[heads].view(np.int64), cuts), "ending": np.split(e[heads].astype(np.int32), cuts), "times": np.split(times, cuts)})

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held_out"))
    scored = cut_lineage(rows.mapInPandas(run, f"id {kind}, {SCORED}").withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("h", "ending", "times")).alias("w")).select("row", "w.h", "w.ending", "w.times")
    counts = model.rare.select("h", "ending", "n")
    joined = rare.join(counts, ["h", "ending"], "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    whole = scored.drop("h", "ending", "times").join(joined, "row", "left")
    logs = F.col("counts") + F.coalesce("more", F.lit(0.0))
    base = math.log10(model.tokens + ADDED * (model.known + 1))
    return whole.select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"), (logs + F.col("classes")).alias("score"))


def held_out_tenth(key: str = "doc_id") -> Column:
    """Rows kept from training; a null key counts as an empty one and is kept from it."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op11_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out_tenth()
    return score(docs, train(docs.where(~held)), held)
