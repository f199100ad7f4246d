"""Toxicity by weak supervision.

1. Many voters look at a text: lexicons of insults, patterns of threats and masked insults, how many and how
   densely such words stand, and lexicons induced from training rows (words and word beginnings that mark toxic
   rows in many different contexts, so that a copied passage marks nothing).
2. A generative label model explains the votes by a hidden class: each voter has its accuracy for either class,
   and voters that go together given the class are linked in a tree, so that they are not counted twice. EM
   estimates all of it; the given label is one more voter with an accuracy of its own, as labels err too.
3. A linear classifier on what the text holds is trained on the model's posterior labels. It alone scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import slices, table
from veritrail.llm.samples import training_rows

#: Insults in four languages, by kind.
LEXICONS = {
    "person": "idiot moron loser clown scum imbecile fool jerk freak creep bastard "
              "idiota imbécil payaso cabrón idiote imbécile crétin connard salaud trottel depp arschloch versager",
    "quality": "stupid pathetic worthless disgusting dumb useless ugly vile filthy "
               "estúpido asqueroso patético inútil stupide pathétique dégoûtant minable dumm erbärmlich wertlos ekelhaft",
    "thing": "trash garbage filth vermin crap basura escoria ordure déchet abschaum müll dreck",
}
THREAT = re.compile(r"\b(?:kill|hurt|hate|destroy) (?:you|them|him|her|your)\b|\bgo to hell\b|\bshut up\b|\bdrop dead\b")
MASKED = re.compile(r"\b\w+[*@$#]+\w+\b")
#: One of these is in every text in which the patterns are found.
THREAT_WORDS, MASKS = frozenset("kill hurt hate destroy hell shut drop".split()), "*@$#"
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7, 8, 9)
MAX_PATTERNS = 1500
#: Training rows: at most so many labelled rows of at most so many characters together.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000_000
THRESHOLD = 0.7


def units(text: str) -> tuple[list[str], set[str]]:
    words = WORD.findall(text.lower())
    return words, set(words)


def induce(texts: list[str], labels: np.ndarray) -> list[str]:
    """Words, and beginnings `stem*`, that mark label 1: frequent there, hardly elsewhere, in differing contexts.

    A pattern must be much likelier in rows of label 1 than chance gives, nine times in ten a sign of it, and
    at least 60 % of its occurrences must have neighbours of their own; copies of one text don't.
    """
    positive = labels == 1
    toxic = [t for t, p in zip(texts, positive, strict=True) if p]

    def patterns_of(w: str) -> tuple[str, ...]:
        return () if len(w) < 3 or w.isdigit() else (w, *[w[:n] + "*" for n in STEMS if len(w) > n])

    # most patterns are in a row or two; only of the others neighbours are kept
    seen = Counter()
    for text in toxic:
        seen.update({p for w in units(text)[1] for p in patterns_of(w)})
    seen = {p: n for p, n in seen.items() if n >= 5}
    occurs, contexts = Counter(), defaultdict(set)
    for text in toxic:
        words = units(text)[0]
        for i, w in enumerate(words):
            for p in patterns_of(w):
                if p in seen:
                    occurs[p] += 1
                    contexts[p].add(hash((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")))
    varied = {p for p in seen if len(contexts[p]) >= 0.6 * occurs[p]}
    del contexts
    elsewhere = Counter()
    for text in (t for t, p in zip(texts, positive, strict=True) if not p):
        distinct = units(text)[1]
        elsewhere.update(varied & distinct)
        for n in STEMS:
            elsewhere.update(varied & {w[:n] + "*" for w in distinct if len(w) > n})
    base = max(1e-3, positive.mean()) if len(labels) else 1.0
    found = []
    for p in varied:
        t, n = seen[p], elsewhere[p]
        rate = t / (t + n)
        gain = 2 * (t * math.log(rate / base) + (n * math.log((1 - rate) / (1 - base)) if n else 0)) if rate > base else 0
        if rate >= 0.9 and gain >= 20:
            found.append((-gain, p))
    return [p for _, p in sorted(found)[:MAX_PATTERNS]]


def contradicted(texts: list[str], labels: np.ndarray) -> set[str]:
    """Lexicon words that stand in five training rows or more, mostly of label 0: other words of some language."""
    words = {w for v in LEXICONS.values() for w in v.split()}
    rows, toxic = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        found = words & units(text)[1]
        rows.update(found)
        if y == 1:
            toxic.update(found)
    return {w for w, n in rows.items() if n >= 5 and toxic[w] < 0.5 * n}


@dataclass
class Patterns:
    """What is looked for in a text."""

    induced: list[str]
    dropped: set[str]

    def __post_init__(self):
        self.lexicons = {k: frozenset(v.split()) - self.dropped for k, v in LEXICONS.items()}
        known = [w for k in sorted(self.lexicons) for w in sorted(self.lexicons[k])]
        self.features = list(dict.fromkeys(known + self.induced))
        self.at = {p: i for i, p in enumerate(self.features)}
        self.words = frozenset(p for p in self.features if not p.endswith("*"))
        self.stems = {n: frozenset(p[:-1] for p in self.features if p.endswith("*") and len(p) == n + 1) for n in STEMS}
        self.stems = {n: s for n, s in self.stems.items() if s}

    def hits(self, words: list[str], distinct: set[str]) -> tuple[set[int], set[str]]:
        """Features that occur, and the words in which they do."""
        found = distinct & self.words
        features = {self.at[w] for w in found}
        for n, stems in self.stems.items():
            for w in distinct:
                if w[:n] in stems and len(w) > n:
                    features.add(self.at[w[:n] + "*"])
                    found.add(w)
        return features, found

    def describe(self, text: str) -> tuple[set[int], np.ndarray, np.ndarray]:
        """Features, summary numbers and votes (1 toxic, 0 clean, -1 none) of a text."""
        words, distinct = units(text)
        features, found = self.hits(words, distinct)
        count = sum(1 for w in words if w in found) if found else 0
        share = count / max(1, len(words))
        kinds = [bool(distinct & lex) for _, lex in sorted(self.lexicons.items())]
        induced_words = any(not self.features[i].endswith("*") for i in features)
        induced_stems = any(self.features[i].endswith("*") for i in features)
        threat = bool(THREAT_WORDS & distinct) and bool(THREAT.search(text.lower()))
        masked = any(c in text for c in MASKS) and bool(MASKED.search(text))
        votes = np.array([
            *[1 if k else -1 for k in kinds],
            1 if induced_words else -1,
            1 if induced_stems else -1,
            1 if len(found) >= 2 else -1,
            1 if len(found) >= 4 else -1,
            1 if share >= 0.005 else (0 if not found else -1),
            0 if not found else -1,
            0 if not found and len(words) >= 50 else -1,
            1 if threat else -1,
            1 if masked and found else -1,
            1 if found and text.count("!") >= 3 else -1,
        ], dtype=np.int64)
        summary = np.array([1.0, bool(found), math.log1p(len(found)), math.log1p(1000 * share), *kinds, threat])
        return features, summary, votes


class LabelModel:
    """P(class), the given label's accuracies, and for each voter P(vote | vote of its parent, class).

    Parents form trees found from the votes: two voters are linked if, within the classes, one tells more than
    LINK nats about the other.
    """

    LINK, ROUNDS = 0.01, 30
    #: The given label is taken to be right so often for either class: often enough to tell the classes apart,
    #: not so often that it outweighs all voters.
    LEAST_RIGHT, MOST_RIGHT = 0.9, 0.99

    def fit(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row, from votes (1, 0, -1 for none) and given labels."""
        yes, no = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
        p = 0.5 * np.where(given == 1, 0.9, 0.1) + 0.5 * (yes + 0.2) / (yes + no + 0.4)
        for _ in range(self.ROUNDS):
            self._estimate(votes, given, p)
            p = self.posterior(votes, given)
        return p

    def _estimate(self, votes: np.ndarray, given: np.ndarray, p: np.ndarray) -> None:
        weights = np.stack([1 - p, p])
        self.prior = np.clip(weights.sum(1) / weights.sum(), 1e-3, 1 - 1e-3)
        right = [((weights[c] * (given == c)).sum() + 1) / (weights[c].sum() + 2) for c in (0, 1)]
        self.right = np.clip(right, self.LEAST_RIGHT, self.MOST_RIGHT)
        hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        # [voter i, voter j, class, vote of i, vote of j], smoothed
        joint = np.stack([np.einsum("nia,njb->ijab", hot * w[:, None, None], hot) for w in weights], axis=2) + 0.1
        joint /= joint.sum(axis=(3, 4), keepdims=True)
        apart = joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True)
        linked = np.einsum("c,ijc->ij", self.prior, (joint * np.log(joint / apart)).sum(axis=(3, 4)))
        self.parent = self._trees(linked)
        self.table = [
            joint[i, j] / joint[i, j].sum(axis=2, keepdims=True) if i >= 0 else joint[j, j].sum(axis=1)
            for j, i in enumerate(self.parent)
        ]

    def _trees(self, linked: np.ndarray) -> list[int]:
        """Largest spanning forest: the strongest links first, as long as they close no circle."""
        m = len(linked)
        tree = list(range(m))
        near: list[list[int]] = [[] for _ in range(m)]
        for strength, i, j in sorted(((linked[i, j], i, j) for i in range(m) for j in range(i)), reverse=True):
            if strength < self.LINK:
                break
            if tree[i] != tree[j]:
                tree = [tree[j] if t == tree[i] else t for t in tree]
                near[i].append(j)
                near[j].append(i)
        parent, seen = [-1] * m, set()
        for root in range(m):
            todo = [root] if root not in seen else []
            while todo:
                i = todo.pop()
                seen.add(i)
                for j in near[i]:
                    if j not in seen:
                        parent[j] = i
                        todo.append(j)
        return parent

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        log = np.log(self.prior) + np.log(np.where(given[:, None] == np.arange(2), self.right, 1 - self.right))
        for j, i in enumerate(self.parent):
            for c in (0, 1):
                t = self.table[j][c]
                log[:, c] += np.log(t[votes[:, j] + 1] if i < 0 else t[votes[:, i] + 1, votes[:, j] + 1])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w = np.zeros(x.shape[1])
    v = w.copy()
    step = 4.0 / ((x**2).sum(1).max() + 4 * penalty.max())
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * (x.T @ (p - target) / len(x) + penalty * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    patterns: Patterns
    weights: np.ndarray  # of summary numbers, then of features

    def score(self, text: str) -> float:
        features, summary, _ = self.patterns.describe(text)
        n = len(summary)
        z = float(summary @ self.weights[:n]) + sum(float(self.weights[n + i]) for i in features)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """From training rows; without any, from the fixed lexicons alone."""
    patterns = Patterns(induce(texts, labels), contradicted(texts, labels))
    if not len(texts):  # the lexicons themselves, as if they had been seen
        texts = ["", *sorted(w for lex in patterns.lexicons.values() for w in lex)]
        labels = np.array([0] + [1] * (len(texts) - 1))
    described = [patterns.describe(t) for t in texts]
    posterior = LabelModel().fit(np.array([d[2] for d in described]), np.asarray(labels))
    n = len(described[0][1])
    x = np.zeros((len(described), n + len(patterns.features)))
    for row, (features, summary, _) in zip(x, described, strict=True):
        row[:n] = summary
        row[[n + i for i in features]] = 1
    penalty = np.r_[np.full(n, 1e-5), np.full(len(patterns.features), 2e-4)]
    return Model(patterns, fit_linear(x, posterior, penalty))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score. Whole texts; null and empty texts get the score of a text without any sign."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": [model.score(t or "") for t in pdf["text"]]})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", key)


def held_out(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels, "toxic", ~held_out("doc_id"), SAMPLE_ROWS, SAMPLE_CHARS)
    return train(rows["text"].tolist(), rows["label"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= THRESHOLD).

    Learned from labelled rows that are not held out; labels, language, source and id are no input of a score.
    Null texts are empty. Null ids are not held out and are scored. Repeated rows stay. Without labels all
    texts are judged by the fixed lexicons' votes alone. An empty table gives no rows.
    """
    return score_documents(docs, learn(docs, labels)).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores below THRESHOLD, with all their columns."""
    model = learn(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype=float)

    return docs.where(score("text") < THRESHOLD)


def op7_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
