"""Fill-in-middle transformation: a text is cut in three at unit boundaries, and the middle moved to its end.

The code points of a batch of texts become a sequence of character classes, held in one wavelet matrix. How many
units begin or end before a position is a sum of class ranks, so counting the units of a text takes two queries,
and the position of a cut is found by select, where one class bounds the unit, or by bisection on the ranks, where
several do. Nothing is split into a list of units, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import char_slices, table
from veritrail.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50

NEWLINE, SPACE, WORD_START, WORD, STOP, OTHER = range(6)
CLASS_BITS = 3
#: Texts that are looked at together have about so many characters, or are one long text.
BATCH_CHARS = 1 << 20


class Unit(NamedTuple):
    """A unit ends after each character of `classes`, or (opening) begins at each."""

    classes: tuple[int, ...]
    opening: bool = False


UNITS = {"line": Unit((NEWLINE,)), "sentence": Unit((NEWLINE, STOP)), "word": Unit((WORD_START,), opening=True)}


def _kinds() -> np.ndarray:
    """Class of each code point by itself. Beyond ASCII, all but spaces and sentence ends are word characters."""
    kinds = np.full(0x110000, WORD, np.uint8)
    kinds[:128] = [WORD if chr(c).isalnum() or chr(c) == "_" else OTHER for c in range(128)]
    for c in "\t\v\f\r \u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000":
        kinds[ord(c)] = SPACE
    kinds[0x2000:0x200B] = SPACE
    kinds[ord("\n")] = NEWLINE
    for c in ".!?…。！？":
        kinds[ord(c)] = STOP
    return kinds


_KINDS = _kinds()


class Texts:
    """Several texts in one wavelet matrix."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        classes = _KINDS[points]
        word = classes == WORD
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = self.starts[self.lengths > 0]
        first[inner] = word[inner]
        classes[first] = WORD_START
        self.matrix = WaveletMatrix(classes, CLASS_BITS)
        self.classes = classes

    def bounds(self, unit: Unit, at: np.ndarray) -> np.ndarray:
        """Boundary characters of the unit before positions of the batch: ranks of its classes added up."""
        return np.sum([self.matrix.rank(c, at) for c in unit.classes], axis=0)

    def count(self, unit: Unit) -> np.ndarray:
        """Units of each text."""
        marks = self.bounds(unit, self.ends) - self.bounds(unit, self.starts)
        return marks + self._loose(unit)

    def _loose(self, unit: Unit) -> np.ndarray:
        """1 where a text has a last unit without an end, or a first one without a beginning."""
        out = np.zeros(len(self.lengths), np.int64)
        full = np.flatnonzero(self.lengths)
        edge = self.starts[full] if unit.opening else self.ends[full] - 1
        out[full] = ~np.isin(self.classes[edge], unit.classes)
        return out

    def _nth(self, unit: Unit, nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Position of the nth boundary character of the batch, which stands in [low, high)."""
        if len(unit.classes) == 1:
            return self.matrix.select(unit.classes[0], nth)
        while (high - low > 1).any():
            half = (low + high) // 2
            past = self.bounds(unit, half) > nth
            low, high = np.where(past, low, half), np.where(past, half, high)
        return low

    def cut(self, unit: Unit, units: np.ndarray) -> np.ndarray:
        """Where, in characters of its own text, the first `units` units of each text end."""
        out = np.where(units > 0, self.lengths, 0)
        lead = self._loose(unit) if unit.opening else np.ones(len(out), np.int64)
        total = self.count(unit)
        # the boundary character that closes the last of the units, or opens the one after it
        todo = np.flatnonzero((units > 0) & (units < total))
        if len(todo):
            nth = self.bounds(unit, self.starts[todo]) + units[todo] - lead[todo]
            at = self._nth(unit, nth, self.starts[todo], self.ends[todo])
            out[todo] = at - self.starts[todo] + (0 if unit.opening else 1)
        return out


def draws(seed: int, key) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the SHA-256 of `seed:key`; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def transform(texts: list[str], keys: list, unit: Unit, seed: int, rate: int, spm_rate: int) -> list[tuple]:
    """(units, form, prefix characters, middle characters, output) of each text."""
    all_texts = Texts(texts)
    n = all_texts.count(unit)
    drawn = np.array([draws(seed, k) for k in keys], np.int64).reshape(-1, 4)
    a, b = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    first, second = all_texts.cut(unit, np.minimum(a, b)), all_texts.cut(unit, np.maximum(a, b))
    plain, spm = drawn[:, 2] % 100 >= rate, drawn[:, 3] % 100 < spm_rate
    out = []
    for i, text in enumerate(texts):
        p, m = int(first[i]), int(second[i])
        if not text or plain[i] or PREFIX in text or SUFFIX in text or MIDDLE in text:
            out.append((int(n[i]), "plain", None, None, text))
        elif spm[i]:
            out.append((int(n[i]), "spm", p, m - p, "".join((SUFFIX, text[m:], PREFIX, text[:p], MIDDLE, text[p:m]))))
        else:
            out.append((int(n[i]), "psm", p, m - p, "".join((PREFIX, text[:p], SUFFIX, text[m:], MIDDLE, text[p:m]))))
    return out


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n (units), form (psm, spm or plain), prefix_chars, middle_chars, output.

    The cuts fall after two numbers of units drawn from the key, so the result of a document is always the same.
    A text stays plain if it is empty or null (which gives an empty output), holds one of the three marks, or is
    drawn so (`rate` in a hundred are not); prefix_chars and middle_chars are then null. Null keys are drawn as
    an empty key. Repeated rows stay rows of their own. Whole texts of any length are read. An empty table
    gives no rows. Other columns of `docs` are left out.
    """
    kind, bound = docs.schema[key].dataType.simpleString(), UNITS[unit]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in char_slices(batches, "text", BATCH_CHARS):
            keys = [None if pd.isna(k) else k for k in pdf["shown"]]
            made = transform(pdf["text"].tolist(), keys, bound, seed, rate, spm_rate)
            n, form, prefix, middle, output = zip(*made, strict=True)
            yield pd.DataFrame({
                "id": pdf["id"].to_numpy(), "n": n, "form": form, "prefix_chars": pd.array(prefix, "Int64"),
                "middle_chars": pd.array(middle, "Int64"), "output": output})

    rows = docs.select(F.col(key).alias("id"), F.col(key).cast("string").alias("shown"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", key)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone: of each mark, the first one is the one that was set."""
    at = lambda mark: F.instr(output, mark)
    piece = lambda start, end: F.substring(output, start, end - start)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    width, end = len(PREFIX), F.length(output) + 1
    return (
        F.when(form == "psm", F.concat(piece(p + width, s), piece(m + width, end), piece(s + width, m)))
        .when(form == "spm", F.concat(piece(p + width, m), piece(m + width, end), piece(s + width, p)))
        .otherwise(output)
    )


OP12_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
    FROM documents
), drawn AS (
    SELECT doc_id, body, lines, CAST(len(lines) AS BIGINT) AS n,
        CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || substr(hash, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
        CAST('0x' || substr(hash, 17, 8) AS BIGINT) % 100 AS odd, CAST('0x' || substr(hash, 25, 8) AS BIGINT) % 100 < 50 AS spm
    FROM cut
), parts AS (
    SELECT doc_id, body, n, spm,
        body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR odd >= 100 AS plain,
        coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS prefix,
        coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
        coalesce(array_to_string(lines[greatest(a, b) + 1:], ''), '') AS suffix
    FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE WHEN plain THEN body WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parts
"""


def op12_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
