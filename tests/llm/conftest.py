import pytest
from pyspark.sql import functions as F

from veritrail.session import prepare

TEXTS = [
    "The first line of a plain text.\nAnd a second line that follows it.", "The first line of a plain text.\nAnd a second line that follows it.",
    "", None, "word", "   \n\t ", "x" * 30_000, "long words " * 9_000, "Ünïcödé text, 中文 and ▁ marks 🙂 <|endoftext|>", "You are a stupid, pathetic idiot and a worthless loser.",
    "Write to jane.roe@mail.com or +1 (212) 555-0199, card 4111111111111111, host 10.1.2.3.",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns with names that the operators use."""
    prepare(spark)
    rows = [(i if i != 5 else None, t, "en", "src0", len(t or ""), 7, "kept") for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, label string")
    clashing = ("id", "n", "part", "rank", "to", "row", "key", "fp", "u", "v", "block", "size", "shard", "at", "found", "guest", "ids", "held_out", "_part")
    return df.select("*", *[F.lit(name).alias(name) for name in clashing])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i == 9)) for i in range(11)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
