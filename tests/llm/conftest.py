import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

#: Column names the operators use inside, to see that they don't clash.
CLASHING = ["t", "uid", "fp", "th", "row", "spans", "score", "p", "core", "block", "word", "rank", "tokens", "_key", "_hash", "_none", "_toxicity", "gone", "left"]


def crowd(df):
    """df with clashing extra columns."""
    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def crowded():
    return crowd


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(30_000))
    passage = "A passage that many documents share, word for word, again and again. " * 4
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "src1", 38),
        (2, None, "en", "src2", None),
        (3, "", None, "src1", 0),
        (4, long, "en", None, len(long)),
        (5, "the cat sat on the mat and the dog ran", "en", "src1", 38),
        (5, "the cat sat on the mat and the dog ran", "en", "src1", 38),
        (6, "first. " + passage + "left tail", "en", "src4", 1),
        (7, "second! " + passage + "right tail", "de", "src5", 1),
        (None, "no key at all, but " + passage, "fr", "src6", 1),
        (None, None, None, None, None),
        (8, "ÉÉ  ßß\n\n\t日本語 \U0001f600 é", "xx", "weird", 3),
        (9, "   ", "en", "src1", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
