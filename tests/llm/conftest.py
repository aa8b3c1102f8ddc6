import hashlib
import re

import pytest
from pyspark.sql import functions as F

WORDS = re.compile("[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def low(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text):
    return WORDS.findall(text or "")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(rows):
        frame = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint")
        for name in ("n", "key", "hash", "node", "label", "score", "digest", "kept", "failed", "n_words", "n_lines", "n_dropped", "_id", "row", "known", "keeper"):
            frame = frame.withColumn(name, F.lit(f"own {name}"))
        return frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, ties, repeated rows and null ids and sources."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    line = "This line of the licence is long enough to be found in many documents."
    base = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, long, "a"), (5, "one", "b"), (5, "one", "b"), (None, "text without an id " * 9, "b"), (None, None, None), (6, "one two", "b")]
    many = [(10 + i, f"{line}\nunique {i} alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau\n  {line.upper()} ", "c") for i in range(6)]
    return base + many
