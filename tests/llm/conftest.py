import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def make(spark):
    """Rows as a documents table; each row is (doc_id, text, lang, source)."""
    def build(rows):
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)

    return build


@pytest.fixture
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows and columns with names that operators use themselves."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "one two three four five six", "en", "a"), (4, "one two three four five six", "en", "a"),
            (5, "one two three four five six", None, "b"), (6, "mot " * 30_000, "fr", "b"), (7, "x" * 50_000, "de", None), (None, "seven words that have no id here", "en", "c")]
    docs = make(rows)
    for name in ("size", "target", "taken", "key", "f", "simhash", "word", "lang_pred", "score", "kept", "quality", "host", "perplexity", "place", "candidate", "l"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs
