from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that clash with those used inside.
    T.StructField("row", T.IntegerType()), T.StructField("node", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("word", T.StringType()), T.StructField("bucket", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("held_out", T.StringType()),
])

PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly mix "
         "blue potions under a pale moon and nobody asks them why they do it at night ")


def rows_of(pairs):
    """(doc_id, text) or (doc_id, text, lang, source) rows with all other columns filled."""
    out = []
    for p in pairs:
        doc_id, text, lang, source = (*p, "en", "s")[:4] if len(p) < 4 else p
        out.append((doc_id, text, lang, source, len(text or ""), 1, "n", "k", "sp", "w", "b", "i", "h"))
    return out


ODD = [
    (1, PROSE * 4, "en", "a"), (2, PROSE * 4, "en", "a"),      # copies
    (3, None, "en", None), (4, "", None, "a"), (5, "  \n\t ", "en", "a"),
    (6, "x", "en", "a"), (7, "été ñandú größe " * 40, "fr", "b"),
    (8, "ab " * 40_000, "en", "b"), (9, "1234 5678 !!", "en", "b"),
    (10, "y" * 70_000, "en", "c"), (10, "y" * 70_000, "en", "c"),  # a repeated row
    (None, "no key here", "en", "c"), (12, "日本語 🎉\r\nline\x0b two ▁ x", None, "c"),
    (13, PROSE + "and one more thing", "en", "a"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
