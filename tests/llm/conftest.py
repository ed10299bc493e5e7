"""Small tables with everything that goes wrong in real ones."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text, source)`` rows, in several partitions."""
    def make(rows, parts=3):
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture
def odd_rows():
    """Null, empty, repeated and very long texts, null ids and sources."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten"
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, same, "a"), (4, same, "a"), (5, same + " ", "b"),
            (6, long_text, "b"), (7, long_text + " tail", None), (None, same, "c"), (None, None, None), (8, "ünï cödé 中文 😀", "c"),
            (9, "x" * 5000, "c"), (-3, "a b", "a"), (10, "a b c d e", "a")]


@pytest.fixture
def clashing():
    """Further columns named like the operators' own."""
    def add(df):
        from pyspark.sql import functions as F
        names = ["class", "size", "order", "component", "hash", "start", "kind", "value", "host", "failed", "kept", "taken",
                 "part", "label", "score", "rank", "block", "spans", "stats", "__id", "target", "range"]
        return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})

    return add
