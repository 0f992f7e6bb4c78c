import pytest

ODD_TEXTS = [
    (1, "Plain words, in a short line."),
    (2, None),
    (3, ""),
    (4, " \n\t!!"),
    (5, "word " * 40_000),
    (6, "Plain words, in a short line."),
    (6, "Plain words, in a short line."),
    (None, "no id at all, but some words here"),
    (7, "é漢\U0001f600\x00 ﬁ"),
    (8, "x" * 50_000),
]
#: Names that the operators make themselves.
CLASHES = "n_words, label, score, hits, items, node, keys, kept, spans, doc, ids, decoded, class_id, shard, slot, size, bytes, gram"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_TEXTS, "doc_id bigint, text string").repartition(3)
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c.strip(): F.lit(None).cast("string") for c in CLASHES.split(",")})
