import zlib

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    long_ = "word and other words of a very long text. " * 4000
    rows = [
        (1, "one two three four five six seven", "en", "a", 1), (2, "one two  three\tfour five six seven", None, "a", None), (3, None, "en", None, 3), (4, "", None, None, None), (5, long_, "en", "b", 5), (5, long_, "en", "b", 5),
        (None, "a text without a key, and rather short", None, None, None), (7, "one two three four five six seven", "en", "a", 7), (8, " \t\n", "en", "c", 8), (9, "naïve <|endoftext|> café 中文 ﬁ", "fr", "b", 9), (10, "two words", "en", "b", 1), (11, "two words", "en", "b", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("ids", "piece", "shard", "slot", "node", "h", "key", "kept", "quality", "line", "sequence_id", "n_tokens", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
