import pytest
from pyspark.sql import types as T

EXTRA = ["key", "cls", "sig", "sig8", "digest", "label", "score", "kept", "shard", "length", "tie", "canonical", "host",
         "verdict", "node", "component", "n", "doc", "h", "stratum", "rule", "cutoff", "features", "margin", "__order", "half"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])

PROSE = ("the quick brown fox jumps over the lazy dog and runs through the green field while birds sing in the old trees "
         "near the quiet river where children play until the evening comes and lamps are lit along the narrow street")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))


def frame(spark, rows):
    """Documents from ``(doc_id, text, lang)``, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(k, t, lang, None, None, *[c for c in EXTRA]) for k, t, lang in rows], SCHEMA)


NASTY = [(1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (3, None, "en"), (4, "", None), (5, " \t\n\u000b ", "de"),
         (6, LONG, "en"), (None, "a text without a key", "en"), (None, None, None), (7, "###", "fr"), (8, "one", "en"),
         (9, "你好 世界 é🙂 \x00 end", "zh"), (10, "one", "en"), (11, "x" * 100_000, "en"),
         (12, PROSE + " tonight", "en"), (13, "a a a a a a a a a a\na a a a a a a a a a\n\n", "en")]


@pytest.fixture(scope="session")
def nasty(spark):
    return frame(spark, NASTY)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
