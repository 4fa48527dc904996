"""Small documents with the awkward cases."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("fp", T.StringType()), T.StructField("key", T.IntegerType()),  # columns whose names clash with the operators' own
])

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the river bank at dusk and sing"


def documents(spark, rows):
    """rows: (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(2)


def awkward(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(20000))
    return documents(spark, [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id"), (7, "ÄÖ ß 日本語 🙂 é")])


def empty(spark):
    return documents(spark, [])
