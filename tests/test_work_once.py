"""What is dear is worked out once for each value, and not once for each use."""

from pyspark.sql import functions as F

from quietlake.functions import detect as D
from quietlake.operators import tokens as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_placeholder_takes_one_digest(spark):
    df = spark.createDataFrame([("EMAIL", "ab@c.example")], "label string, value string")
    once = df.select(T.token(F.col("label"), F.col("value"), "k").alias("t"))
    assert plan(once).count("sha2(") == 2  # inner and outer key
    assert once.first()[0] == df.select(T.written_token(F.col("label"), T.suffix(T.digest(F.col("label"), F.col("value"), "k")))).first()[0]


def test_a_masked_text_is_searched_once(spark):
    df = spark.createDataFrame([("to ab@c.example", ), (None, ), ("", ), ("none", )], "text string")
    out = df.select(D.replaced(F.col("text"), lambda c: F.lit("*"), ["EMAIL"]).alias("text"))
    assert plan(out).count("regexp_replace(text") == 1
    assert [r[0] for r in out.collect()] == ["to *", None, "", "none"]


def test_a_quoted_string_is_written_once(spark):
    df = spark.createDataFrame([('a"\n',)], "v string")
    out = df.select(T.json_escaped(F.col("v")).alias("v"))
    assert plan(out).count("StructsToJsonEvaluator(") == 1 and out.first()[0] == '\\"'.join(["a", "\\n"])
