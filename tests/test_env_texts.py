"""Entries of .env texts: all of them, and without a shuffle of every line."""

import pytest

from quietlake.plans import masking
from quietlake.plans.tables import dealt
from quietlake.sources import files as S


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_not_shuffled_again(spark, tmp_path):
    spark.range(50).selectExpr("id AS c_custkey", "concat('n', id) AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    out = masking.env_entries(spark, str(tmp_path))
    assert exchanges(out) == 1
    assert out.count() == 300


def test_entries_of_env_texts(spark):
    text = "export A = 'x # y' # c\r\n B=\"p\\n\\\"q\\\\\" # c\nC=\"open\nD='open\nE = v # c\nE=w\n#no\n\n=1\nF=\nG=#all\nB=\"last\""
    rows = S.dot_env(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id").orderBy("line").collect()
    assert [(r.key, r.value, r.line, r.skip_reason) for r in rows] == [
        ("A", "x # y", 1, None), ("B", 'p\n"q\\', 2, "overridden"), ("C", None, 3, "open_quote"), ("D", None, 4, "open_quote"),
        ("E", "v", 5, "overridden"), ("E", "w", 6, None), (None, None, 9, "no_key"), ("F", None, 10, "empty"), ("G", None, 11, "empty"), ("B", "last", 12, None),
    ]


@pytest.mark.parametrize("rows, by", [(10, None), (10, "c_custkey")])
def test_dealt_keeps_every_row(spark, tmp_path, rows, by):
    spark.range(100).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    out = dealt(spark, str(tmp_path), "customer", rows, by)
    assert sorted(r[0] for r in out.collect()) == list(range(100)) and out.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 10)
