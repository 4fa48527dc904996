"""Roll-ups kept by batches against those of a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from quietlake.operators import events as E
from quietlake.operators import stats as A
from quietlake.streaming import rollups as R

SCANS = {"daily": A.daily, "words": A.daily_words, "tokens": A.daily_tokens, "models": A.daily_models, "prefix": A.daily_prefix}


@pytest.fixture(scope="module")
def log(spark, data):
    return E.adapted(spark.read.parquet(f"{data}/events.parquet")).withColumn("foreign", F.col("id") % 3).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def check(spark, path, log):
    for name, scan in SCANS.items():
        assert rows(R.current(spark, path, name)) == rows(scan(log).select(*R.current(spark, path, name).columns)), name
    assert rows(R.current(spark, path, "status")) == rows(A.daily_status(log, "foreign").select("day", "status", "n"))


def test_batches_replayed_split_and_compacted(spark, log, tmp_path):
    path = str(tmp_path / "r")
    parts = [log.where(F.pmod(F.hash("id"), F.lit(5)) == i) for i in range(5)]
    for i, part in enumerate(parts):
        assert R.added(part, path, f"s-{i}", "foreign")
        assert not R.added(part, path, f"s-{i}", "foreign")  # a replay
        if i in (1, 3):
            assert R.compacted(spark, path)
            assert not R.added(part, path, f"s-{i}", "foreign")  # also when its part has been summed
    check(spark, path, log)
    for _ in range(3):
        R.compacted(spark, path)
    assert R.compacted(spark, path) is None and not R.added(parts[4], path, "s-4", "foreign")
    check(spark, path, log)


def test_part_without_ledger_entry_does_not_count(spark, log, tmp_path):
    """As after a failure between the two writes: the part is written again."""
    path = str(tmp_path / "r")
    half = log.where("id % 2 = 0")
    R.summed(R.contributions(log)).write.parquet(f"{path}/parts/s-0")
    assert rows(R.current(spark, path)) == []
    assert R.added(half, path, "s-0", "foreign") and R.added(log.where("id % 2 = 1"), path, "s-1", "foreign")
    check(spark, path, log)


def test_history_once_then_stream(spark, log, tmp_path):
    path = str(tmp_path / "r")
    old = log.where("id < 400")
    mark = R.backfilled(old, path, "foreign")
    assert mark == old.agg(F.max("id")).first()[0] == R.backfilled(log, path, "foreign")
    ids = [r.id for r in log.select("id").collect()]
    random.Random(1).shuffle(ids)
    for i in range(4):
        log.where(F.col("id").isin(ids[i::4])).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").where(F.col("id") > mark)
    for _ in range(2):  # the second run finds nothing new
        R.kept_current(stream, path, "live", "foreign", compact_after=2).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    check(spark, path, log)


def test_stream_that_lost_its_last_commit(spark, log, tmp_path):
    """A restarted stream repeats its last batch; the ledger knows it."""
    path = str(tmp_path / "r")
    log.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in/*")
    run = lambda: R.kept_current(stream, path, "live", "foreign").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    run()
    for f in (tmp_path / "ck" / "commits").iterdir():
        f.unlink()
    run()
    check(spark, path, log)


def test_empty(spark, log, tmp_path):
    path = str(tmp_path / "r")
    assert R.current(spark, path).count() == 0 and R.backfilled(log.limit(0), path) == -1
    assert R.current(spark, path, "models").columns == ["day", "model", "requests", "errors", "prompt", "completion"]
    assert R.compacted(spark, path) is None
