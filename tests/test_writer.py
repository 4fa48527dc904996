"""The writer's three outcomes add up, whatever is in the rows."""

import pytest
from pyspark.sql import functions as F

from quietlake.streaming import writer as W

SCHEMA = "id long, ts timestamp, type string, evidence string"
GOOD = ['{"id": 1, "ts": "2024-01-05 00:00:00", "type": "PASS", "evidence": "abcdef"}', '{"id": 2, "ts": "2024-01-05 00:00:00", "type": "odd"}']
BAD = ["", "{", "[1]", "7", '{"id": "x", "ts": "2024-01-05", "type": "PASS"}', '{"id": 3, "ts": "when", "type": "ERR"}', '{"id": 4, "type": "ERR"}', '{"ts": "2024-01-05", "id": 5}', "null"]
OLD = ['{"id": 6, "ts": "2023-12-31", "type": "MASK"}']


@pytest.fixture
def write(spark, tmp_path):
    path = str(tmp_path / "log")

    def run(texts, n, **how):
        df = spark.createDataFrame([(t,) for t in texts], "value string").repartition(2)
        return W.written_batch(df, path, ("s", n), SCHEMA, ("id", "ts", "type"), cutoff=F.lit("2024-01-01").cast("timestamp"), cuts={"evidence": 3}, **how)

    return run, path


def totals(spark, path):
    return tuple(W.counters(spark, path).agg(*[F.sum(o) for o in W.OUTCOMES]).first())


def test_outcomes_add_up_and_replays_replace(spark, write):
    run, path = write
    texts = GOOD + BAD + OLD * 3 + GOOD[:1] * 4
    for _ in range(2):
        found = run(texts, 0)
        assert sum(found.values()) == len(texts)
        assert totals(spark, path) == (2, 3 + 4, len(BAD))
    assert found["PASS", "kept"] == 1 and found["other", "kept"] == 1 and found["PASS", "dropped"] == 4 and found["MASK", "dropped"] == 3
    run(GOOD, 1)
    assert totals(spark, path) == (4, 7, len(BAD))
    assert sorted((r.id, r.evidence) for r in W.log(spark, path, SCHEMA).collect()) == [(1, "abc"), (1, "abc"), (2, None), (2, None)]
    reasons = {r.text: r.reason for r in W.dead_letters(spark, path, SCHEMA).collect()}
    assert set(reasons) == set(BAD)
    assert reasons[BAD[4]] == "id: value" and reasons[BAD[5]] == "ts: value" and reasons[BAD[6]] == "ts: missing" and reasons[BAD[7]] == "type: missing" and reasons["{"] == "no object"


def test_same_id_with_other_texts(spark, write):
    run, path = write
    other = GOOD[0].replace("abcdef", "zzz")
    run([other, GOOD[0], other], 0)
    assert totals(spark, path) == (1, 2, 0)


def test_nothing(spark, write):
    run, path = write
    assert sum(run([], 0).values()) == 0
    run(BAD, 1)
    assert W.log(spark, path, SCHEMA).count() == 0 and totals(spark, path) == (0, 0, len(BAD))
