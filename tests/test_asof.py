"""The as-of join against a plain search."""

import random

from quietlake.operators import events as E


def test_against_plain_search(spark):
    rng = random.Random(1)
    port = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    time = lambda: rng.choice([None, *range(40)]) if rng.random() < 0.1 else rng.randint(0, 400)
    rows = [(i, port(), time(), "k") for i in range(800)]
    changes = [(port(), time(), rng.randint(1, 9), rng.choice("xyz")) for _ in range(120)] + [(9, 1, 1, "z"), (1, 5, None, None)]
    df = spark.createDataFrame(rows, "id long, p int, t int, _s string")
    ch = spark.createDataFrame(changes, "p int, t int, pid int, app string")
    got = {r.id: (r.pid, r.app) for r in E.as_of(df, ch, "p", "t", ["pid", "app"]).collect()}
    key = lambda c: (c[1], c[2] is not None, c[2] or 0, c[3] is not None, c[3] or "")
    for i, p, t, _ in rows:
        owners = [c for c in changes if p is not None and t is not None and c[0] == p and c[1] is not None and c[1] <= t]
        assert got[i] == (max(owners, key=key)[2:] if owners else (None, None))
    assert len(got) == len(rows)
    out = E.as_of(df, ch, "p", "t", ["pid", "app"])
    assert out.columns == ["id", "p", "t", "_s", "pid", "app"]
    assert E.as_of(df.limit(0), ch, "p", "t", ["pid"]).count() == 0
    assert all(r.pid is None for r in E.as_of(df, ch.limit(0), "p", "t", ["pid"]).collect())


def test_one_key_is_spread(spark):
    """All rows have one key: they lie in several slices, and what a slice begins with is right."""
    rows = spark.range(20_000).selectExpr("id", "7 AS p", "id AS t")
    ch = spark.createDataFrame([(7, 0, "a"), (7, 9_000, "b")], "p int, t long, app string")
    out = E.as_of(rows, ch, "p", "t", ["app"])
    assert {r.app: r["count"] for r in out.groupBy("app").count().collect()} == {"a": 9_000, "b": 11_000}
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
