"""The stateful restoration stream, in several micro-batches."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quietlake.streaming import restoration as R
from quietlake.streaming.channels import Waiting

TOKEN, VALUE = "{{EMAIL_bcdfgh}}", "v@w.org"
TEXT = f"a {TOKEN} b {{x}} {{{{no {TOKEN}{{{{EMAIL_"
WHOLE = TEXT.replace(TOKEN, VALUE)


@pytest.fixture
def stream(spark, tmp_path):
    """A function from lists of rows, one for each micro-batch, to the output rows and the last progress."""

    def run(batches, **how):
        folder = tmp_path / str(random.random())
        for i, rows in enumerate(batches):
            full = [(*r, *[None] * (7 - len(r)), t) for r, t in rows]
            spark.createDataFrame(full, R.INPUT).coalesce(1).write.mode("append").json(f"{folder}/in/{i:03}")
        files = spark.readStream.schema(R.INPUT).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        q = R.restored(files, **how).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.read.schema(R.OUTPUT).parquet(f"{folder}/out").orderBy("sid", "channel", "seq", "final").collect()
        return out, q.recentProgress

    return run


def at(seconds=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def texts(out):
    per = {}
    for r in out:
        per[r.sid, r.channel] = per.get((r.sid, r.channel), "") + r.text
    return per


def rows_left(progress):
    """Rows in the session's states after the last micro-batch, by the store's own count."""
    return progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else None


def test_every_split_out_of_order_equals_whole(stream):
    """One session for each place to cut; pieces, mapping and end come in any order over three micro-batches."""
    rng = random.Random(1)
    rows = []
    for i in range(len(TEXT) + 1):
        s = f"s{i:03}"
        rows += [(s, 0, "issue", None, None, TOKEN, VALUE), (s, 1, "delta", "c", TEXT[:i]), (s, 2, "delta", "d", "x"), (s, 3, "delta", "c", TEXT[i:]), (s, 4, "end")]
    rows = [(r, at()) for r in rows]
    rng.shuffle(rows)
    n = len(rows) // 3
    out, progress = stream([rows[:n], rows[n : 2 * n], [*rows[2 * n :], *rows[:5]]])
    assert texts(out) == {(f"s{i:03}", c): t for i in range(len(TEXT) + 1) for c, t in (("c", WHOLE), ("d", "x"))}
    assert not any("{{EMAIL_bcdfgh" in r.text for r in out)
    assert len(progress) == 3


def test_single_characters_and_channels(stream):
    rows = [("s", 0, "issue", None, None, TOKEN, VALUE)]
    for i, c in enumerate(TEXT):
        rows += [("s", 3 * i + 1 + k, "delta", channel, c) for k, channel in enumerate(("0:text", "0:tool0", "1:text"))]
    rows += [("s", 3 * len(TEXT) + 1, "end")]
    half = len(rows) // 2
    out, progress = stream([[(r, at()) for r in rows[:half]], [(r, at()) for r in rows[half:]]])
    assert texts(out) == {("s", c): WHOLE for c in ("0:text", "0:tool0", "1:text")}
    assert rows_left(progress) == 0  # the session's state is gone with its end


def test_final_ends_one_channel_and_snapshot_clears_its_own(stream):
    rows = [
        ("s", 0, "issue", None, None, TOKEN, VALUE), ("s", 1, "delta", "a", "x {{EMA"), ("s", 2, "delta", "b", "y {{EMA"), ("s", 3, "final", "a", "IL"),
        ("s", 4, "snapshot", "b", f"y {TOKEN}"), ("s", 5, "delta", "b", "IL_bcdfgh}}"), ("s", 6, "delta", "c", None), ("s", 7, "end"), ("s", 8, "delta", "c", "late"),
    ]
    out, _ = stream([[(r, at()) for r in rows]])
    assert texts(out) == {("s", "a"): "x {{EMAIL", ("s", "b"): f"y y {VALUE}IL_bcdfgh}}}}"}


def test_cap_and_unknown_placeholders(stream):
    text = "{{" + "A" * 80 + " {{CARD_zzzzzz}} {{EMAIL_bcdfgh}}"
    out, _ = stream([[(("s", i, "delta", "c", ch), at()) for i, ch in enumerate(text)]], cap=8)
    assert texts(out) == {("s", "c"): text}  # nothing is lost, nothing is restored without a mapping


def test_silent_session_ends_by_event_time(stream):
    """Row 1 never comes: when time has passed, what waits goes on, and nothing of the session stays."""
    lost = [(("s", 0, "issue", None, None, TOKEN, VALUE), at(0)), (("s", 2, "delta", "c", f"x {TOKEN} {{{{EM"), at(1))]
    other = [(("t", 0, "delta", "c", "hello"), at(1000)), (("t", 1, "end"), at(1000))]
    more = [(("u", 0, "delta", "c", "bye"), at(2000)), (("u", 1, "end"), at(2000))]
    out, progress = stream([lost, other, more], idle_seconds=60, late="1 second")
    assert texts(out) == {("s", "c"): f"x {VALUE} {{{{EM", ("t", "c"): "hello", ("u", "c"): "bye"}
    assert rows_left(progress) == 0
    kept, progress = stream([lost], idle_seconds=60, late="1 second")
    assert kept == [] and rows_left(progress) > 0


def test_settings_that_exclude_each_other(spark):
    rows = spark.createDataFrame([], R.INPUT)
    with pytest.raises(ValueError):
        R.restored(rows, ttl_seconds=5, late="1 second")


def test_time_to_live_and_clock(spark, tmp_path):
    """With the clock a query runs on; it is stopped here once all input is through."""
    rows = [("s", 0, "issue", None, None, TOKEN, VALUE, at()), ("s", 1, "delta", "c", TEXT, None, None, at()), ("s", 2, "end", None, None, None, None, at())]
    spark.createDataFrame(rows, R.INPUT).coalesce(1).write.json(str(tmp_path / "in"))
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    files = spark.readStream.schema(R.INPUT).json(str(tmp_path / "in"))
    q = R.restored(files, ttl_seconds=600, idle_seconds=600).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(300):
            time.sleep(0.2)
            if any(p["numInputRows"] for p in q.recentProgress):
                break
    finally:
        q.stop()
    assert texts(spark.read.schema(R.OUTPUT).parquet(f"{tmp_path}/out").orderBy("seq").collect()) == {("s", "c"): WHOLE}


def test_session_rows(spark):
    df = spark.createDataFrame([("s", at(), [("a", "xyz"), ("b", "")], [(TOKEN, VALUE)])], "sid string, ts timestamp, channels array<struct<channel:string,text:string>>, issued array<struct<token:string,value:string>>")
    got = [(r.seq, r.kind, r.channel, r.delta) for r in R.session_rows(df, F.lit(2)).orderBy("seq").collect()]
    assert got == [(0, "issue", "", None), (1, "delta", "a", "xy"), (2, "delta", "a", "z"), (3, "end", "", None)]


def test_rows_that_wait_share_entries(stream):
    """A thousand pieces that come before the first one are a few entries of the state, and nothing is lost or left."""
    rows = [(("s", i, "delta", "c", str(i % 10)), at()) for i in range(1000)] + [(("s", 1000, "end"), at())]
    early, first = rows[:0:-1], rows[:1]
    out, progress = stream([early[1:]])
    assert out == [] and 1 < rows_left(progress) < 20
    out, progress = stream([early[:400], early[300:700], early[700:], first])
    assert texts(out) == {("s", "c"): "0123456789" * 100} and rows_left(progress) == 0


def test_waiting_in_any_order():
    class Kept(dict):
        getValue, updateValue = dict.get, dict.__setitem__
        removeKey = dict.pop

    for seed, n in ((1, 50), (2, 100), (3, 1000)):
        rng, state, blocks, near, following, got = random.Random(seed), Kept(), [], "", 0, []
        order = rng.sample(range(n), n)
        for k in range(0, n, 7):
            waiting = Waiting(state, blocks, near)
            arrived = {i: [f"row {i}\n", None] for i in [*order[k : k + 7], *order[:2]] if i >= following}  # some come again
            while (row := arrived.pop(following, None) or waiting.get(following)) is not None:
                got.append(row)
                following += 1
            blocks, near = waiting.store(arrived, following)
            assert len(state) == len(blocks) <= n // 128 + 1 and {(b,) for b in blocks} == set(state)
        assert got == [[f"row {i}\n", None] for i in range(n)] and not near
        assert {b for (b,) in state} <= {n // 128}  # what came again in the last block


@pytest.mark.parametrize("size", [1, 3, 997])
def test_chunked(spark, size):
    values = ["", None, "a", "ab\r\n c" * 300, "😀x日" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", R.chunked(F.col("t"), F.lit(size)).alias("c")).collect()}
    assert got == {i: [(t or "")[k : k + size] for k in range(0, len(t or ""), size)] for i, t in enumerate(values)}
