"""Streaming queries over the events file, run to its end."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import tokens as T
from ..session import shared_dir, written
from ..streaming import framing as G
from ..streaming import restoration as R
from ..streaming import rollups as U
from ..streaming import windows as S
from ..streaming import writer as V
from .detection import KEY
from .tables import load
from .traffic import LOG


#: Micro-batches of a stream over files, and files of one for small inputs. Each batch opens the state of all its sessions, so
#: batches must not become more as the input grows.
BATCHES, FILES = 8, 3
#: Characters of an unfinished line: as many as a text may have, of which a line is a part.
WHOLE = 2**31 - 1


def _arriving(spark, files):
    """The files of a written table as a stream of a bounded number of micro-batches."""
    some = max(FILES, math.ceil(len(files.inputFiles()) / BATCHES))
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", some).parquet(files._quietlake_path)


def _stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return E.adapted(raw)


def stream_hourly(spark, sf_dir):
    return S.drained(S.hourly(_stream(spark, sf_dir)), "hourly")


def stream_daily_status(spark, sf_dir):
    """The roll-up of statuses kept by a stream."""
    log = _stream(spark, sf_dir).where("type = 'RESTORE'")
    return S.drained(log.groupBy("day", "status").agg(F.count("*").alias("n")), "status")


def stream_restored(spark, sf_dir):
    """Conversations as sessions whose turns are channels: texts with placeholders, cut into pieces of one to nine characters that arrive out of order."""
    t = load(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    value = F.concat(F.lit("u"), "conv_id", F.lit("."), "turn", F.lit("@mail.example"))
    token = T.token(F.lit("EMAIL"), value, KEY)
    text = F.concat(F.lit("Reply to "), token, F.lit(" or {{EMAIL_zzzzzz}}{{"), F.coalesce("text", F.lit("")), F.lit(" "), token)
    one = t.select(F.col("conv_id").cast("string").alias("sid"), F.struct(F.col("turn").cast("string").alias("channel"), text.alias("text")).alias("c"), F.struct(token.alias("token"), value.alias("value")).alias("i"))
    answers = one.groupBy("sid").agg(F.collect_list("c").alias("channels"), F.collect_list("i").alias("issued")).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows = R.session_rows(answers, (1 + F.pmod(F.crc32("sid"), F.lit(9))).cast("int")).repartition("seq", "sid")
    files = written(rows, "chunks")
    stream = _arriving(spark, files)
    out = S.drained(R.restored(stream), "restored", "append")
    per = out.groupBy("sid", "channel").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return per.select(F.col("sid").cast("long").alias("conv_id"), F.col("channel").cast("long").alias("turn"), F.length(whole).cast("long").alias("chars"), F.sha2(whole, 256).alias("sha256"))


def rollups_incremental(spark, sf_dir):
    """All six roll-ups: the events up to the median id as history, the others as they come in micro-batches, with a compaction in between."""
    log = E.adapted(load(spark, sf_dir, "events"))
    half = F.lit(log.agg(F.percentile_approx("id", 0.5)).first()[0])
    path = f"{shared_dir(spark)}/quietlake-rollups-{uuid.uuid4().hex}"
    mark = U.backfilled(log.where(F.col("id") <= half), path, "unresolved")
    files = written(log.repartition("sid"), "log")
    stream = _arriving(spark, files).where(F.col("id") > mark)
    run = U.kept_current(stream, path, "events", "unresolved", compact_after=2).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return U.current(spark, path)


def stream_lines(spark, sf_dir):
    """Documents as channels of pieces of 997 characters, put together as lines: their number and characters by document."""
    d = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    pieces = R.chunked(F.coalesce("text", F.lit("")), F.lit(997))
    cut = d.dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("string").alias("sid"), pieces.alias("pieces"))
    cut = cut.select("sid", F.greatest(F.size("pieces"), F.lit(1)).alias("size"), "pieces")  # beside an explode it would be counted for each piece
    each = cut.select("sid", "size", F.posexplode(F.when(F.size("pieces") == 0, F.array(F.lit(""))).otherwise(F.col("pieces"))).alias("seq", "delta"))
    rows = each.select("sid", F.lit("").alias("channel"), F.col("seq").cast("long").alias("seq"), "delta", (F.col("seq") == F.col("size") - 1).alias("final"))
    files = written(rows.repartition("seq", "sid"), "pieces")
    stream = _arriving(spark, files)
    out = S.drained(G.assembled(stream, G.lines, cap=WHOLE), "lines", "append")
    return out.groupBy(F.col("sid").cast("long").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


_EVENT = "id long, ts timestamp, type string, ms double, evidence string"


def writer_outcomes(spark, sf_dir):
    """Events as JSON texts, some of them with a bad time, a bad number, without a type or broken; each fifth comes twice, and those of the first days are from before a clear."""
    e = load(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.upper(F.col("event_type"))
    ts = F.when(i % 50 == 7, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    ms = F.when(i % 70 == 3, "x").otherwise(F.lit("1.5"))
    whole = F.to_json(F.struct(i.alias("id"), ts.alias("ts"), F.when(i % 90 != 11, "PASS").alias("type"), ms.alias("ms"), F.repeat(kind, 100).alias("evidence")))
    text = F.when(i % 110 == 13, F.concat(F.lit("{"), F.lit("broken "), i.cast("string"))).otherwise(whole)
    rows = e.select(F.explode(F.array_repeat(text, F.when(i % 5 == 0, 2).otherwise(1))).alias("value"), i.alias("event_id"))
    files = written(rows.repartition("event_id").select("value"), "texts")
    path = f"{shared_dir(spark)}/quietlake-writer-{uuid.uuid4().hex}"
    stream = _arriving(spark, files)
    cutoff = e.agg(F.date_add(F.to_date(F.min("ts")), 3)).first()[0]
    how = {"cutoff": F.lit(cutoff).cast("timestamp"), "cuts": {"evidence": 300}}
    V.kept_log(stream, path, "events", _EVENT, ("id", "ts", "type"), **how).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    kept = V.log(spark, path, _EVENT).agg(F.count("*").alias("rows"), F.max(F.length("evidence")).alias("evidence"))
    dead = V.dead_letters(spark, path, _EVENT).groupBy("reason").agg(F.count("*").alias("n"))
    total = V.counters(spark, path).select("type", F.explode(F.create_map(*[x for o in V.OUTCOMES for x in (F.lit(o), F.col(o))])).alias("what", "n"))
    parts = total.groupBy("what").agg(F.sum("n").alias("n")).select(F.concat(F.lit("count "), "what").alias("what"), "n")
    parts = parts.unionByName(dead.select(F.concat(F.lit("dead "), "reason").alias("what"), "n"))
    return parts.unionByName(kept.select(F.explode(F.array(F.struct(F.lit("log rows").alias("what"), F.col("rows").alias("n")), F.struct(F.lit("log evidence").alias("what"), F.col("evidence").cast("long").alias("n")))).alias("s")).select("s.*"))


_ANSWER = "'Reply to u' || conv_id || '.' || turn || '@mail.example or {{EMAIL_zzzzzz}}{{' || coalesce(text, '') || ' u' || conv_id || '.' || turn || '@mail.example'"
QUERIES = {f.__name__: f for f in (stream_hourly, stream_daily_status, stream_restored, rollups_incremental, stream_lines, writer_outcomes)}
ORACLE_SQL = {
    "stream_hourly": LOG + "SELECT date_trunc('hour', ts) AS hour, type, count(*) AS n FROM log GROUP BY ALL",
    "stream_restored": f"SELECT conv_id, turn, length(a)::BIGINT AS chars, sha256(a) AS sha256 FROM (SELECT *, {_ANSWER} AS a FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)",
    "stream_lines": r"""SELECT doc_id, len(l)::BIGINT AS lines, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS chars
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN right(x, 1) = chr(13) THEN left(x, -1) ELSE x END), lambda x: x <> '') AS l
  FROM (SELECT DISTINCT ON (doc_id) doc_id, text FROM documents WHERE text IS NOT NULL)) WHERE len(l) > 0""",
    "writer_outcomes": """WITH c AS (SELECT min(ts)::DATE + 3 AS cutoff FROM events),
r AS (SELECT event_id AS i, ts, upper(event_type) AS k, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS copies,
  CASE WHEN event_id % 110 = 13 THEN 'no object' WHEN event_id % 50 = 7 THEN 'ts: value' WHEN event_id % 70 = 3 THEN 'ms: value' WHEN event_id % 90 = 11 THEN 'type: missing' END AS reason FROM events),
o AS (SELECT *, reason IS NULL AND date_trunc('second', ts) >= cutoff AS ok FROM r, c)
SELECT 'count kept' AS what, count(*) FILTER (ok) AS n FROM o
UNION ALL SELECT 'count dropped', (sum(copies) FILTER (reason IS NULL) - count(*) FILTER (ok))::BIGINT FROM o
UNION ALL SELECT 'count dead', (sum(copies) FILTER (reason IS NOT NULL))::BIGINT FROM o
UNION ALL SELECT 'dead ' || reason, sum(copies)::BIGINT FROM o WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'log rows', count(*) FILTER (ok) FROM o
UNION ALL SELECT 'log evidence', max(least(300, length(k) * 100)) FILTER (ok) FROM o""",
    "rollups_incremental": LOG + """, rows AS (
  SELECT 'daily' AS rollup, day, type AS k1, NULL::VARCHAR AS k2, NULL::VARCHAR AS k3, 1 AS m1, 0 AS m2, 0 AS m3, 0 AS m4 FROM log
  UNION ALL SELECT 'status', day, status, NULL, NULL, 1, 0, 0, 0 FROM log WHERE type = 'RESTORE'
  UNION ALL SELECT 'status', day, 'foreign', NULL, NULL, 1, 0, 0, 0 FROM log WHERE type = 'RESTORE' AND unresolved > 0
  UNION ALL SELECT 'words', day, label, word, CASE WHEN ingress = 'ext' THEN 'ext' ELSE 'proxy' END, 1, 0, 0, 0 FROM log WHERE type = 'MASK'
  UNION ALL SELECT 'tokens', day, NULL, NULL, NULL, prompt_tokens, completion_tokens, 1, 0 FROM log WHERE type IN ('RESTORE', 'PASS') AND prompt_tokens IS NOT NULL
  UNION ALL SELECT 'models', day, model, NULL, NULL, (prompt_tokens IS NOT NULL)::INT, (type = 'ERR')::INT, coalesce(prompt_tokens, 0), coalesce(completion_tokens, 0) FROM log WHERE model IS NOT NULL
  UNION ALL SELECT 'prefix', day, NULL, NULL, NULL, 1, rewritten::INT, coalesce(reused, false)::INT, 0 FROM log WHERE rewritten IS NOT NULL)
SELECT rollup, day, k1, k2, k3, sum(m1)::BIGINT AS m1, sum(m2)::BIGINT AS m2, sum(m3)::BIGINT AS m3, sum(m4)::BIGINT AS m4 FROM rows GROUP BY ALL""",
    "stream_daily_status": LOG + "SELECT day, status, count(*) AS n FROM log WHERE type = 'RESTORE' GROUP BY day, status",
}
