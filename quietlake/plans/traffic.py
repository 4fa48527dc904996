"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import stats as A
from .tables import load


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adapted(load(spark, sf_dir, "events"))


def _now(log: DataFrame):
    """The newest event's time as a literal: one small aggregate, so that the filters on it reach the scan."""
    return F.lit(log.agg(F.max("ts")).first()[0]).cast("timestamp")


def stats_daily(spark, sf_dir):
    return A.daily(_log(spark, sf_dir))


def stats_daily_status(spark, sf_dir):
    return A.daily_status(_log(spark, sf_dir))


def stats_daily_words(spark, sf_dir):
    return A.daily_words(_log(spark, sf_dir))


def stats_daily_tokens(spark, sf_dir):
    return A.daily_tokens(_log(spark, sf_dir))


def stats_daily_models(spark, sf_dir):
    return A.daily_models(_log(spark, sf_dir))


def prefix_fidelity(spark, sf_dir):
    return A.prefix_ratios(_log(spark, sf_dir))


def stats_today(spark, sf_dir):
    log = _log(spark, sf_dir)
    return A.day_stats(log, F.to_date(_now(log)))


def stats_range_7(spark, sf_dir):
    log = _log(spark, sf_dir)
    return A.range_stats(log, _now(log), 7)


def stats_history_day(spark, sf_dir):
    """40 days up to five days after the newest event, so that empty days occur at both ends."""
    log = _log(spark, sf_dir)
    return A.history_days(log, F.date_add(F.to_date(_now(log)), 5), 40)


def stats_history_hour(spark, sf_dir):
    return A.history_hours(_log(spark, sf_dir))


def label_summary(spark, sf_dir):
    words = A.daily_words(_log(spark, sf_dir)).where("ingress = 'proxy'")
    return words.groupBy("label").agg(F.sum("n").alias("n"))


def stats_models(spark, sf_dir):
    return A.models(_log(spark, sf_dir))


def stats_models_cost(spark, sf_dir):
    log = _log(spark, sf_dir).where("model IS NOT NULL").select("id", "model", F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"))
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("vendor"), (k % 3).cast("string"), F.lit("/Model."), (k % 6).cast("string"))).when(k % 7 == 1, F.concat(F.lit("other/model-"), (k % 4).cast("string")))
    name = name.when(k % 7 == 2, "model").otherwise(F.concat(F.lit("never-"), k.cast("string")))
    catalogue = load(spark, sf_dir, "part").groupBy(name.alias("name")).agg((F.min("p_size") * 0.1).alias("input"), (F.max("p_size") * 0.4).alias("output"))
    out = A.priced(log, catalogue)
    money = (F.col("prompt_tokens") * F.col("input_price") + F.col("completion_tokens") * F.col("output_price")) / 1e6
    return out.groupBy("model", "matched").agg(F.count("*").alias("n"), F.round(F.sum(money), 6).alias("cost"))


#: Models of the parts' names, and prices for some of them: SQL of both engines.
_MODEL = "lower(p_type) || '/' || replace(p_name, ' ', '.') || '-' || substr(p_brand, 7)"
_USAGE = f"SELECT {_MODEL} AS model, p_size * 1000 AS prompt, p_size * 10 AS completion, p_size * CASE WHEN p_size > 40 THEN 1500 ELSE 300 END AS read, p_size AS write FROM part"
_PRICE = "max(p_size) * 0.5e0 AS input, max(p_size) * 2e0 AS output, max(CASE WHEN p_size < 45 THEN p_size END) * 0.25e0 AS cache_read, min(p_size) * 1e0 AS cache_write"
_OVERRIDES = f"SELECT {_MODEL} AS name, {_PRICE} FROM part WHERE p_size = 20 GROUP BY {_MODEL}"
_NAMES = (
    f"CASE WHEN p_size < 4 THEN {_MODEL} WHEN p_size < 7 THEN 'Other/' || upper({_MODEL.split(' || ', 2)[2]}) WHEN p_size < 9 THEN 'x/' || replace(p_name, ' ', '-') "
    "WHEN p_size = 9 THEN 'claude/' || substr(p_name, 1, 4) ELSE 'none/-' || p_brand END"
)
_CATALOGUE = f"SELECT {_NAMES} AS name, {_PRICE} FROM part GROUP BY {_NAMES}"
_BUILT_IN = f"SELECT substr(p_name, 1, 2) AS name, {_PRICE} FROM part GROUP BY substr(p_name, 1, 2)"


def model_prices(spark, sf_dir):
    """Cost of every model by override, catalogue and built-in prices, with tokens read from and written to a cache."""
    part = load(spark, sf_dir, "part")
    sql = lambda text: spark.sql(text.replace("FROM part", "FROM {part}"), part=part)
    out = A.priced(sql(_USAGE), sql(_CATALOGUE), overrides=sql(_OVERRIDES), built_in=sql(_BUILT_IN))
    counts = {k: F.col(k) for k in ("prompt", "completion", "read", "write")}
    prices = {k: F.col(f"{k}_price") for k in ("input", "output", "cache_read", "cache_write")}
    money = A.cached_cost(counts, prices, A.cached_apart(F.col("model")) | F.startswith("model", F.lit("small")))
    return out.groupBy("model", "matched").agg(F.count("*").alias("n"), F.round(F.sum(money), 6).alias("cost"))


def recent_percentiles(spark, sf_dir):
    log = _log(spark, sf_dir)
    newest = log.where("type = 'RESTORE'").orderBy(F.desc("id")).limit(2000)
    return A.nearest_rank(newest.select("status", "ms"), "ms", {"p50": 0.5, "p95": 0.95}, ["status"])


def percentiles_by_type(spark, sf_dir):
    return A.nearest_rank(_log(spark, sf_dir), "ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["type"])


def recent_minutes(spark, sf_dir):
    """The last two days by minute."""
    log = _log(spark, sf_dir)
    recent = log.where(F.col("ts") >= _now(log) - F.expr("INTERVAL 2 DAYS"))
    return recent.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("n"), F.count_if(F.col("http_status") >= 500).alias("server_errors"), F.sum("unresolved").alias("unresolved")
    )


def retry_storms(spark, sf_dir):
    return A.storms(_log(spark, sf_dir), least=2, seconds=600)


def words_top20(spark, sf_dir):
    return A.words_top(_log(spark, sf_dir), 20)


def status_counts(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("type", "http_status").agg(F.count("*").alias("n"))


def decision_split(spark, sf_dir):
    block = _log(spark, sf_dir).where("type = 'BLOCK'")
    return block.groupBy(F.coalesce("decision", F.lit("blocked")).alias("decision")).agg(F.count("*").alias("n"))


def fold_by_sid(spark, sf_dir):
    return E.folded(_log(spark, sf_dir))


def fold_union(spark, sf_dir):
    """Folded rows and independent events as one list."""
    log = _log(spark, sf_dir)
    a = E.folded(log).select("sid", F.coalesce("mask_id", "restore_id", "err_id").alias("id"), F.lit("folded").alias("kind"))
    b = E.independent(log).select("sid", "id", F.lit("single").alias("kind"))
    return a.unionByName(b)


def sibling_event(spark, sf_dir):
    return E.siblings(_log(spark, sf_dir))


def page_forward(spark, sf_dir):
    return E.page_after(_log(spark, sf_dir).select("id", "type", "sid"), 500, 200)


def page_backward(spark, sf_dir):
    return E.page_before(_log(spark, sf_dir).select("id", "type", "sid"), 500, 50)


def page_latest(spark, sf_dir):
    return E.latest(_log(spark, sf_dir).select("id", "type", "sid"), 100)


def filter_search(spark, sf_dir):
    log = _log(spark, sf_dir)
    return E.filtered(log, since=10, sensitive_only=True, via="proxy", search="API1").select("id", "type", "host", "path")


def filter_type_overrides(spark, sf_dir):
    return E.filtered(_log(spark, sf_dir), kind="pass", sensitive_only=True, search="%k_: 7%", fulltext=True).select("id", "host")


def count_max(spark, sf_dir):
    return _log(spark, sf_dir).agg(F.count("*").alias("n"), F.max("id").alias("max_id"))


def retention_prune(spark, sf_dir):
    log = _log(spark, sf_dir)
    return E.pruned(log, _now(log), 10).groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("oldest"))


def ingress_split(spark, sf_dir):
    return _log(spark, sf_dir).groupBy(E.ingress(F.col("ingress")).alias("via"), "type").agg(F.count("*").alias("n"))


def summary_projection(spark, sf_dir):
    out = E.summary(_log(spark, sf_dir), ["k", "missing"])
    return out.select("id", F.col("payload")["k"].alias("k"), F.size("payload").alias("kept"))


def outcome_classes(spark, sf_dir):
    log = _log(spark, sf_dir)
    age = F.unix_timestamp(_now(log)) - F.unix_timestamp("ts")
    return log.groupBy(E.outcome(F.col("type"), F.col("status"), F.col("http_status"), age).alias("outcome")).agg(F.count("*").alias("n"))


def usage_last_value(spark, sf_dir):
    log = _log(spark, sf_dir)
    frames = log.select("sid", "id", "prompt_tokens", "completion_tokens")
    return A.last_known(frames, "sid", "id", ["prompt_tokens", "completion_tokens"])


def usage_regress(spark, sf_dir):
    """Frames of a session whose completion count falls below that of the frame before."""
    log = _log(spark, sf_dir).where("completion_tokens IS NOT NULL")
    prev = F.lag("completion_tokens").over(Window.partitionBy("sid").orderBy("id"))
    return log.select("sid", "id", "completion_tokens", prev.alias("previous")).where("completion_tokens < previous")


def silence_gaps(spark, sf_dir):
    return A.gaps(_log(spark, sf_dir), 3600.0).select("sid", "id", F.round("gap", 3).alias("gap"))


def session_windows(spark, sf_dir):
    log = _log(spark, sf_dir)
    w = F.session_window("ts", "6 hours")
    return log.groupBy("host", w).agg(F.count("*").alias("n")).select("host", F.col("session_window.start").alias("start"), "n")


def sliding_errors(spark, sf_dir):
    log = _log(spark, sf_dir).where("http_status >= 500")
    return log.groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def marker_verification(spark, sf_dir):
    """Each customer marks one host and ingress for a day; the first event that fits verifies it."""
    c = load(spark, sf_dir, "customer")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 10000)
    markers = c.select(
        F.col("c_custkey").alias("m_id"), F.concat(F.lit("api"), (F.col("c_custkey") % 5).cast("string"), F.lit(".example.com")).alias("m_host"),
        F.when(F.col("c_nationkey") % 2 == 0, "ext").otherwise("proxy").alias("m_ingress"), start.alias("m_start"),
        (start + F.expr("INTERVAL 1 DAY")).alias("m_stop"), (F.col("c_custkey") * 3).alias("m_cursor"),
    )
    return A.verified_markers(markers, _log(spark, sf_dir))


def restore_items(spark, sf_dir):
    """Restored (label, word) by the number of events that hold it, each event once; the top 500, ranked, with the number of all."""
    log = _log(spark, sf_dir).where("type = 'RESTORE'").select("id", "label", "word").distinct()
    n = log.groupBy("label", "word").agg(F.count("*").alias("events"))
    top = n.orderBy(F.desc("events"), "label", "word").limit(500)
    total = n.agg(F.count("*").alias("total")).first()[0]
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("events"), "label", "word"))).withColumn("total", F.lit(total).cast("long"))


def clear_cutoff(spark, sf_dir):
    """After a clear at day 15 only later rows count, whenever they arrive."""
    log = _log(spark, sf_dir)
    return log.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).groupBy("day").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        stats_daily, stats_daily_status, stats_daily_words, stats_daily_tokens, stats_daily_models, prefix_fidelity, stats_today, stats_range_7,
        stats_history_day, stats_history_hour, label_summary, stats_models, stats_models_cost, model_prices, recent_percentiles, percentiles_by_type, recent_minutes,
        retry_storms, words_top20, status_counts, decision_split, fold_by_sid, fold_union, sibling_event, page_forward, page_backward, page_latest,
        filter_search, filter_type_overrides, count_max, retention_prune, ingress_split, summary_projection, outcome_classes, usage_last_value,
        usage_regress, silence_gaps, session_windows, sliding_errors, marker_verification, restore_items, clear_cutoff,
    )
}

LOG = """
WITH e AS (SELECT *, coalesce((props::JSON->>'k')::INTEGER, 0) AS k,
    CASE event_type WHEN 'view' THEN 'PASS' WHEN 'click' THEN 'MASK' WHEN 'purchase' THEN 'RESTORE' WHEN 'signup' THEN 'BLOCK' WHEN 'error' THEN 'ERR' END AS type
  FROM events),
log AS (SELECT event_id AS id, ts, ts::DATE AS day, type, user_id || '-' || strftime(ts, '%Y%m%d') AS sid,
  'api' || (user_id % 5) || '.example.com' AS host, CASE WHEN k % 7 = 0 THEN 'GET' ELSE 'POST' END AS method, '/v1/p' || (k % 4) AS path,
  CASE WHEN user_id % 4 = 0 THEN 'ext' WHEN user_id % 4 = 1 THEN NULL ELSE 'proxy' END AS ingress,
  CASE WHEN type = 'RESTORE' THEN CASE k % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'rewritten' ELSE 'ok' END END AS status,
  (CASE WHEN type = 'ERR' THEN 500 + k % 4 ELSE 200 END)::INTEGER AS http_status, value AS ms, k AS n,
  CASE WHEN type IN ('MASK', 'RESTORE') THEN (['EMAIL', 'PHONE', 'CARD', 'SECRET', 'IP_PRIVATE'])[k % 5 + 1] END AS label,
  CASE WHEN type IN ('MASK', 'RESTORE') THEN 'w' || (k % 37) END AS word,
  CASE WHEN type IN ('RESTORE', 'ERR') OR (type = 'PASS' AND k % 3 = 0) THEN 'vendor' || (user_id % 3) || '/Model.' || (k % 6) END AS model,
  CASE WHEN type = 'RESTORE' OR (type = 'PASS' AND k % 3 = 0) THEN (k * 10)::BIGINT END AS prompt_tokens,
  CASE WHEN type = 'RESTORE' OR (type = 'PASS' AND k % 3 = 0) THEN (k * 3 + 1)::BIGINT END AS completion_tokens,
  CASE WHEN type = 'BLOCK' AND k % 3 = 0 THEN 'flagged' WHEN type = 'BLOCK' AND k % 3 = 1 THEN 'blocked' END AS decision,
  CASE WHEN type = 'MASK' THEN k % 2 = 0 END AS rewritten, CASE WHEN type = 'MASK' AND k % 2 = 0 THEN k % 3 = 0 END AS reused,
  (CASE WHEN type = 'RESTORE' AND k % 4 = 0 THEN k % 3 ELSE 0 END)::INTEGER AS unresolved, props AS payload
  FROM e),
words AS (SELECT day, label, word, CASE WHEN ingress = 'ext' THEN 'ext' ELSE 'proxy' END AS ingress, count(*) AS n FROM log WHERE type = 'MASK' GROUP BY ALL),
mx AS (SELECT max(ts) AS now FROM log)
"""
_REQ = "count_if(type IN ('MASK', 'PASS', 'BYPASS', 'BLOCK'))"
_ALERT = "count_if(type IN ('BLOCK', 'ERR', 'SCAN_WARN'))"
_PICK = lambda name, p: f"max(CASE WHEN i = round_even({p} * (c - 1), 0) THEN ms END) AS {name}"
_FIRST = "f AS (SELECT sid, type, id, status, host, model, ms, row_number() OVER (PARTITION BY sid, type ORDER BY id) AS nth FROM log)"
_BOTH = ", ".join("coalesce(" + ", ".join(f"max(CASE WHEN type = '{t}' THEN {c} END)" for t in ("RESTORE", "ERR", "MASK")) + f") AS {c}" for c in ("host", "model", "ms"))
_FOLD = f"""fold AS (SELECT sid, {_BOTH}, NULL::BIGINT AS cancel_id, max(CASE WHEN type = 'MASK' THEN id END) AS mask_id, max(CASE WHEN type = 'RESTORE' THEN id END) AS restore_id,
    max(CASE WHEN type = 'ERR' THEN id END) AS err_id, max(CASE WHEN type = 'RESTORE' THEN status END) AS restore_status
    FROM f WHERE nth = 1 AND type IN ('MASK', 'RESTORE', 'ERR') GROUP BY sid)"""

ORACLE_SQL = {
    k: LOG + v
    for k, v in {
        "stats_daily": "SELECT day, type, count(*) AS n FROM log GROUP BY day, type",
        "stats_daily_status": "SELECT day, status, count(*) AS n FROM log WHERE type = 'RESTORE' GROUP BY day, status",
        "stats_daily_words": "SELECT * FROM words",
        "stats_daily_tokens": "SELECT day, sum(prompt_tokens)::BIGINT AS prompt, sum(completion_tokens)::BIGINT AS completion, count(*) AS requests FROM log WHERE prompt_tokens IS NOT NULL GROUP BY day",
        "stats_daily_models": """SELECT day, model, count(prompt_tokens) AS requests, count_if(type = 'ERR') AS errors,
            coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt, coalesce(sum(completion_tokens), 0)::BIGINT AS completion FROM log WHERE model IS NOT NULL GROUP BY day, model""",
        "prefix_fidelity": """SELECT count(*) AS total, count_if(rewritten) AS rewritten, count_if(reused) AS reused,
            round(count_if(rewritten) / count(*), 4) AS rewritten_ratio, round(count_if(reused) / count_if(rewritten), 4) AS reuse_ratio FROM log WHERE rewritten IS NOT NULL""",
        "stats_today": f"""SELECT {_REQ} AS requests, ({_ALERT} + sum(unresolved))::BIGINT AS alerts, count_if(type = 'MASK') AS masked,
            coalesce(sum(CASE WHEN type = 'MASK' THEN n END), 0)::BIGINT AS "values", 0::BIGINT AS audit_high,
            count_if(type = 'BLOCK' AND coalesce(decision, 'blocked') = 'blocked') AS blocked, count_if(type = 'BLOCK' AND decision = 'flagged') AS flagged
            FROM log, mx WHERE day = now::DATE""",
        "stats_range_7": """SELECT count_if(day > now::DATE - 7 AND type IN ('MASK', 'PASS', 'BYPASS', 'BLOCK')) AS requests, count_if(day > now::DATE - 7 AND type = 'ERR') AS errors,
            count_if(ts >= now - INTERVAL 7 DAY AND type = 'BLOCK' AND coalesce(decision, 'blocked') = 'blocked') AS blocked,
            count_if(ts >= now - INTERVAL 7 DAY AND type = 'BLOCK' AND decision = 'flagged') AS flagged, 0::BIGINT AS audit_high FROM log, mx""",
        "stats_history_day": f""", cal AS (SELECT unnest(generate_series(now::DATE + 5 - 39, now::DATE + 5, INTERVAL 1 DAY))::DATE AS day FROM mx),
            p AS (SELECT day, {_REQ} AS requests, {_ALERT} AS alerts, sum(prompt_tokens + completion_tokens) AS tokens FROM log GROUP BY day)
            SELECT day, coalesce(requests, 0)::BIGINT AS requests, coalesce(alerts, 0)::BIGINT AS alerts, coalesce(tokens, 0)::BIGINT AS tokens FROM cal LEFT JOIN p USING (day)""",
        "stats_history_hour": f"SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS hour, {_REQ} AS requests, {_ALERT} AS alerts FROM log GROUP BY 1",
        "label_summary": "SELECT label, sum(n)::BIGINT AS n FROM words WHERE ingress = 'proxy' GROUP BY label",
        "stats_models": """, m AS (SELECT model, count(prompt_tokens) AS requests, count_if(type = 'ERR') AS errors, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt,
            coalesce(sum(completion_tokens), 0)::BIGINT AS completion FROM log WHERE model IS NOT NULL GROUP BY model)
            SELECT *, row_number() OVER (ORDER BY requests DESC, errors DESC, model)::INTEGER AS rank FROM m""",
        "stats_models_cost": """, c AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'vendor' || (p_partkey % 3) || '/Model.' || (p_partkey % 6) WHEN p_partkey % 7 = 1 THEN 'other/model-' || (p_partkey % 4)
              WHEN p_partkey % 7 = 2 THEN 'model' ELSE 'never-' || p_partkey END AS name, min(p_size) * 0.1::DOUBLE AS i, max(p_size) * 0.4::DOUBLE AS o FROM part GROUP BY 1),
            b AS (SELECT replace(lower(split_part(name, '/', -1)), '.', '-') AS b, arg_min(i, name) AS i, arg_min(o, name) AS o FROM c GROUP BY 1),
            u AS (SELECT model, replace(lower(split_part(model, '/', 2)), '.', '-') AS b, coalesce(prompt_tokens, 0) AS pt, coalesce(completion_tokens, 0) AS ct FROM log WHERE model IS NOT NULL),
            r AS (SELECT u.*, e.i AS i1, e.o AS o1, x.i AS i2, x.o AS o2, z.i AS i3, z.o AS o3 FROM u LEFT JOIN c e ON e.name = u.model LEFT JOIN b x ON x.b = u.b LEFT JOIN c z ON z.name = 'model')
            SELECT model, CASE WHEN i1 IS NOT NULL THEN 'exact' WHEN i2 IS NOT NULL THEN 'bare' ELSE 'prefix' END AS matched, count(*) AS n,
              round(sum((pt * coalesce(i1, i2, i3) + ct * coalesce(o1, o2, o3)) / 1e6), 6) AS cost FROM r GROUP BY 1, 2""",
        "recent_percentiles": f""", w AS (SELECT status, ms FROM log WHERE type = 'RESTORE' ORDER BY id DESC LIMIT 2000),
            r AS (SELECT status, ms, row_number() OVER (PARTITION BY status ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY status) AS c FROM w)
            SELECT status, count(*) AS n, {_PICK('p50', 0.5)}, {_PICK('p95', 0.95)} FROM r GROUP BY status""",
        "percentiles_by_type": f""", r AS (SELECT type, ms, row_number() OVER (PARTITION BY type ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY type) AS c FROM log WHERE ms IS NOT NULL)
            SELECT type, count(*) AS n, {_PICK('p50', 0.5)}, {_PICK('p90', 0.9)}, {_PICK('p99', 0.99)} FROM r GROUP BY type""",
        "recent_minutes": "SELECT date_trunc('minute', ts) AS minute, count(*) AS n, count_if(http_status >= 500) AS server_errors, sum(unresolved)::BIGINT AS unresolved FROM log, mx WHERE ts >= now - INTERVAL 2 DAY GROUP BY 1",
        "retry_storms": """, b AS (SELECT path, count(*) OVER (PARTITION BY path ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS k FROM log WHERE http_status >= 500),
            p AS (SELECT path, max(k) AS peak, count(*) AS errors FROM b GROUP BY path) SELECT * FROM p WHERE peak >= 2 ORDER BY peak DESC, path LIMIT 5""",
        "words_top20": """, b AS (SELECT ingress, label, word, sum(n)::BIGINT AS n FROM words GROUP BY ALL UNION ALL SELECT 'all', label, word, sum(n)::BIGINT FROM words GROUP BY label, word),
            r AS (SELECT *, row_number() OVER (PARTITION BY ingress ORDER BY n DESC, label, word)::INTEGER AS rank FROM b) SELECT * FROM r WHERE rank <= 20""",
        "status_counts": "SELECT type, http_status, count(*) AS n FROM log GROUP BY ALL",
        "decision_split": "SELECT coalesce(decision, 'blocked') AS decision, count(*) AS n FROM log WHERE type = 'BLOCK' GROUP BY 1",
        "fold_by_sid": f", {_FIRST}, {_FOLD} SELECT *, CASE WHEN restore_id IS NOT NULL THEN 'RESTORE' WHEN err_id IS NOT NULL THEN 'ERR' ELSE 'MASK' END AS terminal FROM fold",
        "fold_union": f""", {_FIRST}, {_FOLD} SELECT sid, coalesce(mask_id, restore_id, err_id) AS id, 'folded' AS kind FROM fold
            UNION ALL SELECT sid, id, 'single' FROM f WHERE nth > 1 OR type NOT IN ('MASK', 'RESTORE', 'ERR')""",
        "sibling_event": "SELECT id, sid, (SELECT max(o.id) FROM log o WHERE o.sid = a.sid AND o.id <> a.id) AS sibling FROM log a",
        "page_forward": "SELECT id, type, sid FROM log WHERE id > 500 ORDER BY id LIMIT 200",
        "page_backward": "SELECT id, type, sid, (SELECT count(*) FROM log WHERE id < 500) > 50 AS has_more FROM log WHERE id < 500 ORDER BY id DESC LIMIT 50",
        "page_latest": "SELECT id, type, sid FROM log ORDER BY id DESC LIMIT 100",
        "filter_search": """SELECT id, type, host, path FROM log WHERE id > 10 AND type NOT IN ('SKIP', 'PASS') AND coalesce(ingress, 'proxy') = 'proxy'
            AND (host ILIKE '%API1%' OR path ILIKE '%API1%' OR method ILIKE '%API1%' OR coalesce(status ILIKE '%API1%', false) OR type ILIKE '%API1%')""",
        "filter_type_overrides": "SELECT id, host FROM log WHERE type = 'PASS' AND payload ILIKE '%k_: 7%'",
        "count_max": "SELECT count(*) AS n, max(id) AS max_id FROM log",
        "retention_prune": "SELECT type, count(*) AS n, min(id) AS oldest FROM log, mx WHERE ts >= now - INTERVAL 10 DAY GROUP BY type",
        "ingress_split": "SELECT coalesce(ingress, 'proxy') AS via, type, count(*) AS n FROM log GROUP BY 1, 2",
        "summary_projection": "SELECT id, n::VARCHAR AS k, 1::INTEGER AS kept FROM log",
        "outcome_classes": """SELECT CASE WHEN type = 'BLOCK' THEN 'blocked' WHEN type = 'ERR' OR http_status >= 500 THEN 'failed' WHEN type = 'RESTORE' AND status IN ('unresolved', 'incomplete') THEN 'partial'
            WHEN type = 'RESTORE' THEN 'restored' WHEN type = 'MASK' AND floor(epoch(now)) - floor(epoch(ts)) <= 180 THEN 'in_flight' WHEN type = 'MASK' THEN 'no_answer' ELSE 'passed' END AS outcome,
            count(*) AS n FROM log, mx GROUP BY 1""",
        "usage_last_value": """SELECT sid, id, last_value(prompt_tokens IGNORE NULLS) OVER w AS prompt_tokens, last_value(completion_tokens IGNORE NULLS) OVER w AS completion_tokens
            FROM log WINDOW w AS (PARTITION BY sid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "usage_regress": """, l AS (SELECT sid, id, completion_tokens, lag(completion_tokens) OVER (PARTITION BY sid ORDER BY id) AS previous FROM log WHERE completion_tokens IS NOT NULL)
            SELECT * FROM l WHERE completion_tokens < previous""",
        "silence_gaps": """, g AS (SELECT sid, id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sid ORDER BY ts, id)) / 1e6 AS gap FROM log) SELECT sid, id, round(gap, 3) AS gap FROM g WHERE gap > 3600""",
        "session_windows": """, s AS (SELECT host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM log),
            g AS (SELECT host, ts, sum(new) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
            SELECT host, min(ts) AS start, count(*) AS n FROM g GROUP BY host, g""",
        "sliding_errors": """, h AS (SELECT date_trunc('hour', ts) AS hour FROM log WHERE http_status >= 500), w AS (SELECT hour AS start FROM h UNION ALL SELECT hour - INTERVAL 1 HOUR FROM h)
            SELECT start, count(*) AS n FROM w GROUP BY start""",
        "marker_verification": """, m AS (SELECT c_custkey AS m_id, 'api' || (c_custkey % 5) || '.example.com' AS h, CASE WHEN c_nationkey % 2 = 0 THEN 'ext' ELSE 'proxy' END AS i,
              TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 10000) AS s, c_custkey * 3 AS cur FROM customer)
            SELECT m_id, min(id) AS first_id, count(*) AS hits FROM m JOIN log ON host = h AND coalesce(ingress, 'proxy') = i AND ts BETWEEN s AND s + INTERVAL 1 DAY AND id > cur GROUP BY m_id""",
        "restore_items": """, d AS (SELECT DISTINCT id, label, word FROM log WHERE type = 'RESTORE'), n AS (SELECT label, word, count(*) AS events FROM d GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (ORDER BY events DESC, label, word)::INTEGER AS rank, count(*) OVER () AS total FROM n) SELECT * FROM r WHERE rank <= 500""",
        "clear_cutoff": "SELECT day, count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY day",
    }.items()
}
_BARE = "replace(lower(split_part({0}, '/', -1)), '.', '-')"
_COLUMNS = "struct_pack(i := input, o := output, r := cache_read, w := cache_write)"
ORACLE_SQL["model_prices"] = f"""WITH u AS ({_USAGE}), o AS ({_OVERRIDES}), c AS ({_CATALOGUE}), t AS ({_BUILT_IN}),
    cb AS (SELECT {_BARE.format('name')} AS nb, arg_min({_COLUMNS}, name) AS p FROM c GROUP BY 1),
    tb AS (SELECT {_BARE.format('name')} AS nb, arg_min({_COLUMNS}, name) AS p FROM t GROUP BY 1),
    m AS (SELECT model, {_BARE.format('model')} AS b FROM u GROUP BY model),
    ways AS (
      SELECT model, 1 AS way, 'override' AS matched, 0 AS size, {_COLUMNS} AS p FROM m JOIN o ON name = model
      UNION ALL SELECT model, 2, 'exact', 0, {_COLUMNS} FROM m JOIN c ON name = model
      UNION ALL SELECT model, 3, 'bare', 0, p FROM m JOIN cb ON nb = b
      UNION ALL SELECT model, 4, 'prefix', length(nb), p FROM m JOIN cb ON starts_with(b, nb)
      UNION ALL SELECT model, 5, 'built_in', length(nb), p FROM m JOIN tb ON starts_with(b, nb)),
    best AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY model ORDER BY way, size DESC) = 1),
    e AS (SELECT u.*, matched, p, contains(model, 'claude') OR contains(model, 'anthropic') OR starts_with(model, 'small') AS apart FROM u LEFT JOIN best USING (model))
    SELECT model, matched, count(*) AS n, round(sum(round((CASE WHEN p IS NULL THEN 0 ELSE completion * p.o + write * p.w
        + CASE WHEN p.r IS NULL THEN prompt * p.i WHEN apart THEN prompt * p.i + read * p.r ELSE greatest(prompt - read, 0) * p.i + read * p.r END END) / 1e6, 6)), 6) AS cost
    FROM e GROUP BY model, matched"""
