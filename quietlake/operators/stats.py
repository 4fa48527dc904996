"""Statistics over the event log: roll-ups, ranges, rankings, percentiles, storms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import ingress


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy("day", "type").agg(F.count("*").alias("n"))


def daily_status(log: DataFrame, foreign: str | None = None) -> DataFrame:
    """Statuses of RESTORE only; with the name of a column of counts, a row `foreign` for the events in which it is above zero."""
    restored = log.where("type = 'RESTORE'")
    out = restored.groupBy("day", "status").agg(F.count("*").alias("n"))
    if foreign:
        out = out.unionByName(restored.where(F.col(foreign) > 0).groupBy("day").agg(F.lit("foreign").alias("status"), F.count("*").alias("n")))
    return out


def daily_words(log: DataFrame) -> DataFrame:
    """Masked words, of MASK only."""
    return log.where("type = 'MASK'").groupBy("day", "label", "word", ingress(F.col("ingress")).alias("ingress")).agg(F.count("*").alias("n"))


def daily_tokens(log: DataFrame) -> DataFrame:
    used = log.where("type IN ('RESTORE', 'PASS') AND prompt_tokens IS NOT NULL")
    return used.groupBy("day").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.count("*").alias("requests"))


def daily_models(log: DataFrame) -> DataFrame:
    used = log.where("model IS NOT NULL")
    return used.groupBy("day", "model").agg(
        F.count_if(F.col("prompt_tokens").isNotNull()).alias("requests"), F.count_if(F.col("type") == "ERR").alias("errors"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion"),
    )


def daily_prefix(log: DataFrame) -> DataFrame:
    """Rewritten and reused prefixes where it is known whether the body was rewritten."""
    return log.where("rewritten IS NOT NULL").groupBy("day").agg(
        F.count("*").alias("total"), F.count_if("rewritten").alias("rewritten"), F.count_if("reused").alias("reused")
    )


def prefix_ratios(log: DataFrame) -> DataFrame:
    """Reuse among the rewritten; null without a sample."""
    sums = daily_prefix(log).agg(*[F.sum(c).alias(c) for c in ("total", "rewritten", "reused")])
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return sums.select("*", share("rewritten", "total").alias("rewritten_ratio"), share("reused", "rewritten").alias("reuse_ratio"))


def requests() -> Column:
    return F.count_if(F.col("type").isin("MASK", "PASS", "BYPASS", "BLOCK"))


def alerts() -> Column:
    """Blocks, errors and scan warnings, plus unresolved placeholders."""
    return F.count_if(F.col("type").isin("BLOCK", "ERR", "SCAN_WARN")) + F.coalesce(F.sum("unresolved"), F.lit(0))


def serious(audit: DataFrame) -> DataFrame:
    """Findings of the two upper severities."""
    return audit.where(F.col("severity").isin("HIGH", "CRITICAL"))


def with_findings(log: DataFrame, audit: DataFrame | None) -> DataFrame:
    """The log and serious findings (ts, severity) as rows of type AUDIT, to be counted in one pass."""
    if audit is None:
        return log
    return log.unionByName(serious(audit).select("ts", F.to_date("ts").alias("day"), F.lit("AUDIT").alias("type")), allowMissingColumns=True)


def day_stats(log: DataFrame, day: Column, audit: DataFrame | None = None) -> DataFrame:
    """Counters of a day; with findings (ts, severity) the serious ones count as alerts, and as audit_high."""
    one = with_findings(log, audit).where(F.col("day") == day)
    high = F.count_if(F.col("type") == "AUDIT")
    return one.agg(
        requests().alias("requests"), (alerts() + high).alias("alerts"), F.count_if(F.col("type") == "MASK").alias("masked"), high.alias("audit_high"),
        F.coalesce(F.sum(F.when(F.col("type") == "MASK", F.col("n"))), F.lit(0)).alias("values"),
        F.count_if((F.col("type") == "BLOCK") & (F.coalesce("decision", F.lit("blocked")) == "blocked")).alias("blocked"),
        F.count_if((F.col("type") == "BLOCK") & (F.col("decision") == "flagged")).alias("flagged"),
    )


def range_stats(log: DataFrame, now: Column, days: int, audit: DataFrame | None = None) -> DataFrame:
    """Calendar days for the counters, a rolling window of days * 86400 seconds for the decisions and the serious findings (ts, severity)."""
    days = max(1, min(days, 90))
    calendar = F.col("day") > F.date_sub(F.to_date(now), days)
    rolling = F.col("ts") >= now - F.make_dt_interval(F.lit(days))
    block = F.col("type") == "BLOCK"
    return with_findings(log, audit).where(calendar | rolling).agg(
        F.count_if(calendar & F.col("type").isin("MASK", "PASS", "BYPASS", "BLOCK")).alias("requests"),
        F.count_if(calendar & (F.col("type") == "ERR")).alias("errors"),
        F.count_if(rolling & block & (F.coalesce("decision", F.lit("blocked")) == "blocked")).alias("blocked"),
        F.count_if(rolling & block & (F.col("decision") == "flagged")).alias("flagged"),
        F.count_if(rolling & (F.col("type") == "AUDIT")).alias("audit_high"),
    )


def history_days(log: DataFrame, last: Column, days: int, audit: DataFrame | None = None) -> DataFrame:
    """The last `days` days, each with its counters, zero where nothing happened; serious findings (ts, severity) count as alerts."""
    spark = log.sparkSession
    ends = spark.range(1).select(last.alias("last")) if not isinstance(last, DataFrame) else last
    calendar = ends.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    per = log.groupBy("day").agg(requests().alias("requests"), F.count_if(F.col("type").isin("BLOCK", "ERR", "SCAN_WARN")).alias("alerts"))
    tokens = daily_tokens(log).select("day", (F.col("prompt") + F.col("completion")).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    if audit is not None:
        high = serious(audit).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("high"))
        both = calendar.join(per, "day", "left").join(tokens, "day", "left").join(high, "day", "left")
        return both.select("day", zero("requests"), (F.coalesce("alerts", F.lit(0)) + F.coalesce("high", F.lit(0))).cast("long").alias("alerts"), zero("tokens"))
    return calendar.join(per, "day", "left").join(tokens, "day", "left").select("day", zero("requests"), zero("alerts"), zero("tokens"))


def history_hours(log: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Hours with events; serious findings (ts, severity) count as alerts of these hours only."""
    hour = (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("hour")
    if audit is not None:
        high = serious(audit).groupBy(hour).agg(F.count("*").alias("high"))
        return history_hours(log).join(high, "hour", "left").select("hour", "requests", (F.col("alerts") + F.coalesce("high", F.lit(0))).alias("alerts"))
    return log.groupBy(hour).agg(requests().alias("requests"), F.count_if(F.col("type").isin("BLOCK", "ERR", "SCAN_WARN")).alias("alerts"))


def models(log: DataFrame) -> DataFrame:
    """By requests, then errors, then name."""
    out = daily_models(log).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("requests", "errors", "prompt", "completion")])
    nth = F.row_number().over(Window.orderBy(F.desc("requests"), F.desc("errors"), "model"))
    return out.withColumn("rank", nth)


def value_bucket(x: Column) -> Column:
    """A number that grows with x: 256 steps for each power of two, so that no bucket spans much of any spread of values."""
    steps = F.floor(F.log2(F.abs(x)) * 256) + 300_000
    return F.when(x > 0, steps).when(x < 0, -steps).otherwise(F.lit(0)).cast("long")


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Percentiles as the value at index round-half-even(p * (n - 1)) of the sorted values; exact for groups of any size.

    Equal values are counted first. Counts per bucket of values tell in which bucket each index
    lies, and only the values of these buckets are sorted, each bucket by itself.
    """
    known = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("x")).agg(F.count("*").alias("c"))
    known = known.withColumn("b", value_bucket(F.col("x")))
    w = Window.partitionBy(*by)
    per = known.groupBy(*by, "b").agg(F.sum("c").alias("c"))
    per = per.select(*by, "b", "c", (F.sum("c").over(w.orderBy("b")) - F.col("c")).alias("base"), F.sum("c").over(w).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.bround(F.lit(p) * (F.col("n") - 1)).cast("long").alias("at")) for name, p in shares.items()])
    picks = per.select(*by, "b", "base", "c", "n", F.explode(wanted).alias("w")).where((F.col("w.at") >= F.col("base")) & (F.col("w.at") < F.col("base") + F.col("c")))
    picks = picks.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("b").alias("_b"), "n", "w.name", (F.col("w.at") - F.col("base")).alias("at"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = known.join(picks, same & (F.col("b") == F.col("_b")))
    line = Window.partitionBy(*by, "b", "name").orderBy("x")
    inside = inside.withColumn("upto", F.sum("c").over(line)).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at")))
    return inside.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares])


def storms(log: DataFrame, least: int = 5, seconds: int = 60, top: int = 5) -> DataFrame:
    """Paths with at least `least` server errors within `seconds`: the most of any such window, top paths.

    Errors of one instant are counted first, and each stretch of ten windows' length is counted by
    itself, together with the window before it; a path may have any number of errors.
    """
    span, size = seconds * 1_000_000, seconds * 10_000_000
    bad = log.where("http_status >= 500").groupBy("path", F.unix_micros("ts").alias("t")).agg(F.count("*").alias("c"))
    own = F.floor(F.col("t") / size)
    both = bad.select("path", "t", "c", own.alias("own"), F.explode(F.array_distinct(F.array(own, F.floor((F.col("t") + span) / size)))).alias("part"))
    w = Window.partitionBy("path", "part").orderBy("t").rangeBetween(-span, 0)
    counted = both.withColumn("k", F.sum("c").over(w)).where("own = part")
    peak = counted.groupBy("path").agg(F.max("k").alias("peak"), F.sum("c").alias("errors"))
    return peak.where(F.col("peak") >= least).orderBy(F.desc("peak"), "path").limit(top)


def words_top(log: DataFrame, k: int = 20) -> DataFrame:
    """Top k (label, word) over all and for each ingress, ties by label and word."""
    words = daily_words(log)
    each = words.groupBy("ingress", "label", "word").agg(F.sum("n").alias("n"))
    whole = words.groupBy("label", "word").agg(F.sum("n").alias("n")).select(F.lit("all").alias("ingress"), "label", "word", "n")
    both = each.unionByName(whole)
    nth = F.row_number().over(Window.partitionBy("ingress").orderBy(F.desc("n"), "label", "word"))
    return both.withColumn("rank", nth).where(F.col("rank") <= k)


def bare_name(model: Column) -> Column:
    """A model's name without its vendor, in lower case, dots as dashes."""
    return F.replace(F.lower(F.element_at(F.split(model, "/"), -1)), F.lit("."), F.lit("-"))


_PRICES = ("input", "output", "cache_read", "cache_write")


def priced(usage: DataFrame, catalogue: DataFrame, model: str = "model", overrides: DataFrame | None = None, built_in: DataFrame | None = None) -> DataFrame:
    """usage with price columns and how they were found: the first that there is of

    override (exact name, the user's own prices), exact, bare (bare name), prefix (longest prefix of the
    bare name), built_in (longest prefix too, for names that the catalogue lacks); null for none.
    All tables: name, input, output (per million tokens); cache_read and cache_write as well if the
    catalogue has them. Distinct models are priced once and joined back; the prefix steps expand
    each model into its own prefixes for an equi-join.
    """
    kinds = [k for k in _PRICES if k in catalogue.columns]
    p = lambda df: F.struct(*[(F.col(k) if k in df.columns else F.lit(None)).cast("double").alias(k) for k in kinds])
    names = usage.select(F.col(model).alias("m")).where("m IS NOT NULL").distinct().withColumn("b", bare_name(F.col("m")))
    heads = names.select("m", F.explode(F.transform(F.sequence(F.lit(1), F.length("b")), lambda i: F.substr("b", F.lit(1), i))).alias("nb"))

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("name").alias("m"), p(df).alias("p")).groupBy("m").agg(F.min("p").alias("p"))

    def bare(df: DataFrame) -> DataFrame:
        return df.select(bare_name(F.col("name")).alias("nb"), "name", p(df).alias("p")).groupBy("nb").agg(F.min_by("p", F.struct("name", "p")).alias("p"))

    def longest(df: DataFrame) -> DataFrame:
        return heads.join(bare(df), "nb").groupBy("m").agg(F.max_by("p", F.length("nb")).alias("p"))

    steps = {"override": named(overrides) if overrides is not None else None, "exact": named(catalogue)}
    steps |= {"bare": names.join(bare(catalogue), F.col("b") == F.col("nb")).select("m", "p"), "prefix": longest(catalogue)}
    steps |= {"built_in": longest(built_in) if built_in is not None else None}
    steps = {k: df for k, df in steps.items() if df is not None}
    done = names.select("m")
    for k, df in steps.items():
        done = done.join(df.withColumnRenamed("p", k), "m", "left")
    how = F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in steps])
    table = done.select(F.col("m").alias(model), F.coalesce(*steps).alias("p"), how.alias("matched"))
    out = usage.join(table, model, "left")
    return out.select(*usage.columns, *[F.col(f"p.{k}").alias(f"{k}_price") for k in kinds], "matched")


def cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    return F.round((prompt * input_price + completion * output_price) / 1e6, 6)


def cached_apart(model: Column) -> Column:
    """Whether a model's vendor counts tokens read from its cache beside those of the prompt and not among them."""
    return F.contains(bare_name(model), F.lit("claude")) | F.contains(F.lower(model), F.lit("anthropic"))


def cached_cost(usage: dict[str, Column], prices: dict[str, Column], apart: Column) -> Column:
    """Cost with cached tokens (prompt, completion, read, write) at the prices (input, output, cache_read, cache_write).

    Tokens read from the cache have their own price if there is one, and are then no prompt tokens;
    null and negative counts are none; without a price of its own a write costs nothing. 0 without prices.
    """
    n = {k: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for k, c in usage.items()}
    at = {k: F.coalesce(c, F.lit(0.0)) for k, c in prices.items()}
    discounted = (n["read"] > 0) & prices["cache_read"].isNotNull()
    rest = F.when(~discounted | apart, n["prompt"]).otherwise(F.greatest(n["prompt"] - n["read"], F.lit(0)))
    total = rest * at["input"] + F.when(discounted, n["read"] * at["cache_read"]).otherwise(0.0) + n["completion"] * at["output"] + n["write"] * at["cache_write"]
    return F.round(total / 1e6, 6)


def last_known(frames: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Usage over the frames of a stream: for each column the last value that is present."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.select(key, order, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])


def gaps(log: DataFrame, budget_seconds: float) -> DataFrame:
    """Silences longer than the budget between consecutive events of a sid."""
    prev = F.lag(F.unix_micros("ts")).over(Window.partitionBy("sid").orderBy("ts", "id"))
    out = log.select("sid", "id", ((F.unix_micros("ts") - prev) / 1e6).alias("gap"))
    return out.where(F.col("gap") > budget_seconds)


def verified_markers(markers: DataFrame, log: DataFrame, hours: int = 6) -> DataFrame:
    """First event in [start, stop] with the marker's ingress and host and an id past its cursor.

    Stretches of time of `hours` hours are part of the key, so that a marker meets the events of its own time only.
    """
    size = hours * 3600
    part = lambda c: F.floor(F.unix_timestamp(c) / size)
    markers = markers.withColumn("m_part", F.explode(F.sequence(part("m_start"), part("m_stop"))))
    hit = markers.join(log, (part(log["ts"]) == markers["m_part"]) & (log["host"] == markers["m_host"]) & (ingress(log["ingress"]) == markers["m_ingress"]) & log["ts"].between(markers["m_start"], markers["m_stop"]) & (log["id"] > markers["m_cursor"]))
    return hit.groupBy("m_id").agg(F.min("id").alias("first_id"), F.count("*").alias("hits"))


def backfilled(parts: DataFrame, path: str, upto: str | None) -> str | None:
    """Roll-up rows (day, …) of days after the mark appended to the table at path, once: returns the new mark, to be kept by the caller.

    A second call with the mark that it returned writes nothing.
    """
    new = parts if upto is None else parts.where(F.col("day") > F.lit(upto).cast("date"))
    last = new.agg(F.max("day").cast("string")).first()[0]
    if last is None:
        return upto
    new.write.mode("append").partitionBy("day").parquet(path)
    return last


def without_rollups(log: DataFrame) -> DataFrame:
    """Today's counters by a scan of the events where no roll-up exists: every BLOCK counts as blocked, and words, tokens and prefixes are left out."""
    return log.groupBy("day").agg(requests().alias("requests"), alerts().alias("alerts"), F.count_if(F.col("type") == "BLOCK").alias("blocked"))


def connections(log: DataFrame, now: Column) -> DataFrame:
    """Per upstream: sends, failed ones, and the age in seconds of the oldest session of which no answer or failure is known."""
    closed = F.max(F.col("type").isin("RESTORE", "ERR", "BLOCK").cast("int"))
    per = log.groupBy("host", "sid").agg(F.count("*").alias("sends"), F.count_if(F.col("type") == "ERR").alias("failed"), closed.alias("closed"), F.min("ts").alias("first"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(F.col("closed") == 0, F.col("first"))))
    return per.groupBy("host").agg(F.sum("sends").alias("sends"), F.sum("failed").alias("failed"), F.count_if(F.col("closed") == 0).alias("open"), age.alias("oldest_seconds"))


def daily_actions(log: DataFrame) -> DataFrame:
    """What a user sees counted: masked, restored and skipped per day."""
    action = F.create_map(*[F.lit(x) for p in (("MASK", "mask"), ("RESTORE", "restore"), ("PASS", "skip")) for x in p])[F.col("type")]
    return log.select("day", action.alias("action")).where("action IS NOT NULL").groupBy("day", "action").agg(F.count("*").alias("n"))


#: Rules of the self check: name, severity, condition on the aggregates of selfcheck_context().
SELFCHECK = (
    ("no_traffic", "LOW", "events = 0"),
    ("nothing_masked", "MEDIUM", "events > 0 AND masked = 0"),
    ("error_rate", "HIGH", "errors > 0.2 * events"),
    ("some_errors", "LOW", "errors > 0 AND errors <= 0.2 * events"),
    ("server_errors", "MEDIUM", "server_errors > 10"),
    ("unresolved", "HIGH", "unresolved > 0.1 * restored"),
    ("some_unresolved", "LOW", "unresolved > 0 AND unresolved <= 0.1 * restored"),
    ("incomplete", "MEDIUM", "incomplete > 0.05 * restored"),
    ("rewritten", "LOW", "rewritten > 0"),
    ("no_restore", "MEDIUM", "masked > 0 AND restored = 0"),
    ("many_blocked", "MEDIUM", "blocked > 0.1 * events"),
    ("flagged", "LOW", "flagged > 0"),
    ("slow", "MEDIUM", "mean_ms > 1000"),
    ("very_slow", "HIGH", "most_ms > 60000"),
    ("no_usage", "LOW", "restored > 0 AND with_usage = 0"),
    ("empty_prompts", "LOW", "with_usage > 0 AND prompt = 0"),
    ("single_host", "LOW", "hosts = 1"),
    ("many_hosts", "LOW", "hosts > 100"),
    ("unknown_ingress", "LOW", "unknown_ingress > 0"),
    ("stale", "MEDIUM", "age_seconds > 86400"),
    ("future_events", "HIGH", "age_seconds < 0"),
)


def selfcheck_context(log: DataFrame, now: Column) -> DataFrame:
    """One row of aggregates for the rules of the self check."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    t = F.col("type")
    return log.agg(
        F.count("*").alias("events"), n(t == "MASK").alias("masked"), n(t == "RESTORE").alias("restored"), n(t == "ERR").alias("errors"), n(F.col("http_status") >= 500).alias("server_errors"),
        n(F.col("status") == "unresolved").alias("unresolved"), n(F.col("status") == "incomplete").alias("incomplete"), n(F.col("status") == "rewritten").alias("rewritten"),
        n((t == "BLOCK") & (F.coalesce("decision", F.lit("blocked")) == "blocked")).alias("blocked"), n((t == "BLOCK") & (F.col("decision") == "flagged")).alias("flagged"),
        F.avg("ms").alias("mean_ms"), F.max("ms").alias("most_ms"), n(F.col("prompt_tokens").isNotNull()).alias("with_usage"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"),
        F.count_distinct("host").alias("hosts"), n(F.col("ingress").isNull()).alias("unknown_ingress"), (F.unix_timestamp(now) - F.unix_timestamp(F.max("ts"))).alias("age_seconds"),
    )


def selfcheck(context: DataFrame) -> DataFrame:
    """(rule, severity) of the rules that hold for the aggregates."""
    each = [F.when(F.coalesce(F.expr(test), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"))) for name, level, test in SELFCHECK]
    return context.select(F.explode(F.array(*each)).alias("r")).where("r IS NOT NULL").select("r.*")


def evaluation(pairs: DataFrame, id_column: str) -> DataFrame:
    """Quality of recognised texts (id, truth, found): character error rate as edits a character of the truth, recall of the truth's words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    truth, found = words("truth"), words("found")
    cer = F.levenshtein("truth", "found") / F.greatest(F.length("truth"), F.lit(1))
    recall = F.when(F.size(truth) > 0, F.size(F.array_intersect(truth, found)) / F.size(truth))
    return pairs.select(id_column, F.round(cer, 6).alias("cer"), F.round(recall, 6).alias("recall"))


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    inter = side("x1", "x2") * side("y1", "y2")
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
