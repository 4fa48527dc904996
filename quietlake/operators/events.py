"""Event log: adapter over the events table, filters, projections, pages, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

TYPES = {"view": "PASS", "click": "MASK", "purchase": "RESTORE", "signup": "BLOCK", "error": "ERR"}
LABELS = ("EMAIL", "PHONE", "CARD", "SECRET", "IP_PRIVATE")

SCHEMA = """id long, ts timestamp, day date, type string, sid string, host string, method string, path string, ingress string,
 status string, http_status int, ms double, n int, label string, word string, model string, prompt_tokens long,
 completion_tokens long, decision string, rewritten boolean, reused boolean, unresolved int, payload string"""


def adapted(events: DataFrame) -> DataFrame:
    """The events table in the shape of the log. The mapping is ours and only gives the columns varied values."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    u = F.col("user_id")
    kind = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])
    e = events.select("*", k.alias("k"), kind[F.col("event_type")].alias("type"), F.to_date("ts").alias("day"))
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("k")
    mask, restore, err, block = ((F.col("type") == t) for t in ("MASK", "RESTORE", "ERR", "BLOCK"))
    usage = restore | ((F.col("type") == "PASS") & (k % 3 == 0))
    return e.select(
        F.col("event_id").alias("id"), "ts", "day", "type",
        F.concat_ws("-", u.cast("string"), F.date_format("ts", "yyyyMMdd")).alias("sid"),
        F.concat(F.lit("api"), (u % 5).cast("string"), F.lit(".example.com")).alias("host"),
        F.when(k % 7 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/v1/p"), (k % 4).cast("string")).alias("path"),
        F.when(u % 4 == 0, "ext").when(u % 4 == 1, None).otherwise("proxy").alias("ingress"),
        F.when(restore, F.when(k % 4 == 0, "unresolved").when(k % 4 == 1, "incomplete").when(k % 4 == 2, "rewritten").otherwise("ok")).alias("status"),
        F.when(err, 500 + k % 4).otherwise(200).cast("int").alias("http_status"),
        F.col("value").alias("ms"), k.alias("n"),
        F.when(mask | restore, F.element_at(F.array(*[F.lit(x) for x in LABELS]), (k % 5 + 1).cast("int"))).alias("label"),
        F.when(mask | restore, F.concat(F.lit("w"), (k % 37).cast("string"))).alias("word"),
        F.when(usage | err, F.concat(F.lit("vendor"), (u % 3).cast("string"), F.lit("/Model."), (k % 6).cast("string"))).alias("model"),
        F.when(usage, (k * 10).cast("long")).alias("prompt_tokens"),
        F.when(usage, (k * 3 + 1).cast("long")).alias("completion_tokens"),
        F.when(block & (k % 3 == 0), "flagged").when(block & (k % 3 == 1), "blocked").alias("decision"),
        F.when(mask, k % 2 == 0).alias("rewritten"),
        F.when(mask & (k % 2 == 0), k % 3 == 0).alias("reused"),
        F.when(restore & (k % 4 == 0), k % 3).otherwise(0).cast("int").alias("unresolved"),
        F.col("props").alias("payload"),
    )


def ingress(c: Column) -> Column:
    """Lower-cased; unknown or missing is proxy."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("proxy", "ext"), low).otherwise("proxy")


def filtered(log: DataFrame, since: int | None = None, before: int | None = None, until: str | None = None, kind: str | None = None,
             sensitive_only: bool = False, via: str | None = None, search: str | None = None, fulltext: bool = False) -> DataFrame:
    """Rows that satisfy every given condition; a type overrides sensitive_only. % and _ in search are wildcards."""
    out = log
    if since is not None:
        out = out.where(F.col("id") > since)
    if before is not None:
        out = out.where(F.col("id") < before)
    if until is not None:
        out = out.where(F.col("ts") < F.lit(until).cast("timestamp"))
    if kind:
        out = out.where(F.col("type") == kind.upper())
    elif sensitive_only:
        out = out.where(~F.col("type").isin("SKIP", "PASS"))
    if via:
        out = out.where(ingress(F.col("ingress")) == via)
    if search:
        columns = ["host", "path", "method", "status", "type", *["payload"] * fulltext]
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False))
        out = out.where(hit)
    return out


def latest(log: DataFrame, n: int) -> DataFrame:
    """The newest n rows, oldest first."""
    return log.orderBy(F.desc("id")).limit(n).orderBy("id")


def page_after(log: DataFrame, cursor: int, n: int) -> DataFrame:
    return log.where(F.col("id") > cursor).orderBy("id").limit(min(n, 1000))


def page_before(log: DataFrame, cursor: int, n: int) -> DataFrame:
    """The n rows before the cursor, newest first, each with has_more (one row more is read to tell)."""
    probe = log.where(F.col("id") < cursor).orderBy(F.desc("id")).limit(n + 1)
    nth = probe.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("id"))))
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    return nth.withColumn("has_more", total > n).where(F.col("nth") <= n).drop("nth")


def siblings(log: DataFrame) -> DataFrame:
    """Each event with the id of the latest other event of its sid."""
    w = Window.partitionBy("sid").orderBy(F.desc("id"))
    top = log.select("id", "sid", F.first("id").over(w).alias("a"), F.row_number().over(w).alias("nth"))
    second = Window.partitionBy("sid").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = F.max(F.when(F.col("nth") == 2, F.col("id"))).over(second)
    return top.withColumn("b", b).select("id", "sid", F.when(F.col("nth") == 1, F.col("b")).otherwise(F.col("a")).alias("sibling"))


#: The events of a request that belong together; the first of these that is there says how it ended.
ENDS = ("RESTORE", "ERR", "CANCEL")
FOLDED = ("MASK", *ENDS)


def folded(log: DataFrame) -> DataFrame:
    """One row per sid: the first MASK, RESTORE, ERR and CANCEL of the session side by side; host, model and ms of the end, or else of the request."""
    first = F.row_number().over(Window.partitionBy("sid", "type").orderBy("id"))
    one = log.where(F.col("type").isin(*FOLDED)).withColumn("nth", first).where("nth = 1")
    of = lambda t, c: F.max(F.when(F.col("type") == t, F.col(c)))
    ids = [of(t, "id").alias(f"{t.lower()}_id") for t in FOLDED]
    both = [F.coalesce(*[of(t, c) for t in (*ENDS, "MASK")]).alias(c) for c in ("host", "model", "ms")]
    out = one.groupBy("sid").agg(*ids, of("RESTORE", "status").alias("restore_status"), *both)
    end = F.coalesce(*[F.when(F.col(f"{t.lower()}_id").isNotNull(), F.lit(t)) for t in ENDS], F.lit("MASK"))
    return out.withColumn("terminal", end)


def independent(log: DataFrame) -> DataFrame:
    """Events outside the fold: other types, and later ones of the same type in a session."""
    nth = F.row_number().over(Window.partitionBy("sid", "type").orderBy("id"))
    return log.withColumn("nth", nth).where(~F.col("type").isin(*FOLDED) | (F.col("nth") > 1)).drop("nth")


def pruned(log: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows that retention keeps; days <= 0 keeps all."""
    return log if days <= 0 else log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def summary(log: DataFrame, keys: list[str], text: int = 160) -> DataFrame:
    """Allowed payload keys only, as a map with values cut to `text` characters."""
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.substring(F.get_json_object("payload", f"$.{k}"), 1, text) for k in keys]))
    return log.withColumn("payload", F.map_filter(values, lambda k, v: v.isNotNull()))


def bounded_map(m: Column, most: int = 24) -> Column:
    return F.map_from_entries(F.slice(F.map_entries(m), 1, most))


def restore_status(unresolved: Column, incomplete: Column, rewritten: Column, mentioned: Column) -> Column:
    """unresolved over incomplete over rewritten over not_mentioned."""
    return F.when(unresolved, "unresolved").when(incomplete, "incomplete").when(rewritten, "rewritten").when(~mentioned, "not_mentioned").otherwise("ok")


def outcome(kind: Column, status: Column, http_status: Column, age_seconds: Column) -> Column:
    """Eight classes of a row as a user sees it; a request without an answer is in flight for 180 seconds."""
    return (
        F.when(kind == "BLOCK", "blocked")
        .when(kind == "CANCEL", "cancelled")
        .when((kind == "ERR") | (http_status >= 500), "failed")
        .when((kind == "RESTORE") & status.isin("unresolved", "incomplete"), "partial")
        .when(kind == "RESTORE", "restored")
        .when((kind == "MASK") & (age_seconds <= 180), "in_flight")
        .when(kind == "MASK", "no_answer")
        .otherwise("passed")
    )


def failure(message: Column) -> Column:
    low = F.lower(message)
    cancel = low.contains("cancel") | low.contains("client disconnected")
    dns = low.contains("getaddrinfo") | low.contains("name or service not known") | low.contains("nodename nor servname")
    return F.when(cancel, "CANCEL").when(dns, "DNS_ERROR").otherwise("ERR")


def endpoint(text: Column) -> Column:
    """struct(host, port) of host:port, the port null unless it is a number."""
    return F.struct(F.regexp_extract(text, r"^\[?([^\]]*?)\]?(?::[^:\]]*)?$", 1).alias("host"), F.regexp_extract(text, r":([^:\]]*)$", 1).try_cast("int").alias("port"))


def client_app(name: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose word the lower-cased process name holds."""
    out = F.lit("other")
    for word, app in reversed(rules):
        out = F.when(F.lower(name).contains(word), app).otherwise(out)
    return out


#: Fields of an item that a summary keeps.
ITEM_FIELDS = ("label", "token", "count", "kind", "source", "status")


def summary_items(items: Column, most: int = 32) -> Column:
    """array<map<string, string>>: the first `most` items with the fields that a summary keeps, values cut to 160 characters."""
    kept = lambda m: F.transform_values(F.map_filter(m, lambda k, v: k.isin(*ITEM_FIELDS) & v.isNotNull()), lambda k, v: F.substring(v, 1, 160))
    return F.transform(F.slice(items, 1, most), kept)


def traced(items: Column, text: Column, most: int = 1000) -> tuple[Column, Column]:
    """items (maps) without their originals, and the text cut to `most` characters with a mark that says so."""
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("… (cut)"))).otherwise(text)
    return F.transform(items, lambda m: F.map_filter(m, lambda k, v: k != "original")), cut


def log_mode(wanted: Column, trace_until: Column, now: Column) -> Column:
    """summary, detailed or trace; a trace ends at its time, and anything else is summary."""
    return F.when((wanted == "trace") & (now < trace_until), "trace").when(wanted == "detailed", "detailed").otherwise("summary")


#: A marker that set-up writes into requests: a fixed prefix and 16 letters or digits, between edges.
MARKER = r"(?<![A-Za-z0-9_-])qlmark-[A-Za-z0-9]{16}(?![A-Za-z0-9_-])"


def markers(text: Column) -> Column:
    """array<string>: SHA-256 of each distinct marker in a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))), lambda m: F.sha2(m, 256))


def scrubbed(text: Column, diagnostic: bool = False) -> Column:
    """JSON text, keys and values alike, without markers; for a diagnosis also without the field `request_body`."""
    out = F.regexp_replace(text, MARKER, "[marker]")
    return F.regexp_replace(out, r'"request_body"\s*:\s*(?:"(?:[^"\\]|\\.)*+"|[^,{}\[\]]*+)\s*,?', "") if diagnostic else out


#: Columns of a record that never leave it.
PRIVATE = ("marker", "nonce", "secret")


def public(records: DataFrame) -> DataFrame:
    return records.drop(*PRIVATE)


def targeted(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows that a target (domain, path; a null path is any) covers: its domain or a subdomain, and exactly its path.

    A host meets the targets of each of its own endings, so the join is on equal domains.
    """
    labels = F.split(F.lower("host"), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = targets.select(F.lower("domain").alias("_d"), F.col("path").alias("_p")).distinct()
    hosts = log.select("host").distinct().select("host", F.explode(endings).alias("_d")).join(known, "_d").select(F.col("host").alias("_h"), "_p").distinct()
    return log.join(hosts, (F.col("host") == F.col("_h")) & (F.col("_p").isNull() | (F.col("_p") == F.split_part("path", F.lit("?"), F.lit(1)))), "left_semi")


def routed(log: DataFrame, routes: DataFrame, port: str = "port", path: str = "path") -> DataFrame:
    """log with upstream and upstream_path: by the port that listens, else by the longest prefix of the path, which is cut off; queries stay.

    routes: port, prefix, upstream. A path meets the routes of each of its own prefixes that end at a slash.
    """
    by_port = routes.where("port IS NOT NULL").groupBy(F.col("port").alias("_port")).agg(F.min("upstream").alias("_u1"))
    prefixes = routes.where("prefix IS NOT NULL").groupBy(F.col("prefix").alias("_prefix")).agg(F.min("upstream").alias("_u2"))
    bare = F.split_part("_path", F.lit("?"), F.lit(1))
    steps = F.split(bare, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    paths = log.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct()
    best = paths.select("_path", F.explode(heads).alias("_prefix")).join(prefixes, "_prefix").groupBy("_path").agg(F.max_by(F.struct("_prefix", "_u2"), F.length("_prefix")).alias("_b"))
    both = log.join(by_port, F.col(port) == F.col("_port"), "left").join(best, F.col(path) == F.col("_path"), "left")
    upstream = F.coalesce("_u1", "_b._u2")
    rest = F.when(F.col("_u1").isNull() & F.col("_b").isNotNull(), F.substr(path, F.length("_b._prefix") + 1)).otherwise(F.col(path))
    return both.select(*log.columns, upstream.alias("upstream"), rest.alias("upstream_path"))


def unlisted(method: Column, body: Column, fail_closed: bool) -> Column:
    """What to do with a request that no target covers: pass (only reads), mask (its shape is that of a model's request) or, of an unknown shape, mask or pass."""
    keys = F.json_object_keys(body)
    shaped = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ("messages", "prompt", "input", "contents", "model")]))
    return F.when(F.upper(method).isin("GET", "HEAD", "OPTIONS"), "pass").when(F.coalesce(shaped, F.lit(False)), "mask").otherwise("mask" if fail_closed else "pass")


def typing_probe(body: Column, keys: tuple[str, ...] = ("typing", "is_typing")) -> Column:
    """Whether a body is only the notice that somebody types: one of these keys at its top."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(body), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def as_of(rows: DataFrame, changes: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """rows with the values of the last of changes (key, time, values) that has the row's key and is not later than it; null without one.

    Rows and changes are sorted together over the cluster by key and time and cut into slices of
    about equal size, whatever one key holds. Within a slice the last change is carried forward;
    what a slice begins with comes from the ends of the slices before it, of which there is one
    for each slice and key. No row is paired with more than one change. Of changes at one time the
    largest counts; rows without key or time have nulls.
    """
    value = F.struct(*[F.col(v).alias(v) for v in values])
    known = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_p"), F.col(time).alias("_t")).agg(F.max(value).alias("_o"))
    of = known.schema["_o"].dataType
    mine = rows.select(F.col(key).alias("_p"), F.col(time).alias("_t"), F.struct(*[F.col(c).alias(c) for c in rows.columns]).alias("_e"))
    datable = F.col("_p").isNotNull() & F.col("_t").isNotNull()
    both = mine.where(datable).select("_p", "_t", F.lit(1).alias("_k"), "_e", F.lit(None).cast(of).alias("_o"))
    both = both.unionByName(known.select("_p", "_t", F.lit(0).alias("_k"), F.lit(None).cast(mine.schema["_e"].dataType).alias("_e"), "_o"))
    cut = written(both.repartitionByRange("_p", "_t").withColumn("_s", F.spark_partition_id()), "slices")
    within = Window.partitionBy("_s", "_p").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(F.when(F.col("_k") == 0, F.col("_o")), F.when(F.col("_k") == 0, F.col("_t")))
    ends = cut.groupBy("_s", "_p").agg(last.alias("_last"))
    before = Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_s", "_p", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    filled = cut.withColumn("_o", F.last("_o", ignorenulls=True).over(within)).where("_k = 1").join(carried, ["_s", "_p"], "left")
    found = filled.select("_e", F.coalesce("_o", "_carried").alias("_o"))
    found = found.unionByName(mine.where(~datable).select("_e", F.lit(None).cast(of).alias("_o")))
    return found.select(*[F.col("_e").getField(c).alias(c) for c in rows.columns], *[F.col("_o").getField(v).alias(v) for v in values])


def with_process(log: DataFrame, ports: DataFrame, port: str = "client_port") -> DataFrame:
    """log with pid and app of the client, by the port that it sent from; the newest owner (port, pid, app, ts) not younger than the event."""
    return as_of(log, ports.select(F.col("port").alias(port), "pid", "app", "ts"), port, "ts", ["pid", "app"])


def by_ids(log: DataFrame, ids: list[int]) -> DataFrame:
    return log.where(F.col("id").isin(*ids)) if ids else log.limit(0)


def cleared(log: DataFrame, cutoff: Column) -> DataFrame:
    """After a clear: rows of before the cutoff are gone whenever they arrive."""
    return log.where(F.col("ts") >= cutoff)


def terminal(log: DataFrame) -> DataFrame:
    """Per session its terminal state: RESTORE over ERR over CANCEL over BLOCK; open without any of them."""
    order = ("RESTORE", "ERR", "CANCEL", "BLOCK")
    has = [F.max((F.col("type") == t).cast("int")).alias(t) for t in order]
    state = F.coalesce(*[F.when(F.col(t) == 1, F.lit(t)) for t in order], F.lit("OPEN"))
    return log.groupBy("sid").agg(*has).select("sid", state.alias("state"))


def table_size(table: DataFrame) -> DataFrame:
    """Files, bytes and rows of a table that is read from files."""
    each = table.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.first("file_size").alias("bytes"), F.count("*").alias("rows"))
    return each.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def compacted(table: DataFrame, path: str, target_bytes: int = 128 << 20, least: float = 0.25) -> bool:
    """Rewrites a table into files of about target_bytes at path if that saves at least this share of its files; returns whether it did.

    path must not be where the table is read from, nor within it or around it: a table that is
    overwritten while it is read is lost.
    """
    bare = lambda p: "/" + p.split(":", 1)[-1].strip("/") + "/"
    target = bare(path)
    if any(bare(f).startswith(target) or target.startswith(bare(f.rsplit("/", 1)[0])) for f in table.inputFiles()):
        raise ValueError(f"{path} is where the table is read from")
    size = table_size(table).first()
    files = max(1, -(-size["bytes"] // target_bytes)) if size["files"] else 0
    if not size["files"] or size["files"] - files < least * size["files"] or size["files"] == files:
        return False
    table.coalesce(files).write.mode("overwrite").parquet(path)
    return True
