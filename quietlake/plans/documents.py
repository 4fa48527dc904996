"""Queries over documents, conversations, benchmark and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import validators as V
from ..operators import automaton as A
from ..operators import dictionary as W
from ..operators import jsonwalk as J
from ..operators import tokens as T
from .tables import load, texts


def dialog_concat(spark, sf_dir):
    """Each conversation as one text, turns in order."""
    t = load(spark, sf_dir, "conversations")
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    return per.select("conv_id", F.size("t").alias("turns"), F.sha2(F.array_join(lines, "\n"), 256).alias("dialog_sha256"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "conversations").where("text IS NOT NULL")
    block = F.struct("role", F.struct(F.lit("text").alias("type"), "text").alias("content"))
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("m")))).alias("ms"))
    body = F.struct(F.lit("vendor/model").alias("model"), F.transform("ms", lambda x: x["m"]).alias("messages"), F.col("conv_id").alias("seed"))
    return per.select("conv_id", F.to_json(body).alias("body"))


def roles_scope(spark, sf_dir):
    """Bodies built from conversations: scanned leaves and characters by role."""
    leaf = J.leaf_table(_bodies(spark, sf_dir), "conv_id")
    scan = J.scannable(F.col("key"), F.col("kind"), F.col("value"), F.col("business"), F.col("definition"))
    return leaf.where(scan & F.col("role").isNotNull()).groupBy("role").agg(F.count("*").alias("leaves"), F.sum(F.length("value")).alias("chars"))


def json_leaf_kinds(spark, sf_dir):
    leaf = J.leaf_table(_bodies(spark, sf_dir), "conv_id")
    scan = J.scannable(F.col("key"), F.col("kind"), F.col("value"), F.col("business"), F.col("definition"))
    return leaf.groupBy("key", "kind", scan.alias("scanned")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def json_usage(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    odd = F.concat(F.lit('{"usage":{"input_tokens":'), k, F.lit(',"output_tokens":2}}'))
    even = F.concat(F.lit('{"usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":1,"prompt_tokens_details":{"cached_tokens":3}}}'))
    u = J.usage(F.when(F.col("event_id") % 2 == 0, even).otherwise(odd))
    return e.select("event_type", u.alias("u")).groupBy("event_type").agg(
        F.sum("u.prompt").alias("prompt"), F.sum("u.completion").alias("completion"), F.sum("u.cache_read").alias("cache_read")
    )


def benchmark_leak_join(spark, sf_dir):
    """Distinct runs of eight words that a document shares with a benchmark item: two hashes of each run are compared, 128 bits in all.

    Runs of documents are not made distinct before the join, where only few are left; both
    hashes are computed while the runs are written out, one pass over each text.
    """
    run = F.array_join(F.slice("w", F.col("at") + 1, 8), " ")
    words = lambda df, i: df.where("text IS NOT NULL").select(i, F.split(F.lower("text"), r"\s+").alias("w")).where("size(w) >= 8")
    places = lambda df, i: words(df, i).select(i, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 8)).alias("at"))
    runs = lambda df, i: places(df, i).select(i, F.xxhash64(run).alias("h"), F.xxhash64(run, F.lit(1)).alias("h2"))
    items = runs(load(spark, sf_dir, "benchmark"), "item_id").distinct()
    docs = runs(texts(spark, sf_dir, "documents"), "doc_id")
    shared = docs.join(items, ["h", "h2"]).groupBy("doc_id", "item_id", "h", "h2").agg(F.count("*").alias("n"))
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("runs"))


def dictionary_hits(spark, sf_dir):
    """The words of benchmark items that are longer than 12 letters, counted in documents."""
    b = load(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_@.+-]+")).alias("w"))
    words = b.select(F.regexp_replace("w", r"^[.+-]+|[.+-]+$", "").alias("word")).where("length(word) > 12").distinct()
    return W.word_hits(load(spark, sf_dir, "documents").select("doc_id", "text"), words).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from the parts: a code of three letters for each key, and the names."""
    letter = lambda n: F.char((97 + F.floor(F.col("p_partkey") / n) % 26).cast("int"))
    p = load(spark, sf_dir, "part")
    return p.select(F.concat(letter(1), letter(26), letter(676)).alias("word")).union(p.select("p_name")).where("word <> ''").distinct()


def dictionary_substrings(spark, sf_dir):
    """Documents that hold a code or a name of a part anywhere and in any case, by an automaton of all of them."""
    docs = texts(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    found = A.found(docs, _codes(spark, sf_dir)).select(F.explode(F.array_distinct(F.transform("words", lambda w: w["word"]))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("docs"))


def dictionary_merge(spark, sf_dir):
    """Customers' names as existing words by segment, suppliers' names and some customers' again as picked ones, 120 per segment."""
    c = load(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("word"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("word"))
    return W.merged(old, new, 120).groupBy("category", "state").agg(F.count("*").alias("n"))


def validators_derived(spark, sf_dir):
    """Numbers made from customer keys by rule, so that about one in ten or less is valid of each kind."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    born = F.concat(pad(1950 + k % 50, 4), pad(k % 14, 2), pad(k % 32, 2))
    id_card = F.concat(pad(11 + k % 5, 2), F.lit("0101"), born, pad(k % 1000, 3), F.when(k % 11 == 10, "X").otherwise((k % 11).cast("string")))
    phone = F.concat(F.lit("13"), pad(k * 7919 % 1000000000, 9))
    card = F.concat(F.lit("4"), pad(k * 104729, 15))
    iban = F.concat(F.lit("DE"), pad(k % 97, 2), pad(k * 15485863, 18))
    uscc = F.concat(F.lit("91"), pad(k * 31 % 1000000, 6), F.lit("MA"), pad(k, 7), F.substring(F.lit(V.USCC_ALPHABET), (k % 31 + 1).cast("int"), F.lit(1)))
    ip = F.concat_ws(".", *[(k * m % 300).cast("string") for m in (1, 7, 11, 13)])
    flags = {"id_card": V.id_card_ok(id_card), "phone": V.cn_mobile_ok(phone), "card": V.card_ok(card), "iban": V.iban_ok(iban), "uscc": V.uscc_ok(uscc), "ip": V.ipv4_ok(ip)}
    return c.select("c_custkey", *[f.alias(n) for n, f in flags.items()])


def pages_hosts(spark, sf_dir):
    """Pages by host, and whether they belong to example.com at a domain boundary."""
    host = X.host_of(F.col("url"))
    p = load(spark, sf_dir, "pages").select(host.alias("host"))
    return p.groupBy("host", X.domain_matches(F.col("host"), F.lit("example.com")).alias("ours")).agg(F.count("*").alias("n"))


def display_words(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", T.masked_word(F.col("c_name"), F.col("c_custkey") % 2 == 0).alias("shown"), T.preview(F.lit("EMAIL"), F.col("c_name")).alias("preview"))


def toxic_by_source(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    x = d.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def orders_calendar(spark, sf_dir):
    """Orders per month of the whole span, empty months included."""
    o = load(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_totalprice")
    ends = o.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(o, "month", "left").groupBy("month").agg(F.count("o_totalprice").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


def top_orders(spark, sf_dir):
    """Each customer's three largest orders, ties by key."""
    o = load(spark, sf_dir, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", "o_totalprice", nth.alias("rank")).where("rank <= 3")


QUERIES = {
    f.__name__: f
    for f in (
        dialog_concat, roles_scope, json_leaf_kinds, json_usage, benchmark_leak_join, dictionary_hits, dictionary_substrings, dictionary_merge, validators_derived, pages_hosts,
        display_words, toxic_by_source, orders_calendar, top_orders,
    )
}

from . import sqlparts as S  # noqa: E402

_ID = f"""lpad((11 + k % 5)::VARCHAR, 2, '0') || '0101' || lpad((1950 + k % 50)::VARCHAR, 4, '0') || lpad((k % 14)::VARCHAR, 2, '0') || lpad((k % 32)::VARCHAR, 2, '0')
  || lpad((k % 1000)::VARCHAR, 3, '0') || CASE WHEN k % 11 = 10 THEN 'X' ELSE (k % 11)::VARCHAR END"""
_TURNED = "(substr(iban, 5, 40) || substr(iban, 1, 4))"
_USCC_SUM = " + ".join(f"(strpos('{V.USCC_ALPHABET}', substr(uscc, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(V.USCC_WEIGHTS))
_RUNS = """{n} AS (SELECT DISTINCT {i}, array_to_string(w[g:g + 7], ' ') AS h FROM (
    SELECT {i}, w, unnest(generate_series(1, len(w) - 7)) AS g FROM (SELECT {i}, regexp_split_to_array(lower(text), '\\s+') AS w FROM {t}) WHERE len(w) >= 8))"""
_TOKENS = r"regexp_replace(unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_@.+-]+')), '^[.+-]+|[.+-]+$', '', 'g')"

ORACLE_SQL = {
    "dialog_concat": "SELECT conv_id, count(*)::INTEGER AS turns, sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS dialog_sha256 FROM conversations GROUP BY conv_id",
    "roles_scope": "SELECT role, count(*) AS leaves, sum(length(text))::BIGINT AS chars FROM conversations WHERE text IS NOT NULL GROUP BY role",
    "json_leaf_kinds": """WITH c AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS k FROM conversations WHERE text IS NOT NULL)
        SELECT 'model' AS key, 'string' AS kind, false AS scanned, k AS n, 1::INTEGER AS depth FROM c UNION ALL SELECT 'seed', 'number', true, k, 1 FROM c
        UNION ALL SELECT 'role', 'string', false, n, 3 FROM c UNION ALL SELECT 'type', 'string', false, n, 4 FROM c UNION ALL SELECT 'text', 'string', true, n, 4 FROM c""",
    "json_usage": """SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS prompt, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS completion,
        sum(CASE WHEN event_id % 2 = 0 THEN 3 END)::BIGINT AS cache_read FROM events GROUP BY event_type""",
    "benchmark_leak_join": f"WITH {_RUNS.format(n='d', i='doc_id', t='documents')}, {_RUNS.format(n='b', i='item_id', t='benchmark')} SELECT doc_id, item_id, count(*) AS runs FROM d JOIN b USING (h) GROUP BY ALL",
    "dictionary_hits": f"""WITH b AS (SELECT DISTINCT w FROM (SELECT {_TOKENS} AS w FROM benchmark) WHERE length(w) > 12),
        d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) GROUP BY doc_id, w)
        SELECT w AS word, sum(n)::BIGINT AS n, count(*) AS docs FROM d JOIN b USING (w) GROUP BY w""",
    "dictionary_substrings": """WITH c AS (
  SELECT chr((97 + p_partkey % 26)::INT) || chr((97 + p_partkey // 26 % 26)::INT) || chr((97 + p_partkey // 676 % 26)::INT) AS word FROM part UNION SELECT p_name FROM part)
SELECT word, count(*) AS docs FROM c JOIN (SELECT lower(text) AS text FROM documents) ON contains(text, word) WHERE word <> '' GROUP BY word""",
    "dictionary_merge": """WITH u AS (SELECT c_mktsegment AS category, c_name AS word, 0 AS new FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_mktsegment, c_name, 1 FROM customer WHERE c_custkey % 2 = 0),
        s AS (SELECT *, row_number() OVER (PARTITION BY category, word ORDER BY new) AS same FROM u),
        n AS (SELECT *, sum(CASE WHEN same = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY new, word ROWS UNBOUNDED PRECEDING) AS nth FROM s)
        SELECT category, CASE WHEN same > 1 THEN 'duplicate' WHEN nth > 120 THEN 'overflow' WHEN new = 1 THEN 'added' ELSE 'kept' END AS state, count(*) AS n FROM n GROUP BY 1, 2""",
    "validators_derived": f"""WITH c AS (SELECT c_custkey AS k, {_ID.replace('k ', 'c_custkey ')} AS id_card, '13' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS phone,
          '4' || lpad((c_custkey * 104729)::VARCHAR, 15, '0') AS card, 'DE' || lpad((c_custkey % 97)::VARCHAR, 2, '0') || lpad((c_custkey * 15485863)::VARCHAR, 18, '0') AS iban,
          '91' || lpad((c_custkey * 31 % 1000000)::VARCHAR, 6, '0') || 'MA' || lpad(c_custkey::VARCHAR, 7, '0') || substr('{V.USCC_ALPHABET}', c_custkey % 31 + 1, 1) AS uscc,
          (c_custkey % 300) || '.' || (c_custkey * 7 % 300) || '.' || (c_custkey * 11 % 300) || '.' || (c_custkey * 13 % 300) AS ip FROM customer)
        SELECT k AS c_custkey, {S.id_card_ok('id_card')} AS id_card, {S.cn_mobile_ok('phone')} AS phone, {S.card_ok('card')} AS card,
          (array_to_string(list_transform(string_split({_TURNED}, ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), ''))::HUGEINT % 97 = 1 AS iban,
          substr(uscc, 18, 1) = substr('{V.USCC_ALPHABET}', ((31 - ({_USCC_SUM}) % 31) % 31 + 1)::INTEGER, 1) AS uscc, {S.ipv4_ok('ip')} AS ip FROM c""",
    "pages_hosts": r"""WITH h AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages)
        SELECT host, (host = 'example.com' OR ends_with(host, '.example.com')) AS ours, count(*) AS n FROM h GROUP BY ALL""",
    "display_words": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN repeat('•', least(length(c_name), 8)) WHEN length(c_name) <= 2 THEN left(c_name, 1) || '*'
        ELSE left(c_name, 1) || repeat('*', least(greatest(length(c_name) - 2, 1), 6)) || right(c_name, 1) END AS shown, '<EMAIL ' || length(c_name) || '>' AS preview FROM customer""",
    "toxic_by_source": "SELECT source, count(*) AS n, count(quality) AS labelled, count_if(toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "orders_calendar": """WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_totalprice AS p FROM orders),
        m AS (SELECT unnest(generate_series((SELECT min(month) FROM o), (SELECT max(month) FROM o), INTERVAL 1 MONTH))::DATE AS month)
        SELECT month, count(p) AS orders, round(coalesce(sum(p), 0.0), 2) AS total FROM m LEFT JOIN o USING (month) GROUP BY month""",
    "top_orders": """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) SELECT * FROM r WHERE rank <= 3""",
}
