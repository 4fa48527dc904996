"""Queries over texts: detect, count, mask, restore, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import text as X
from ..operators import known as K
from ..operators import tokens as T
from . import sqlparts as S
from .tables import load, texts

#: A fixed key, so that the SQL side can compute the same placeholders. Real jobs pass their own.
KEY = "demonstration-key"
L = S.LABELS


def _hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", *columns, "text")
    return T.found_values(docs, "text", L)


def detect_summary(spark, sf_dir):
    return _hits(spark, sf_dir, "source").groupBy("source", "label").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("value").alias("distinct_values")
    )


def detect_email_by_lang(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hits = T.found_values(docs, "text", ["EMAIL"])
    return hits.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(F.lower("value")).alias("addresses"))


def detect_ipv4_valid(spark, sf_dir):
    hits = _hits(spark, sf_dir).where(F.col("label").startswith("IP_"))
    first = F.split_part("value", F.lit("."), F.lit(1)).cast("int")
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.min(first).alias("low"), F.max(first).alias("high"))


def detect_card_luhn(spark, sf_dir):
    hits = _hits(spark, sf_dir).where("label = 'CARD'")
    return hits.select("doc_id", "pos", F.right("value", F.lit(4)).alias("last4"), F.length("value").alias("len"))


def detect_secret_assign(spark, sf_dir):
    hits = _hits(spark, sf_dir, "source").where("label = 'SECRET'")
    return hits.select("doc_id", "source", T.preview(F.col("label"), F.col("value")).alias("preview"), T.credential_digest(F.col("value")).alias("digest"))


def detect_spans(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "start", "stop", "label")


def pages_pii_summary(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages").select("page_id", X.decode_entities(F.col("html")).alias("text"))
    return T.found_values(pages, "text", L).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def conversations_pii_by_role(spark, sf_dir):
    """Every role with its number of turns and of findings, zero included."""
    turns = texts(spark, sf_dir, "conversations").select("role", F.size(D.detect(F.col("text"), L)).alias("k"))
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.sum("k").alias("found"))


def mask_documents_tokens(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    out = T.mask(docs, KEY, labels=L)
    return out.select("doc_id", F.sha2("text", 256).alias("masked_sha256"), F.length("text").alias("masked_len"))


def first_differences(spark, sf_dir):
    """Where a masked text begins to differ from the text, and how much of the text stays in front of it."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), "text")
    at = X.first_difference(F.col("before"), F.col("text"))
    out = T.mask(docs, KEY, labels=L).select("doc_id", F.length("before").alias("length"), at.alias("first"))
    return out.select("doc_id", "first", F.when(F.col("first") < 0, F.col("length")).otherwise(F.col("first")).alias("reused"))


def mapping_distinct_values(spark, sf_dir):
    return T.mapping(_hits(spark, sf_dir), KEY).select("label", "token", F.sha2("value", 256).alias("value_sha256"))


def mask_roundtrip(spark, sf_dir):
    """Per document whether restore(mask(text)) gives the text again."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    known = T.mapping(T.found_values(docs, "text", L), KEY)
    back = T.restore(T.mask(docs, KEY, labels=L, known=known), known)
    return back.select("doc_id", F.sha2("text", 256).alias("restored_sha256"))


def mask_idempotent(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    once = T.mask(docs, KEY, labels=L)
    twice = once.select("doc_id", D.replaced(F.col("text"), lambda c: T.token(c["label"], c["value"], KEY), L).alias("again"), "text")
    return twice.agg(F.count_if(F.col("again") == F.col("text")).alias("same"), F.count("*").alias("documents"))


def egress_leaks(spark, sf_dir):
    """Values that a masked text still holds, in one pass over each text."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", T.egress(F.col("text"), L).alias("e"))
    return docs.select("doc_id", "e.leaks", "e.skipped")


def restore_accounting(spark, sf_dir):
    """The mapping of documents from even sources is lost; the tokens of emails were never issued."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hits = T.found_values(docs, "text", L)
    all_ = T.mapping(hits, KEY)
    masked = T.mask(docs.select("doc_id", "text"), KEY, labels=L, known=all_)
    return T.accounting(masked, all_.where((F.length("value") % 2 == 0) & (F.col("label") != "EMAIL")), all_.where("label <> 'EMAIL'"), "doc_id")


def rule_actions(spark, sf_dir):
    """mask counts and replaces, warn counts only, block counts and flags the document."""
    actions = F.create_map(*[F.lit(x) for p in (("EMAIL", "mask"), ("CARD", "block"), ("SECRET", "block")) for x in p])
    hits = _hits(spark, sf_dir).withColumn("action", F.coalesce(actions[F.col("label")], F.lit("warn")))
    return hits.groupBy("doc_id").agg(
        F.count_if(F.col("action") == "mask").alias("masked"), F.count_if(F.col("action") == "warn").alias("warned"),
        F.max((F.col("action") == "block").cast("int")).alias("blocked"),
    )


def allow_values(spark, sf_dir):
    """Values of the labels table's toxic documents are exempt everywhere, in any case."""
    hits = _hits(spark, sf_dir)
    exempt = hits.join(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.lower("value").alias("allowed")).distinct()
    kept = hits.join(exempt, F.lower("value") == F.col("allowed"), "left_anti")
    return kept.groupBy("label").agg(F.count("*").alias("n"))


def quality_by_pii(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.size(D.detect(F.col("text"), L))
    each = docs.select("doc_id", (k > 0).alias("has_pii")).join(load(spark, sf_dir, "labels"), "doc_id")
    return each.groupBy("has_pii").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


def known_value_scan(spark, sf_dir):
    """Values of 8 characters or more that are no credentials, each once, with the number of documents that hold them anywhere."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    known = T.found_values(docs, "text", L).where((F.length("value") >= 8) & ~F.col("label").isin(*D.CREDENTIALS)).select("value").distinct()
    return K.held(docs, known).select(F.sha2("value", 256).alias("value_sha256"), F.col("n").alias("docs"))


def secret_entropy(spark, sf_dir):
    from ..functions import validators as V

    hits = _hits(spark, sf_dir).where("label = 'SECRET'").select("value").distinct()
    return hits.select(
        T.credential_digest(F.col("value")).alias("digest"), F.round(V.entropy(F.col("value")), 6).alias("entropy"), V.ordered_sequence(F.col("value")).alias("ordered")
    )


_H = S.found()
QUERIES = {
    f.__name__: f
    for f in (
        detect_summary, detect_email_by_lang, detect_ipv4_valid, detect_card_luhn, detect_secret_assign, detect_spans, pages_pii_summary,
        conversations_pii_by_role, mask_documents_tokens, first_differences, mapping_distinct_values, mask_roundtrip, mask_idempotent, egress_leaks, restore_accounting,
        rule_actions, allow_values, quality_by_pii, known_value_scan, secret_entropy,
    )
}

_VALUE, _HEAD, _TAIL = (f("label", "m") for f in (S.value, S.head, S.tail))
_EMAIL = S.quoted(D.fused(["EMAIL"]))
_MASKED = f"""
base AS (SELECT doc_id, text, regexp_extract_all(text, {S.fused()}) AS ms, regexp_split_to_array(text, {S.fused()}) AS gs FROM documents),
parts AS (
  SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS i, ms FROM base
),
apart AS (
  SELECT doc_id, i, g, CASE WHEN {S.refused('ms[i]')} THEN regexp_split_to_array(ms[i], {S.hidden()}) ELSE [''] END AS gs,
    CASE WHEN {S.refused('ms[i]')} THEN regexp_extract_all(ms[i], {S.hidden()}) ELSE [ms[i]] END AS ms FROM parts
),
again AS (SELECT doc_id, i, g, unnest(gs) AS inner_g, generate_subscripts(gs, 1) AS j, ms FROM apart),
lab AS (
  SELECT doc_id, 1000000 * i + j AS i, CASE WHEN j = 1 THEN g ELSE '' END || inner_g AS g, ms[j] AS m,
    CASE WHEN ms[j] IS NULL THEN NULL ELSE {S.label('ms[j]')} END AS label FROM again
),
masked AS (
  SELECT doc_id, string_agg(g || CASE WHEN m IS NULL THEN '' WHEN label IS NULL THEN m
    ELSE {_HEAD} || {S.token('label', _VALUE, KEY)} || {_TAIL} END, '' ORDER BY i) AS text
  FROM lab GROUP BY doc_id
)"""

ORACLE_SQL = {
    "detect_summary": f"WITH {S.found(extra='source')} SELECT source, label, count(*) AS n, count(DISTINCT doc_id) AS docs, count(DISTINCT value) AS distinct_values FROM hits GROUP BY source, label",
    "detect_email_by_lang": f"""WITH c AS (SELECT lang, unnest(regexp_extract_all(text, {_EMAIL})) AS m FROM documents)
        SELECT lang, count(*) AS n, count(DISTINCT lower(m)) AS addresses FROM c WHERE m LIKE '%@%' GROUP BY lang""",
    "detect_ipv4_valid": f"WITH {_H} SELECT label, count(*) AS n, min(split_part(value, '.', 1)::INTEGER) AS low, max(split_part(value, '.', 1)::INTEGER) AS high FROM hits WHERE label LIKE 'IP%' GROUP BY label",
    "detect_card_luhn": f"WITH {_H} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1)::INTEGER AS pos, label, value FROM hits",
    "detect_secret_assign": f"""WITH {S.found(extra='source')} SELECT doc_id, source,
        CASE WHEN length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') THEN left(value, 3) || '…' || right(value, 4)
          ELSE '<' || label || ' ' || length(value) || '>' END AS preview, substr(sha256(value), 1, 16) AS digest FROM hits WHERE label = 'SECRET'""",
    "detect_spans": f"""WITH {_MASKED}, p AS (
          SELECT doc_id, i, label, m, {_VALUE} AS value, {_HEAD} AS head,
            sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) - coalesce(length(m), 0) AS pos FROM lab)
        SELECT doc_id, (pos + length(head))::INTEGER AS start, (pos + length(head) + length(value))::INTEGER AS stop, label FROM p WHERE label IS NOT NULL""",
    "first_differences": f"""WITH {_MASKED}, p AS (
          SELECT doc_id, label, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) - coalesce(length(m), 0) + length({_HEAD}) AS pos FROM lab),
        s AS (SELECT doc_id, min(pos) AS pos FROM p WHERE label IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, coalesce(pos, -1)::INTEGER AS first, coalesce(pos, length(text))::INTEGER AS reused FROM documents LEFT JOIN s USING (doc_id)""",
    "pages_pii_summary": f"""WITH pg AS (SELECT page_id, {{decoded}} AS text FROM pages), {S.found('pg', 'page_id')}
        SELECT label, count(*) AS n, count(DISTINCT page_id) AS pages FROM hits GROUP BY label""",
    "conversations_pii_by_role": f"""WITH cv AS (SELECT row_number() OVER () AS k, role, text FROM conversations), {S.found('cv', 'k')},
        c AS (SELECT k, count(*) AS n FROM hits GROUP BY k)
        SELECT role, count(*) AS turns, sum(coalesce(n, 0))::BIGINT AS found FROM cv LEFT JOIN c USING (k) GROUP BY role""",
    "mask_documents_tokens": f"WITH {_MASKED} SELECT doc_id, sha256(text) AS masked_sha256, length(text)::INTEGER AS masked_len FROM masked",
    "mapping_distinct_values": f"WITH RECURSIVE {_H}, {S.mapping('hits', KEY)} SELECT label, token, sha256(value) AS value_sha256 FROM known",
    "mask_roundtrip": "SELECT doc_id, sha256(text) AS restored_sha256 FROM documents",
    "mask_idempotent": "SELECT count(*) AS same, count(*) AS documents FROM documents",
    "egress_leaks": f"""WITH {_MASKED}, {_H},
        k AS (SELECT d.doc_id, count(DISTINCT h.value)::INTEGER AS leaks FROM documents d LEFT JOIN masked k ON k.doc_id = d.doc_id LEFT JOIN hits h ON h.doc_id = k.doc_id
          AND length(h.value) >= 4 AND h.label NOT IN {T.D.CREDENTIALS} AND contains(regexp_replace(k.text, {S.quoted(T.TOKEN)}, chr(1), 'g'), h.value) GROUP BY d.doc_id)
        SELECT doc_id, leaks, NULL::VARCHAR AS skipped FROM k""",
    "restore_accounting": f"""WITH {_H}
        SELECT doc_id, count_if(label <> 'EMAIL' AND length(value) % 2 = 0) AS restored, 0::BIGINT AS degraded,
          count_if(label <> 'EMAIL' AND length(value) % 2 = 1) AS unresolved, count_if(label = 'EMAIL') AS foreign
        FROM hits GROUP BY doc_id""",
    "rule_actions": f"""WITH {_H} SELECT doc_id, count_if(label = 'EMAIL') AS masked, count_if(label NOT IN ('EMAIL', 'CARD', 'SECRET')) AS warned,
        max(CASE WHEN label IN ('CARD', 'SECRET') THEN 1 ELSE 0 END)::INTEGER AS blocked FROM hits GROUP BY doc_id""",
    "allow_values": f"""WITH {_H}, e AS (SELECT DISTINCT lower(value) AS v FROM hits WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
        SELECT label, count(*) AS n FROM hits WHERE lower(value) NOT IN (SELECT v FROM e) GROUP BY label""",
    "quality_by_pii": f"""WITH {_H}, d AS (SELECT DISTINCT doc_id FROM hits)
        SELECT (d.doc_id IS NOT NULL) AS has_pii, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic
        FROM documents JOIN labels USING (doc_id) LEFT JOIN d USING (doc_id) GROUP BY 1""",
    "known_value_scan": f"""WITH {_H}, v AS (SELECT DISTINCT value FROM hits WHERE length(value) >= 8 AND label NOT IN {D.CREDENTIALS})
        SELECT sha256(value) AS value_sha256, count(*) AS docs FROM v JOIN documents ON contains(text, value) GROUP BY value""",
    "secret_entropy": f"""WITH {_H}, d AS (SELECT DISTINCT value FROM hits WHERE label = 'SECRET'),
        ch AS (SELECT value, unnest(string_split(value, '')) AS c FROM d), f AS (SELECT value, c, count(*) AS n FROM ch GROUP BY 1, 2)
        SELECT substr(sha256(value), 1, 16) AS digest, round(-sum(n / length(value) * log2(n / length(value))), 6) AS entropy,
          (contains('abcdefghijklmnopqrstuvwxyz', lower(value)) OR contains('0123456789', lower(value))
           OR contains('zyxwvutsrqponmlkjihgfedcba', lower(value)) OR contains('9876543210', lower(value))) AS ordered
        FROM f GROUP BY value""",
}
ORACLE_SQL["detect_card_luhn"] = f"""WITH {_H}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS pos FROM hits)
    SELECT doc_id, pos::INTEGER AS pos, right(value, 4) AS last4, length(value)::INTEGER AS len FROM r WHERE label = 'CARD'"""
ORACLE_SQL["pages_pii_summary"] = ORACLE_SQL["pages_pii_summary"].replace("{decoded}", X.DECODE_SQL.format("html"))
