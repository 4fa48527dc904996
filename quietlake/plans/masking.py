"""Queries over texts that hold known values, derived from the tables' own rows: their SQL knows where each value stands and uses no pattern of ours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import normalize as N
from ..functions import validators as V
from ..operators import dictionary as W
from ..operators import entities as E
from ..operators import jsonwalk as J
from ..operators import tokens as T
from ..operators import zhnames as Z
from ..sources import files as S
from . import sqlparts as Q
from .detection import KEY
from .tables import SHORT_ROWS, dealt, load


_NUMERALS = "零一二三四五六七八九"


def _pad(c, n: int):
    return F.lpad(c.cast("string"), n, "0")


def _phone(k):
    return F.concat(F.lit("13"), _pad(k * 7919 % 1_000_000_000, 9))


def long_secrets(spark, sf_dir):
    """A credential of up to some 12,000 characters for each customer is one placeholder; nothing of it stays."""
    c = dealt(spark, sf_dir, "customer")
    value = F.concat(F.lit("k"), F.repeat(F.md5("c_name"), (F.col("c_custkey") % 400 + 1).cast("int")))
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("password="), value, F.lit(" end"))).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("Bearer "), value, F.lit(" end"))
    ).otherwise(F.concat(F.lit("mysql://root:"), value, F.lit("@db.example.org end")))
    return T.mask(c.select("c_custkey", text.alias("text")), KEY)


def colliding_placeholders(spark, sf_dir):
    """Addresses of all customers under suffixes of few letters, so that many collide: masked and restored again, whole."""
    c = dealt(spark, sf_dir, "customer")
    docs = c.select((F.col("c_custkey") % 7).alias("id"), F.concat(F.lit("to c"), "c_custkey", F.lit("@shop.example and c"), F.col("c_custkey") % 50, F.lit("@shop.example.")).alias("text"))
    known = T.mapping(T.found_values(docs, "text", ["EMAIL"]), KEY, size=4, longest=T.SIZE)
    masked = T.mask(docs, KEY, labels=["EMAIL"], known=known, size=4)
    lost = known.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).first()[0]
    back = T.restore(masked, known, size=4)
    return back.groupBy("id").agg(F.count("*").alias("texts"), F.min("text").alias("first"), F.max("text").alias("last"), F.lit(lost).cast("long").alias("shared"))


def custom_words(spark, sf_dir):
    """Names of nations as a dictionary: each spelling of a name has the same placeholder, and a longer name wins over its beginning."""
    names = [r[0] for r in load(spark, sf_dir, "nation").select("n_name").distinct().collect()]  # the table of nations is fixed
    rule = W.rule("NATION", [(n, False) for n in names])
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = c.select("c_custkey", F.concat(F.lit("From "), "n_name", F.lit(" to "), F.lower("n_name"), F.lit(", all.")).alias("text"))
    return T.mask(docs, KEY, labels=[rule, "EMAIL"])


def action_texts(spark, sf_dir):
    """mask and block replace, warn leaves the text as it is."""
    c = dealt(spark, sf_dir, "customer", SHORT_ROWS)
    docs = c.select("c_custkey", F.concat(F.lit("mail c"), "c_custkey", F.lit("@a.example, tel "), _phone(F.col("c_custkey")), F.lit("; token=ab"), F.md5("c_name")).alias("text"))
    return T.mask(docs, KEY, actions={"PHONE": "warn", "SECRET": "block", "EMAIL": "other"})


def full_width_phones(spark, sf_dir):
    """Phone numbers in full width with an invisible character among them: found by the view, replaced in the original."""
    c = dealt(spark, sf_dir, "customer")
    wide = F.translate(_phone(F.col("c_custkey")), "0123456789", "０１２３４５６７８９")
    hidden = F.concat(F.substring(wide, 1, 3), F.lit("​"), F.substring(wide, 4, 8))
    docs = c.select("c_custkey", F.concat(F.lit("tél "), hidden, F.lit(" fin")).alias("text"))
    spans = N.detect(F.col("text"), ["PHONE"])
    return docs.select(
        "c_custkey", F.size(spans).alias("found"), F.coalesce(F.get(spans, F.lit(0))["start"], F.lit(-1)).alias("start"), F.coalesce(F.get(spans, F.lit(0))["stop"], F.lit(-1)).alias("stop"),
        N.replaced(F.col("text"), lambda s: F.lit("*"), ["PHONE"]).alias("masked"),
    )


def forward_values(spark, sf_dir):
    """Names confirmed once (of customers of even number) are replaced wherever they stand between word edges."""
    c = dealt(spark, sf_dir, "customer")
    known = T.mapping(c.where("c_custkey % 2 = 0").select(F.lit("NAME").alias("label"), F.col("c_name").alias("value")), KEY)
    docs = c.select("c_custkey", F.concat(F.lit("ask "), "c_name", F.lit(", not "), "c_name", F.lit("x")).alias("text"))
    return T.forward(docs, known)


def forward_in_runs(spark, sf_dir):
    """Customers' keys in Chinese numerals inside a run of Chinese characters; those of even number are known."""
    c = dealt(spark, sf_dir, "customer")
    han = F.translate(_pad(F.col("c_custkey"), 9), "0123456789", _NUMERALS)
    known = T.mapping(c.where("c_custkey % 2 = 0").select(F.lit("NAME").alias("label"), han.alias("value")), KEY)
    docs = c.select("c_custkey", F.concat(F.lit("客户"), han, F.lit("今天来了,"), han, F.lit("x")).alias("text"))
    return T.forward(docs, known)


_NOISE, _FIRST, _GIVEN, _SECOND = "方法正确，文字很好；程序一般。", "王李张刘陈杨赵黄", "伟芳娜敏静丽强磊洋艳", "军杰娟涛明超兰霞平刚"


def zh_names(spark, sf_dir):
    """A name with evidence before every document, among ordinary words that begin with a surname, some of them next to evidence too."""
    d = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    pick = lambda chars, n: F.substr(F.lit(chars), (n % len(chars) + 1).cast("int"), F.lit(1))
    i = F.col("doc_id")
    name = F.concat(pick(_FIRST, i), pick(_GIVEN, i), F.when(i % 2 == 0, pick(_SECOND, F.floor(i / 10))).otherwise(""))
    frame = F.when(i % 3 == 0, F.concat(F.lit("请联系"), name, F.lit("。"))).when(i % 3 == 1, F.concat(name, F.lit("先生来电。"))).otherwise(F.concat(F.lit("负责人:"), name, F.lit("。")))
    text = F.concat(F.lit(_NOISE), F.when(i % 5 == 0, "客户方法，").otherwise(""), frame, F.coalesce("text", F.lit("")))
    docs = d.select("doc_id", text.alias("text"))
    return Z.names(docs, Z.counter_examples(docs)).select("doc_id", "start", "value")


def unrestored_values(spark, sf_dir):
    """Addresses in answers that no mapping of the requests accounts for."""
    c = load(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 = 0").select(F.lit("EMAIL").alias("label"), F.concat(F.lit("c"), "c_custkey", F.lit("@a.example")).alias("value"))
    docs = c.select("c_custkey", F.concat(F.lit("see c"), "c_custkey", F.lit("@a.example now")).alias("text"))
    return T.unrestored(docs, known, "c_custkey", labels=["EMAIL"])


def masked_bodies(spark, sf_dir):
    """Bodies of requests with an address in one message, in a tool's input and in a protocol field: only the literals of the first two change."""
    c = dealt(spark, sf_dir, "customer", SHORT_ROWS)
    mail = F.concat(F.lit("c"), "c_custkey", F.lit("@a.example"))
    body = F.concat(
        F.lit('{ "model" : "m-'), mail, F.lit('",  "messages":[{"role":"user","content":"say \\"hi\\" to '), mail, F.lit('\\n"},{"type":"tool_use","input":{"name": "'), mail, F.lit('"}}], "n": '), F.col("c_custkey"), F.lit(".50 }")
    )
    out = c.select("c_custkey", J.rewritten(body, lambda v: D.replaced(v, lambda x: T.token(x["label"], x["value"], KEY), ["EMAIL"])).alias("r"))
    return out.select("c_custkey", "r.changed", "r.body")


def _zoned(mail):
    """Six forms of bodies around an address: a definition, repeated keys, a carrier, too deep, no JSON, a bare string."""
    lit = F.lit
    return [
        F.concat(lit('{"tools":[{"name":"'), mail, lit('","description":"to '), mail, lit('"}]}')), F.concat(lit('{"a":"x","a":"'), mail, lit('"}')),
        F.concat(lit('{"content":[{"role":"assistant","type":"thinking","signature":"'), mail, lit('"}]}')), F.concat(lit("[" * 26 + '"'), mail, lit('"' + "]" * 26)),
        F.concat(lit("ask "), mail, lit(" {")), F.concat(lit('"'), mail, lit('"')),
    ]


def body_zones(spark, sf_dir):
    """Which leaves of a body are masked: natural-language fields of definitions, both of two equal keys, no carrier's content; what cannot be walked as a whole."""
    c = dealt(spark, sf_dir, "customer")
    forms = _zoned(F.concat(F.lit("c"), "c_custkey", F.lit("@a.example")))
    body = F.coalesce(*[F.when(F.col("c_custkey") % 6 == i, f) for i, f in enumerate(forms)])
    out = c.select("c_custkey", J.rewritten(body, lambda v: D.replaced(v, lambda x: T.token(x["label"], x["value"], KEY), ["EMAIL"])).alias("r"))
    return out.select("c_custkey", "r.body", "r.changed", "r.exempt", "r.repeated")


def masked_conversations(spark, sf_dir):
    """Conversations as JSON bodies, masked leaf by leaf: their texts are those that masking the turns gives."""
    from .documents import _bodies

    masked = _bodies(spark, sf_dir).select("conv_id", J.rewritten(F.col("body"), lambda v: D.replaced(v, lambda x: T.token(x["label"], x["value"], KEY), Q.LABELS)).alias("r"))
    texts = F.from_json("r.body", "messages array<struct<content:struct<text:string>>>")["messages"]
    return masked.select("conv_id", F.size(texts).alias("messages"), F.sha2(F.array_join(F.transform(texts, lambda m: m["content"]["text"]), "\n"), 256).alias("texts_sha256"))


def export_records(spark, sf_dir):
    """What a log keeps of each finding: of credentials never the value."""
    c = dealt(spark, sf_dir, "customer")
    text = F.concat(F.lit("c"), "c_custkey", F.lit("@a.example token=x1"), F.md5("c_name"))
    rec = c.select("c_custkey", F.posexplode(T.records(D.detect(text, ["EMAIL", "SECRET"]))).alias("n", "r"))
    return rec.select("c_custkey", "n", "r.label", "r.preview", "r.digest", "r.original")


def tolerant_restore(spark, sf_dir):
    """Placeholders damaged in eight ways, by customer: all but a changed label and an unknown suffix come back."""
    c = load(spark, sf_dir, "customer")
    mail = F.concat(F.lit("c"), "c_custkey", F.lit("@a.example"))
    values = c.select("c_custkey", F.lit("EMAIL").alias("label"), mail.alias("value"))
    known = T.mapping(values, KEY)
    s = F.regexp_extract("token", r"_([a-z]{6})", 1)
    forms = [
        F.col("token"), F.concat(F.lit("\\{\\{EMAIL_"), s, F.lit("\\}\\}")), F.concat(F.lit("{{ EMAIL_"), s, F.lit(" }}")), F.concat(F.lit("{EMAIL_"), s, F.lit("}")),
        F.concat(F.lit("EMAIL_"), s), F.concat(F.lit("%7B%7BEMAIL_"), s, F.lit("%7D%7D")), F.concat(F.lit("{{OTHER_"), s, F.lit("}}")), F.lit("{{EMAIL_zzzzzz}}"),
    ]
    damaged = F.get(F.array(*forms), (F.col("c_custkey") % 8).cast("int"))
    docs = values.join(known.select("value", "token"), "value").select("c_custkey", F.concat(F.lit("<"), damaged, F.lit(">")).alias("text"))
    back = T.restore(docs, known, tolerant=True)
    return back.select("c_custkey", F.col("text").contains("@").alias("restored"), F.when(F.col("text").contains("@"), F.col("text")).alias("text"))


def validators_more(spark, sf_dir):
    """Validators of shapes that the tables do not hold, over values made of customer numbers."""
    k = F.col("c_custkey")
    mac = F.concat_ws(":", *[F.lower(F.lpad(F.hex((k * m) % 256), 2, "0")) for m in (1, 3, 5, 7, 11, 13)])
    mixed = F.when(k % 4 == 0, F.replace(mac, F.lit(":"), F.lit("-"))).when(k % 4 == 1, F.concat(F.substring(mac, 1, 14), F.lit("-"), F.substring(mac, 16, 2))).otherwise(mac)
    plate = F.concat(F.lit("京A"), F.when(k % 3 == 0, F.lit("BCDEF")).otherwise(F.concat(F.lit("B"), _pad(k % 10000, 4))))
    hkid = F.concat(F.lit("H"), F.when(k % 5 == 0, _pad(k % 10**7, 7)).otherwise(_pad(k % 10**8, 8)))
    line = F.concat(F.lit("0"), (10 + k % 90).cast("string"), F.when(k % 2 == 0, F.lit("-")).otherwise(F.lit("")), ((k % 9) + 1).cast("string"), _pad(k % 10**7, 7))
    six = F.concat(F.when(k % 3 == 0, F.lit("fe80")).when(k % 3 == 1, F.lit("fd12")).otherwise(F.lit("2001")), F.lit("::"), F.lower(F.hex(k + 1)))
    flags = {"mac": V.mac_ok(mixed), "plate": V.plate_ok(plate), "hkid": V.hkid_ok(hkid), "landline": V.landline_ok(line), "ipv6": V.ipv6_private_ok(six)}
    return dealt(spark, sf_dir, "customer").select("c_custkey", *[f.alias(n) for n, f in flags.items()])


def jwt_headers(spark, sf_dir):
    """Tokens of three parts count only if the first decodes to JSON with an algorithm."""
    c = dealt(spark, sf_dir, "customer")
    head = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"alg":"HS256","k":'), "c_custkey", F.lit("}"))).otherwise(F.concat(F.lit('{"typ":"none","k":'), "c_custkey", F.lit("}")))
    part = F.regexp_replace(F.translate(F.base64(F.encode(head, "utf-8")), "+/", "-_"), "=+$", "")
    text = F.concat(F.lit("t "), part, F.lit(".eyJzdWIiOjF9."), F.md5("c_name"))
    return c.select("c_custkey", F.size(D.detect(text, ["JWT"])).alias("found"))


def digit_runs(spark, sf_dir):
    """Runs of digits without separators that hold a mobile number at some place."""
    c = dealt(spark, sf_dir, "customer")
    run = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("999")).otherwise(F.lit("")), F.when(F.col("c_custkey") % 3 == 0, F.lit("00000000000")).otherwise(_phone(F.col("c_custkey"))))
    return c.select("c_custkey", E.masked_run(run).alias("masked"))


def entity_windows(spark, sf_dir):
    """Windows and segments of texts for a tagger: Han prose of different lengths made of document numbers."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    text = F.repeat(F.lit("王小明住在北京市。"), (F.col("n_chars") % 700 + 1).cast("int"))
    out = d.select("doc_id", text.alias("t"))
    parts = E.segments(F.col("t"), 4000, 64)
    w = E.windows(F.col("t"))
    return out.select("doc_id", F.size(w).alias("windows"), F.size(parts).alias("segments"), (F.array_join(parts, "") == F.col("t")).alias("whole"), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).alias("longest"))


def env_entries(spark, sf_dir):
    """.env texts made of customers: the last of equal keys wins, and what was skipped says why."""
    c = dealt(spark, sf_dir, "customer", SHORT_ROWS, by="c_custkey")
    k = F.col("c_custkey").cast("string")
    lines = [F.concat(F.lit("export API_KEY="), F.md5("c_name")), F.concat(F.lit("NAME='"), F.col("c_name"), F.lit("' # c")), F.lit("# none"), F.lit("EMPTY="), F.concat(F.lit("A="), k), F.concat(F.lit('A="x '), k, F.lit('"')), F.lit("no key here")]
    out = S.dot_env(c.select("c_custkey", F.concat_ws("\n", *lines).alias("text")), "c_custkey")
    return out.withColumn("label", S.env_label(F.col("key"), F.col("value")))


def price_lists(spark, sf_dir):
    """Price lists of both shapes made of parts: only positive finite prices, per million tokens."""
    p = load(spark, sf_dir, "part")
    name = F.concat(F.lit("v/m"), "p_partkey")
    listed = F.concat(F.lit('{"data":[{"id":"'), name, F.lit('","pricing":{"prompt":"'), (F.col("p_size") / 1e6).cast("string"), F.lit('","completion":"'), F.when(F.col("p_partkey") % 5 == 0, F.lit("-1")).otherwise(F.lit("0.000002")), F.lit('"}}]}'))
    plain = F.concat(F.lit('{"'), name, F.lit('":{"input":'), F.col("p_size").cast("string"), F.lit(',"output":'), F.when(F.col("p_partkey") % 7 == 0, F.lit("0")).otherwise(F.lit("3.5")), F.lit("}}"))
    return S.price_list(p.select(F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(plain).alias("value")))


QUERIES = {
    f.__name__: f
    for f in (
        long_secrets, colliding_placeholders, custom_words, action_texts, full_width_phones, forward_values, forward_in_runs, zh_names, unrestored_values, masked_bodies, body_zones, masked_conversations, export_records,
        tolerant_restore, validators_more, jwt_headers, digit_runs, entity_windows, env_entries, price_lists,
    )
}

_PHONE_SQL = "'13' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0')"
_EMAIL = lambda v: Q.token("'EMAIL'", v, KEY)
_MAIL = "('c' || c_custkey || '@a.example')"
_FORMS = " ".join(f"WHEN {i} THEN {i < 6}" for i in range(8))
from .detection import _MASKED  # noqa: E402

_CONV = _MASKED.replace("doc_id", "rid").replace("FROM documents)", "FROM conv)")

ORACLE_SQL = {
    "long_secrets": f"""WITH v AS (SELECT c_custkey, 'k' || repeat(md5(c_name), (c_custkey % 400 + 1)::INTEGER) AS v FROM customer)
        SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'password=' || {Q.token("'SECRET'", 'v', KEY)} || ' end' WHEN 1 THEN 'Bearer ' || {Q.token("'TOKEN'", 'v', KEY)} || ' end'
          ELSE 'mysql://root:' || {Q.token("'CONNSTR'", 'v', KEY)} || '@db.example.org end' END AS text FROM v""",
    "colliding_placeholders": """WITH t AS (SELECT c_custkey % 7 AS id, 'to c' || c_custkey || '@shop.example and c' || (c_custkey % 50) || '@shop.example.' AS text FROM customer)
        SELECT id, count(*) AS texts, min(text) AS first, max(text) AS last, 0::BIGINT AS shared FROM t GROUP BY id""",
    "custom_words": f"""SELECT c_custkey, 'From ' || {Q.token("'NATION'", 'lower(n_name)', KEY)} || ' to ' || {Q.token("'NATION'", 'lower(n_name)', KEY)} || ', all.' AS text
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "action_texts": f"""SELECT c_custkey, 'mail ' || {_EMAIL("('c' || c_custkey || '@a.example')")} || ', tel ' || {_PHONE_SQL} || '; token=' || {Q.token("'SECRET'", "('ab' || md5(c_name))", KEY)} AS text FROM customer""",
    "full_width_phones": f"""WITH p AS (SELECT c_custkey, {_PHONE_SQL} AS p FROM customer),
        q AS (SELECT *, translate(p, '0123456789', '０１２３４５６７８９') AS w, len(list_distinct(string_split(p, ''))) > 1 AND regexp_matches(p, '^1[3-9]') AS ok FROM p)
        SELECT c_custkey, ok::INTEGER AS found, CASE WHEN ok THEN 4 ELSE -1 END AS start, CASE WHEN ok THEN 16 ELSE -1 END AS stop,
          'tél ' || CASE WHEN ok THEN '*' ELSE substr(w, 1, 3) || chr(8203) || substr(w, 4, 8) END || ' fin' AS masked FROM q""",
    "forward_values": f"""WITH RECURSIVE v AS (SELECT DISTINCT 'NAME' AS label, c_name AS value FROM customer WHERE c_custkey % 2 = 0), {Q.mapping('v', KEY)}
        SELECT c_custkey, 'ask ' || coalesce(token, c_name) || ', not ' || c_name || 'x' AS text FROM customer LEFT JOIN known ON value = c_name""",
    "forward_in_runs": f"""WITH RECURSIVE h AS (SELECT c_custkey, translate(lpad(c_custkey::VARCHAR, 9, '0'), '0123456789', '{_NUMERALS}') AS han FROM customer),
        v AS (SELECT DISTINCT 'NAME' AS label, han AS value FROM h WHERE c_custkey % 2 = 0), {Q.mapping('v', KEY)}
        SELECT c_custkey, '客户' || coalesce(token, han) || '今天来了,' || coalesce(token, han) || 'x' AS text FROM h LEFT JOIN known ON value = han""",
    "zh_names": f"""SELECT doc_id, ({len(_NOISE)} + CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 0 END + CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 4 END)::INTEGER AS start,
  substr('{_FIRST}', doc_id % 8 + 1, 1) || substr('{_GIVEN}', doc_id % 10 + 1, 1) || CASE WHEN doc_id % 2 = 0 THEN substr('{_SECOND}', doc_id // 10 % 10 + 1, 1) ELSE '' END AS value
  FROM documents WHERE doc_id IS NOT NULL""",
    "body_zones": f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '{{"tools":[{{"name":"' || m || '","description":"to ' || t || '"}}]}}' WHEN 1 THEN '{{"a":"x","a":"' || t || '"}}'
    WHEN 2 THEN '{{"content":[{{"role":"assistant","type":"thinking","signature":"' || m || '"}}]}}' WHEN 3 THEN repeat('[', 26) || '"' || t || '"' || repeat(']', 26)
    WHEN 4 THEN 'ask ' || t || ' {{' ELSE '"' || t || '"' END AS body, CASE WHEN c_custkey % 6 IN (3, 4) THEN NULL WHEN c_custkey % 6 = 2 THEN 0 ELSE 1 END::INTEGER AS changed,
    CASE WHEN c_custkey % 6 IN (3, 4) THEN NULL WHEN c_custkey % 6 = 2 THEN 1 ELSE 0 END::INTEGER AS exempt, CASE WHEN c_custkey % 6 IN (3, 4) THEN NULL WHEN c_custkey % 6 = 1 THEN 2 ELSE 0 END::INTEGER AS repeated
  FROM (SELECT c_custkey, m, {Q.token("'EMAIL'", 'm', KEY)} AS t FROM (SELECT c_custkey, 'c' || c_custkey || '@a.example' AS m FROM customer))""",
    "unrestored_values": f"SELECT c_custkey, 'EMAIL' AS label, {_MAIL} AS value FROM customer WHERE c_custkey % 3 <> 0",
    "masked_bodies": f"""SELECT c_custkey, 2::INTEGER AS changed, '{{ "model" : "m-' || {_MAIL} || '",  "messages":[{{"role":"user","content":"say \\"hi\\" to ' || {_EMAIL(_MAIL)} || '\\n"}},{{"type":"tool_use","input":{{"name": "'
        || {_EMAIL(_MAIL)} || '"}}}}], "n": ' || c_custkey || '.50 }}' AS body FROM customer""",
    "masked_conversations": f"""WITH conv AS (SELECT row_number() OVER () AS rid, conv_id, turn, text FROM conversations WHERE text IS NOT NULL), {_CONV}
        SELECT conv_id, count(*)::INTEGER AS messages, sha256(string_agg(m.text, chr(10) ORDER BY turn)) AS texts_sha256 FROM conv JOIN masked m USING (rid) GROUP BY conv_id""",
    "export_records": f"""SELECT c_custkey, 0::INTEGER AS n, 'EMAIL' AS label, '<EMAIL ' || length({_MAIL}) || '>' AS preview, substr(sha256({_MAIL}), 1, 16) AS digest, {_MAIL} AS original FROM customer UNION ALL
        SELECT c_custkey, 1, 'SECRET', 'x1' || left(md5(c_name), 1) || '…' || right(md5(c_name), 4), substr(sha256('x1' || md5(c_name)), 1, 16), NULL FROM customer""",
    "tolerant_restore": f"""SELECT c_custkey, CASE c_custkey % 8 {_FORMS} END AS restored, CASE WHEN c_custkey % 8 < 6 THEN '<' || {_MAIL} || '>' END AS text FROM customer""",
    "validators_more": """WITH c AS (SELECT c_custkey AS k FROM customer)
        SELECT k AS c_custkey, k % 4 <> 1 AS mac, k % 3 <> 0 AS plate, k % 5 <> 0 AS hkid, k % 2 = 0 AND k % 9 + 1 >= 2 AS landline, k % 3 < 2 AND k < 65535 AS ipv6 FROM c""",
    "jwt_headers": "SELECT c_custkey, (c_custkey % 2 = 0)::INTEGER AS found FROM customer",
    "digit_runs": f"""SELECT c_custkey, c_custkey % 3 <> 0 AND len(list_distinct(string_split({_PHONE_SQL}, ''))) > 1 AS masked FROM customer""",
    "entity_windows": """WITH d AS (SELECT doc_id, 9 * (n_chars % 700 + 1) AS n FROM documents)
        SELECT doc_id, (greatest(ceil((n - 400) / 350.0), 0) + 1)::INTEGER AS windows, ceil(n / 4000.0)::INTEGER AS segments, true AS whole,
          CASE WHEN n <= 4000 THEN n ELSE greatest(3996, n - 3996) END::INTEGER AS longest FROM d""",
    "env_entries": """WITH c AS (SELECT c_custkey AS k, md5(c_name) AS h, c_name AS n FROM customer)
        SELECT k AS c_custkey, 'API_KEY' AS key, h AS value, 1::INTEGER AS line, NULL AS skip_reason, 'SECRET' AS label FROM c UNION ALL SELECT k, 'NAME', n, 2, NULL, NULL FROM c
        UNION ALL SELECT k, 'EMPTY', NULL, 4, 'empty', NULL FROM c UNION ALL SELECT k, 'A', k::VARCHAR, 5, 'overridden', NULL FROM c UNION ALL SELECT k, 'A', 'x ' || k, 6, NULL, NULL FROM c
        UNION ALL SELECT k, NULL, NULL, 7, 'no_key', NULL FROM c""",
    "price_lists": """SELECT 'v/m' || p_partkey AS name, round(p_size::DOUBLE, 6) AS input, CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 3.5 END::DOUBLE AS output FROM part
        WHERE (p_partkey % 2 = 0 AND p_partkey % 5 <> 0) OR (p_partkey % 2 = 1 AND p_partkey % 7 <> 0)""",
}
