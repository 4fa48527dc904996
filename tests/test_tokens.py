import random

import pytest
from pyspark.sql import functions as F

from quietlake.functions import detect as D
from quietlake.operators import tokens as T
from quietlake.streaming import channels

K = "test-key"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.fixture(scope="module")
def corpus(spark, data):
    extra = docs(spark, ["mail a1@example.org and a1@example.org", "card 4111111111111111", None, "", "nothing"]).select((F.col("id") + 10**6).alias("id"), "text")
    return spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(extra)


def test_round_trip_and_idempotence(spark, corpus):
    masked = T.mask(corpus, K)
    known = T.mapping(T.found_values(corpus), K)
    back = {r.id: r.text for r in T.restore(masked, known).collect()}
    assert back == {r.id: r.text for r in corpus.collect()}
    once = {r.id: r.text for r in masked.collect()}
    assert {r.id: r.text for r in T.mask(masked, K).collect()} == once
    assert any("{{EMAIL_" in (t or "") for t in once.values())
    assert corpus.where(T.egress(F.col("text"))["leaks"] > 0).count() == 0


def test_same_value_same_token_and_key_matters(spark):
    a, b = (T.mask(docs(spark, ["x a1@example.org", "y a1@example.org"]), k).collect() for k in (K, "other"))
    assert a[0].text[2:] == a[1].text[2:] and a[0].text != b[0].text


def test_colliding_suffixes(spark, monkeypatch):
    """With two letters for an alphabet most suffixes collide; the mapping has no two alike, and masked texts come back whole, repeated ids and texts included."""
    monkeypatch.setattr(T, "ALPHABET", "bc")
    texts = [f"say a{i}@b.org and a{(i * 7) % 20}@b.org" for i in range(20)]
    df = docs(spark, texts + texts[:3]).withColumn("id", F.col("id") % 4)
    known = T.mapping(T.found_values(df), K)
    tokens = [r.token for r in known.collect()]
    assert len(set(tokens)) == len(tokens) == 20
    masked = T.mask(df, K, known=known)
    assert "@" not in "".join(r.text for r in masked.collect())
    assert sorted((r.id, r.text) for r in T.restore(masked, known).collect()) == sorted((r.id, r.text) for r in df.collect())
    with pytest.raises(ValueError):
        T.mapping(spark.createDataFrame([("EMAIL", f"a{i}@b.org") for i in range(9)], "label string, value string"), K, size=3)


def test_repeated_ids_and_ambiguous_suffixes(spark):
    known = spark.createDataFrame([("A", "x1", "{{A_bcdfgh}}"), ("A", "x2", "{{A_cdfghj}}"), ("B", "y", "{{B_dfghjk}}"), ("C", "z", "{{C_dfghjk}}")], "label string, value string, token string")
    df = spark.createDataFrame([(1, "q {{A_cdfghj}}"), (1, "r {{A_bcdfgh}} w"), (1, "{{B_dfghjk}} {{C_dfghjk}}")], "id long, text string")
    assert sorted(r.text for r in T.restore(df, known).collect()) == sorted(["q x2", "r x1 w", "{{B_dfghjk}} {{C_dfghjk}}"])


def test_json_restore(spark):
    known = spark.createDataFrame([("A", 'a"b\\c\n', "{{A_bcdfgh}}")], "label string, value string, token string")
    import json

    got = T.restore(docs(spark, ['{"k": "v {{A_bcdfgh}}"}']), known, in_json=True).first().text
    assert json.loads(got) == {"k": 'v a"b\\c\n'}


def test_actions_and_custom_words(spark):
    from quietlake.operators.dictionary import rule

    own = rule("PROJECT", [("Blue Heron", False), ("ox", True)])
    df = docs(spark, ["BLUE heron met blue heron, ox, oxen and me@x.org 13812345678"])
    masked = T.mask(df, K, labels=[own, "EMAIL", "PHONE"], actions={"PHONE": "warn"}).first().text
    first, second = masked.split(" met ")[0], masked.split(" met ")[1].split(",")[0]
    assert first == second and first.startswith("{{PROJECT_") and "oxen" in masked and " ox," not in masked and "{{EMAIL_" in masked and "13812345678" in masked


def test_forward(spark):
    known = spark.createDataFrame([("NAME", "Ana Maria Lund", "{{NAME_bcdfgh}}"), ("NAME", "Ana Maria", "{{NAME_cdfghj}}"), ("X", "short", "{{X_dfghjk}}")], "label string, value string, token string")
    got = T.forward(docs(spark, ["Ana Maria Lund, Ana Maria; Ana Marias short", None, "none"]), known).orderBy("id").collect()
    assert [r.text for r in got] == ["{{NAME_bcdfgh}}, {{NAME_cdfghj}}; Ana Marias short", None, "none"]


def test_egress_and_records(spark):
    df = docs(spark, ["mail ab@x.org then xab@x.orgy", "ok cd@x.org", None])
    rows = df.orderBy("id").select(T.egress(F.col("text")).alias("e")).collect()
    assert [(r.e.leaks, r.e.skipped) for r in rows] == [(0, None)] * 3
    many = docs(spark, [" ".join(f"a{i}@x.org" for i in range(5))])
    assert many.select(T.egress(F.col("text"), most=4)["skipped"]).first()[0] == "too_many_values"
    spans = docs(spark, ["ab@x.org password=abc12345678"]).select(T.records(D.detect(F.col("text"))).alias("r"), T.records(D.detect(F.col("text")), export=True).alias("e")).first()
    assert [x.original for x in spans.r] == ["ab@x.org", None] and [x.original for x in spans.e] == [None, None]


def test_unrestored_and_renewed(spark):
    known = spark.createDataFrame([("EMAIL", "ab@x.org")], "label string, value string")
    assert [r.value for r in T.unrestored(docs(spark, ["ab@x.org cd@x.org"]), known, "id").collect()] == ["cd@x.org"]
    t = lambda s: F.timestamp_seconds(F.lit(s))
    m = spark.createDataFrame([("a", 0), ("b", 50), ("c", 90)], "token string, s long").select("token", F.timestamp_seconds("s").alias("last_seen"))
    used = spark.createDataFrame([("a", 95), ("a", 40)], "token string, s long").select("token", F.timestamp_seconds("s").alias("ts"))
    assert {r.token for r in T.renewed(m, used, t(100), ttl=20).collect()} == {"a", "c"}
    assert {r.token for r in T.renewed(m, used, t(100), ttl=99, capacity=2).collect()} == {"a", "c"}


def test_tolerant_restore(spark):
    known = spark.createDataFrame([("EMAIL", "v@w.org", "{{EMAIL_bcdfgh}}")], "label string, value string, token string")
    texts = ["{{EMAIL_bcdfgh}}", r"\{\{EMAIL_bcdfgh\}\}", "{{ EMAIL_bcdfgh }}", "{EMAIL_bcdfgh}", "EMAIL_bcdfgh", "%7B%7BEMAIL_bcdfgh%7D%7D", "{{email_bcdfgh}}", "{{OTHER_bcdfgh}}", "{{EMAIL_zzzzzz}}"]
    got = [r.text for r in T.restore(docs(spark, texts), known, tolerant=True).orderBy("id").collect()]
    assert got[:7] == ["v@w.org"] * 7 and got[7:] == texts[7:]
    strict = [r.text for r in T.restore(docs(spark, texts), known).orderBy("id").collect()]
    assert strict == ["v@w.org", *texts[1:]]


def test_accounting(spark):
    known = spark.createDataFrame([("E", "v", "{{E_bcdfgh}}")], "label string, value string, token string")
    issued = spark.createDataFrame([("{{E_bcdfgh}}",), ("{{E_cccccc}}",)], "token string")
    r = T.accounting(docs(spark, ["{{E_bcdfgh}} {{E_bcdfgh}} {{E_cccccc}} {{E_dddddd}}"]), known, issued, "id").first()
    assert (r.restored, r.degraded, r.unresolved, r.foreign) == (2, 0, 1, 1)
    r = T.accounting(docs(spark, [r"\{\{E_bcdfgh\}\} {{X_bcdfgh}} ABC_123456 XY_zzzzzz"]), known, issued, "id").first()
    assert (r.restored, r.degraded, r.unresolved, r.foreign) == (0, 1, 1, 0)


def test_previews(spark):
    df = spark.createDataFrame([("SECRET", "abc123def456abc123def456"), ("SECRET", "short1"), ("EMAIL", "someone@example.org")], "l string, v string")
    assert [r[0] for r in df.select(T.preview(F.col("l"), F.col("v"))).collect()] == ["abc…f456", "<SECRET 6>", "<EMAIL 19>"]


def test_every_split_of_a_stream():
    token, text = "{{EMAIL_bcdfgh}}", "a {{EMAIL_bcdfgh}} b {x} {{no {{EMAIL_bcdfgh}}"
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            pending, out = "", []
            for part, final in ((text[:i], False), (text[i:j], False), (text[j:], True)):
                piece, pending = channels.release(pending, part, final)
                out.append(piece)
            assert "".join(out) == text and pending == ""
            assert sum(p.count(token) for p in out) == 2


def test_stream_restores_like_batch(spark, tmp_path):
    rng = random.Random(3)
    text = "x {{EMAIL_bcdfgh}} and {{CARD_cdfghj}} end"
    rows = []
    for sid in "ab":
        cuts = sorted(rng.sample(range(1, len(text)), 6))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(sid, "c0", n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    rng.shuffle(rows)
    schema = "sid string, channel string, seq long, delta string, final boolean"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    known = spark.createDataFrame([("EMAIL", "v@w.org", "{{EMAIL_bcdfgh}}"), ("CARD", "4111", "{{CARD_cdfghj}}")], "label string, value string, token string")
    out = str(tmp_path / "out")
    put = lambda batch, _: channels.restored_batch(batch, known).write.mode("append").parquet(out)
    q = channels.reassembled(stream).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(out).orderBy("seq").collect():
        got[r.sid] = got.get(r.sid, "") + r.text
    assert got == {"a": "x v@w.org and 4111 end", "b": "x v@w.org and 4111 end"}
    batch = channels.whole(spark.createDataFrame(rows, schema)).collect()
    assert {r.text for r in batch} == {text}


def test_more_values_than_suffixes(spark):
    """500 values for 361 suffixes of two letters: the others have longer ones, all differ and all are restored."""
    docs = spark.range(500).selectExpr("id", "concat('to c', id, '@shop.example.') AS text")
    known = T.mapping(T.found_values(docs, "text", ["EMAIL"]), "k", size=2, longest=6)
    tokens = [r.token for r in known.collect()]
    assert len(set(tokens)) == len(tokens) == 500 and {len(t) for t in tokens} > {len("{{EMAIL_bb}}")}
    masked = T.mask(docs, "k", labels=["EMAIL"], known=known, size=2)
    assert masked.where("text LIKE '%@%'").count() == 0
    back = T.restore(masked, known, size=2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
