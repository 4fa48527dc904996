"""Lists of prefixes, and mail addresses with Chinese names."""

from pyspark.sql import functions as F

from quietlake.functions import detect as D


def found(spark, texts, chosen):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [[(s.label, s.value) for s in r.s] for r in df.select("i", D.detect(F.col("t"), chosen).alias("s")).orderBy("i").collect()]


def test_valid_prefixes():
    assert D.valid_prefixes(["sk-", "ah-", "bad prefix", "bad*prefix", "ghp_", "x_", "@token-", "x_", "", "@"]) == ["sk-", "ah-", "ghp_", "x_", "@token-"]
    assert D.prefix_rules([]) == [] and D.prefix_rules(["a b"]) == []


def test_default_prefixes(spark):
    for p in D.SECRET_PREFIXES:
        assert found(spark, [f"a {p}12345678, {p.replace('-', '_')}abcd_efgh"], ["APIKEY"]) == [[("APIKEY", f"{p}12345678"), ("APIKEY", f"{p.replace('-', '_')}abcd_efgh")]]
    assert found(spark, ["sk-demo ah-test sk-abc ah-1234 task-management"], None) == [[]]


def test_own_prefixes(spark):
    texts = ["sk-123456789012 @token-12345678 zz_12345678", None, ""]
    assert found(spark, texts, D.with_prefixes(["@token-", "zz-"])) == [[("APIKEY", "@token-12345678"), ("APIKEY", "zz_12345678")], [], []]
    assert found(spark, texts, D.with_prefixes([])) == [[], [], []]
    assert [r.label for r in D.with_prefixes(["zz-"])] == [r.label for r in D.rules_for() if r.pattern != D.prefix_rules()[1].pattern]


def test_chinese_mail(spark):
    texts = ["联系张三@qq.com 或张san@example.com", "发信至 1234567890@qq.com 查收", "和平@qq.com", "代码 @Component", "ab@a.b.c.d.e.f.g.h.i.j.k.org", "x" * 3 + "张三@qq.com"]
    got = found(spark, texts, ["EMAIL"])
    assert [[v for _, v in g] for g in got] == [
        ["张三@qq.com", "张san@example.com"], ["1234567890@qq.com"], ["平@qq.com"], [], ["ab@a.b.c.d.e.f.g.h.i.j.k.org"], ["张三@qq.com"],
    ]
    masked = spark.createDataFrame([("联系张三@qq.com。",)], "t string").select(D.replaced(F.col("t"), lambda c: F.lit("<E>"), ["EMAIL"])).first()[0]
    assert masked == "联系<E>。"
