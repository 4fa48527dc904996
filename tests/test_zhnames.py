"""Chinese names: evidence, shape, counter-examples."""

import random

import pytest
from pyspark.sql import functions as F

from quietlake.operators import zhnames as Z


@pytest.mark.parametrize("text, want", [
    ("请联系王小明。", ["王小明"]), ("客户:李娜,电话", ["李娜"]), ("欧阳修远先生和张伟女士来了", ["欧阳修远", "张伟"]), ("陈先生好", []),
    ("王小明说今天下雨", []), ("作者王小明说今天下雨", ["王小明"]), ("签名:王小明", ["王小明"]), ("签名王小明同步", []), ("方法说明", []),
    ("我叫张三的哥哥叫李四", ["张三"]), ("告诉王小明和李大同", ["王小明"]), ("", []), ("no names", []), ("联系人:", []), ("转给赵", []),
])
def test_evidence(text, want):
    assert [v for _, _, v in Z.candidates(text)] == want
    assert all(text[a:b] == v for a, b, v in Z.candidates(text))


def corpus(rng):
    """Texts with planted names, among ordinary words that begin with a surname and now and then stand by evidence."""
    words = ["方法", "文字", "高度", "程序", "时间", "常见", "金额", "任务"]
    rows = []
    for i in range(600):
        name = rng.choice("王李张刘陈杨赵黄") + "".join(rng.choice("伟芳娜敏静丽强磊洋艳勇军杰娟涛明超兰霞平刚") for _ in range(rng.randint(1, 2)))
        frame = rng.choice(["请联系{}。", "客户{}，已付款。", "{}先生来电。", "负责人:{}", "作者{}表示满意。"])
        noise = "".join(rng.choice(words) + rng.choice(["正确，", "很好。", "不同；", "一般，"]) for _ in range(8))
        decoy = f"客户{rng.choice(words)}，" if rng.random() < 0.2 else ""
        rows.append((i, noise + decoy + frame.format(name), name))
    return rows


def test_counter_examples_from_the_corpus(spark):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame(rows, "id long, text string, planted string")
    counter = Z.counter_examples(docs.select("text"))
    assert {"方法", "文字", "程序"} <= {r.word for r in counter.collect()}
    want = {(i, n) for i, _, n in rows}
    score = lambda df: (lambda got: (len(got & want) / len(got), len(got & want) / len(want)))({(r.id, r.value) for r in df.select("id", "value").collect()})
    precision, recall = score(Z.names(docs.select("id", "text"), counter))
    assert precision >= 0.99 and recall >= 0.97, (precision, recall)
    plain, _ = score(Z.names(docs.select("id", "text")))
    assert plain < precision  # without counter-examples ordinary words are taken for names


def test_frequent_names_are_no_counter_examples(spark):
    """Names that occur often, by their first half or with the form of address behind them, stay names."""
    docs = spark.createDataFrame([(i, "刘芳先生来电。" if i % 4 == 0 else "张伟军先生来电。" if i % 4 < 3 else "请联系张伟。") for i in range(120)], "id long, text string")
    counter = Z.counter_examples(docs.select("text"))
    assert counter.count() == 0 and Z.names(docs, counter).count() == 120


def test_rejects_what_other_taggers_find(spark):
    counter = spark.createDataFrame([("张开的", 30), ("方法", 25)], "word string, n long")
    found = spark.createDataFrame([(1, "张开"), (2, "方法"), (3, "张开明"), (4, "王伟")], "id int, value string")
    assert {r.id for r in Z.rejected(found, counter).collect()} == {1, 2}


def test_column_form_agrees(spark):
    rng = random.Random(3)
    texts = [rng.choice(["客户", "作者", "签名:", "联系 ", "x", "", "电话"]) + "王小明" + rng.choice(["先生", "说", "x", "", "表示", "。"]) for _ in range(60)]
    rows = [(t, t.index("王"), t.index("王") + 3, Z.evidence(t, t.index("王"), t.index("王") + 3) >= 2) for t in texts]
    df = spark.createDataFrame(rows, "t string, a int, b int, ok boolean")
    assert df.where(Z.strong_context(F.col("t"), F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_awkward(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 3), (3, "请联系王小明。" + "x" * 200_000, 4)], "start long, text string, value long").withColumnsRenamed({"start": "a", "value": "b"})
    assert [r.value for r in Z.names(docs).collect()] == ["王小明"]
    assert Z.names(docs.limit(0)).count() == 0 and Z.counter_examples(docs).count() == 0
