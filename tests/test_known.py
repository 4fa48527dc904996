"""Known values found anywhere, against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietlake.operators import known as K
from quietlake.operators import tokens as T
from quietlake.operators.automaton import points_of


def plain(text, values):
    """Longest value first, then from the left; edges as identifiers have them."""

    def wordly(c):
        return (c.isalnum() or c == "_") and not any(lo <= ord(c) < hi for lo, hi in ((0x2E80, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00))) and ord(c) < 0x10000

    spans = []
    for v, token in values.items():
        at = text.find(v)
        while at >= 0:
            end = at + len(v)
            if not (at and wordly(text[at - 1]) and wordly(v[0])) and not (end < len(text) and wordly(text[end]) and wordly(v[-1])):
                spans.append((at, end, token))
            at = text.find(v, at + 1)
    taken, kept = np.zeros(len(text) + 1, bool), []
    for s, e, token in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if not taken[s:e].any():
            taken[s:e] = True
            kept.append((s, e, token))
    out, at = "", 0
    for s, e, token in sorted(kept):
        out, at = out + text[at:s] + token, e
    return out + text[at:]


def test_window_keys():
    rng = random.Random(1)
    text = "".join(rng.choice("ab日é") for _ in range(300))
    windows = K.Windows(points_of(text))
    for n in (1, 2, 3, 7, 8, 9, 31, 64, 299, 300, 301):
        keys = windows.keys(n)
        assert len(keys) == max(0, len(text) - n + 1)
        seen = {}
        for i, k in enumerate(keys.tolist()):
            assert seen.setdefault(text[i : i + n], k) == k
            assert int(K.Windows(points_of(text[i : i + n])).keys(n)[0]) == k
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("letters", ["ab ", "王李张 a", "ab_1 -"])
def test_against_plain_search(spark, letters):
    rng = random.Random(len(letters))
    values = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): f"<{i}>" for i in range(60)}
    values = {v: t for v, t in values.items() if v.strip()}
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(80)] + [None, "", *list(values)[:5]]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id long, text string, token string")
    got = {r.id: r.text for r in K.replaced(docs, spark.createDataFrame(list(values.items()), "value string, token string")).collect()}
    assert got == {i: None if t is None else plain(t, values) for i, t in enumerate(texts)}


def test_full_bit_array_and_no_values(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "在王小明李大同中"), (2, None)], "id long, text string")
    values = spark.createDataFrame([("王小明李", "<1>")], "value string, token string")
    monkeypatch.setattr(K, "bit_array", lambda keys: (b"\xff" * 8192, 16))
    assert {r.text for r in K.replaced(docs, values).collect()} == {"在<1>大同中", None}
    assert K.replaced(docs, values.limit(0)).count() == 2


def test_long_values_and_texts(spark):
    rng = random.Random(4)
    value = "".join(rng.choice("abc def") for _ in range(5000)).strip()
    docs = spark.createDataFrame([(1, "x " * 100_000 + value + " y")], "id long, text string")
    out = K.replaced(docs, spark.createDataFrame([(value, "<v>")], "value string, token string")).first().text
    assert out == "x " * 100_000 + "<v> y"


def test_egress_verifies_all_values(spark):
    """Beyond 200 values and 4 MiB too; the exits are there when asked for."""
    text = " ".join(f"user{i}@mail.example" for i in range(400))
    df = spark.createDataFrame([(text,)], "text string")
    assert tuple(df.select(T.egress(F.col("text")).alias("e")).first().e) == (0, None)
    assert df.select(T.egress(F.col("text"), most=200)["skipped"]).first()[0] == "too_many_values"
    assert df.select(T.egress(F.col("text"), most_bytes=100)["skipped"]).first()[0] == "too_long"


def test_values_held_inside_words(spark):
    """Values are counted by text, also in the middle of words and numbers, and however often a text repeats."""
    texts = ["call 192.168.7.77 or x192.168.7.771", "a192.168.7.77", "ann.lee@site.example", "joann.lee@site.example", "joann.lee@site.example", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    values = spark.createDataFrame([("192.168.7.77",), ("ann.lee@site.example",), ("nowhere@site.example",)], "value string")
    assert {r.value: r.n for r in K.held(docs, values).collect()} == {"192.168.7.77": 2, "ann.lee@site.example": 3}
    assert K.held(docs, values.limit(0)).count() == 0
