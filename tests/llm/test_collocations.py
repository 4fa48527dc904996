import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietlake.llm import collocations

from .helpers import awkward, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, threshold=10, top=2000):
    """The same result from (text, lang) by dictionaries."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        found = []
        for p, a in long.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in long.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in collocations.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_dictionaries(spark):
    rng = random.Random(4)
    vocab = [*"abcdefgh", "Zé", "ÄB", "new", "york", "city", "日本"]
    rows = []
    for i in range(300):
        words = [rng.choices(vocab, range(len(vocab), 0, -1))[0] for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for w in words) + rng.choice(["New York City", "", "\x0b", "?!"])
        rows.append((i, text, "s", rng.choice(["en", "en", "en", "de", None])))
    rows += [(1000 + i, "new york city hall", "s", "en") for i in range(60)] + [(2000, None, "s", "en"), (2001, "", "s", None), (None, "a b", "s", "fr")]
    for more in ({}, {"top": 7}, {"threshold": 3}):
        assert got(documents(spark, rows), **more) == plain([(r[1], r[3]) for r in rows], **more)


def test_sql_and_query_agree(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(collocations.SQL)
    df = collocations.op13_misra_gries_phrases(spark, data)
    assert df.columns == want.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in df.dtypes if t != "string"} == {"bigint"}
    rows = sorted(want.fetchall())
    assert rows and sorted(tuple(r) for r in df.collect()) == rows
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect()
    assert plain(map(tuple, docs)) == rows


def test_large_counts_stay_exact(spark):
    """The score's products pass 64 bits."""
    f = spark.createDataFrame([(10**13, 2 * 10**13, 3 * 10**13)], "a long, l long, r long")
    s = "(CAST(a AS decimal(16,0)) * CAST(a AS decimal(16,0)) * CAST(1000000 AS decimal(7,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))"
    assert f.selectExpr(s).first()[0] == 10**32 // (6 * 10**26)


def test_awkward(spark):
    assert got(empty(spark)) == [] and got(documents(spark, [(1, None), (2, ""), (3, " \t\n.,")])) == []
    rows = [(r.text, r.lang) for r in awkward(spark).collect()]
    assert got(awkward(spark), threshold=2) == plain(rows, threshold=2)
    clash = documents(spark, [(i, "big red bus") for i in range(12)]).withColumnsRenamed({"fp": "phrase", "key": "a", "n_chars": "words"})
    assert [r[2] for r in got(clash)] == ["big red bus"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 6)), max_size=60), max_size=12), st.integers(1, 9))
def test_summary_keeps_all_that_are_frequent(blocks, slack):
    total = Counter()
    mass = sum(c for b in blocks for _, c in b)
    summary = collocations.Summary(mass // 10 + slack)
    for b in blocks:
        own = Counter()
        for k, c in b:
            own[k] += c
        total.update(own)
        keys = sorted(own)
        summary.add(np.array(keys, np.uint64), np.array([own[k] for k in keys], np.int64))
    left = set(summary.survivors(10).tolist())
    assert {k for k, c in total.items() if c >= 10} <= left
    assert len(summary.keys) <= summary.capacity and summary.short < 10


def test_summaries_prune(spark):
    """With a mass of many rare n-grams the summary stays at its capacity, and the frequent one survives."""
    s = collocations.Summary(1000)
    for i in range(50):
        s.add(np.arange(i * 195, i * 195 + 195, dtype=np.uint64), np.ones(195, np.int64))
        s.add(np.array([10**6], np.uint64), np.ones(1, np.int64))
    assert 10**6 in s.survivors(10).tolist() and s.short > 0 and len(s.keys) <= 1000


def test_full_bit_array_loses_nothing(spark, monkeypatch):
    """A bit array in which every bit is set lets all n-grams into the exact count; the result is the same."""
    rows = [(i, "new york city hall and old town") for i in range(30)]
    monkeypatch.setattr(collocations, "bit_array", lambda survivors: (b"\xff" * 8192, 16))
    assert got(documents(spark, rows)) == plain([(r[1], "en") for r in rows])


def test_words_of_a_slice():
    w = collocations.Words(pa.array(["x"] * 3 + ["", None, "A b", "c.d e", "", " f"]).slice(3))
    assert [w.distinct[int(c)].as_py() for c in w.codes] == ["a", "b", "c", "d", "e", "f"]
    assert w.text.tolist() == [2, 2, 3, 3, 3, 5] and len(set(w.piece.tolist())) == 4


@pytest.mark.parametrize("kind", ["<u8", "<u4"])
def test_packing_of_numbers(kind):
    x = np.array([0, 1, 255, 2**31, 77], kind)
    assert collocations._unpacked(collocations._packed(x), kind).tolist() == x.tolist()
