import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietlake.llm import pii

from .helpers import awkward, documents, empty

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    odd = [int(c) for c in d[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found(text):
    return [(pii.KINDS[k], s, e) for k, s, e, ok in pii.base_spans(text) if ok]


@pytest.mark.parametrize("text", [
    "", "a@b.c", "@x.y a@b", "x.y@z-1.co.uk, b@c.d.", "a@b@c.d", "a@b.c@d.e", "..@a.b", "1.2.3.4.5.6.7.8.9", "1.2.3", "256.1.1.1 1.1.1.1", "1..2.3.4.5", "00001.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4", "+1 (743) 555-3824", "+49 89 123", "+1+2 345 678 901", "4465758382889437 4465758382889437",
    "é4111111111111111é", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
])
def test_base_cases(text):
    assert found(text) == brute(text)


def test_base_random():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789411.@+-() abé_%") for _ in range(rng.randint(0, 60)))
        assert found(text) == brute(text), text


def test_linear_on_long_runs():
    import time

    at = time.time()
    for unit in ("a", "1", "1.", "+1 ", "@", "a@", "1 "):
        pii.candidates(unit * 200_000)
    assert time.time() - at < 60


def test_reliabilities_find_the_good_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    good = np.where(rng.random(4000) < 0.95, truth, ~truth) * 2
    weak = np.where(rng.random(4000) < 0.65, truth, ~truth) * 2
    third = np.where(rng.random(4000) < 0.8, truth, ~truth) * 2
    votes, counts = np.unique(np.stack([good, weak, third], 1), axis=0, return_counts=True)
    table, post, prior = pii.reliabilities(votes, counts.astype(float))
    assert table[1, 0, 2] > table[1, 2, 2] > table[1, 1, 2]
    assert abs(prior - 0.4) < 0.1


def test_extra_spans(spark):
    rows = [(i, f'some words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" more and mail a{i}@b.org') for i in range(30)]
    # enough evidence on cards for the reliabilities: valid ones and runs that fail the check
    rows += [(200 + i, f"number {4111111111111111 if i % 2 else 4111111111111110 + 2 * (i % 3)} here") for i in range(40)]
    rows += [(100, "call (743) 555-3824 now"), (101, "nothing 12 here"), (102, "cards 4111111111111111 4111111111111111 end")]
    out = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    kinds = lambda d: {pii.KINDS[s.kind] for s in out[d].spans}
    assert all(kinds(i) == {"email", "secret"} for i in range(30))
    assert "card" in kinds(102) and not out[102].base and not out[101].spans


def test_whole_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = pii.op7_weak_supervision_pii(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b for k, _, _ in want) for b, _ in BASE]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_redaction(spark):
    df = documents(spark, [(1, "é x@y.org and 1.2.3.4, end"), (2, "none"), (3, None)])
    out = pii.find(df, keep=["doc_id", "text", "key"])
    got = {r.doc_id: r.t for r in out.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [EMAIL] and [IP], end", 2: "none", 3: None}


def test_awkward_rows(spark):
    assert len(pii.find(awkward(spark)).collect()) == 9
    assert pii.find(empty(spark)).count() == 0


def test_overlapping_spans_are_redacted_to_their_union(spark):
    texts = ["10.0.0.5@example.com x", "192.168.0.1.bob@example.com x", "a 10.0.0.5 b me@example.com"]
    spans = [[(1, 0, 8), (0, 0, 20)], [(1, 0, 11), (0, 0, 27)], [(0, 13, 27), (1, 2, 10)]]
    df = spark.createDataFrame(list(zip(texts, spans)), "text string, spans array<struct<kind: int, start: int, stop: int>>")
    got = [r[0] for r in df.select(pii.redacted(df.text, df.spans)).collect()]
    assert got == ["[EMAIL] x", "[EMAIL] x", "a [IP] b [EMAIL]"]


@pytest.mark.parametrize("n", [256, 257, 5000])
def test_long_credentials_are_one_span(n):
    m = pii._SECRET.search(f"password = {'aB3' * n}"[: 11 + n] + " end")
    assert m.end() - m.start(3) == n
