import zlib

import numpy as np
import pytest

from quietlake.llm import language

from .helpers import awkward, documents, empty


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_held_out_accuracy(spark, data):
    out = language.op3_language_mixture(spark, data)
    rows = out.join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_documents_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    changed = docs.withColumn("text", F.when(language.held_out(), F.lit("zzz qqq")).otherwise(F.col("text"))).withColumn("source", F.lit("other"))
    a, b = language.train(docs), language.train(changed)
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_mixture_of_two(docs):
    model = language.train(docs)
    one = {r.lang: r.text for r in docs.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    theta = language.mixture(model[1], language.trigram_cells(one["en"][:1500] + " " + one["de"][:1500]))
    named = dict(zip(model[0], theta))
    assert named["en"] > 0.25 and named["de"] > 0.25 and named["fr"] + named["es"] < 0.1
    assert abs(sum(theta) - 1) < 1e-9


def test_em_reaches_the_best_proportions():
    """Two languages: the fitted proportion maximises the likelihood over a fine grid."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 2)
    c = rng.multinomial(5000, 0.3 * p[0] + 0.7 * p[1]).astype(float)
    theta, ll = language._fit(p, c, np.array([0.5, 0.5]), 500)
    grid = [(np.log(x * p[0] + (1 - x) * p[1]) @ c, x) for x in np.linspace(0.01, 0.99, 99)]
    assert abs(theta[0] - max(grid)[1]) < 0.02


def test_awkward_rows(spark, docs):
    model = language.train(docs)
    got = language.predict(awkward(spark), model, keep=["doc_id", "text", "key"]).collect()
    assert len(got) == 9
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert language.predict(documents(spark, [(1, "123 ### !!")]), model).first().lang_pred == "und"
    assert language.predict(empty(spark), model).count() == 0


def test_nothing_learned(spark):
    model = language.train(empty(spark))
    assert model[0] == []
    assert language.predict(documents(spark, [(1, "some words")]), model).first().lang_pred == "und"


def test_predictions_against_a_plain_version(spark, data):
    """Trigram counts, EM and elimination written out again with dictionaries, for documents of the table."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(120).cache()
    langs, log_p = language.train(docs)
    rows = {r.doc_id: r for r in language.predict(docs, (langs, log_p)).collect()}
    log_p = log_p.astype("float32").astype(float)

    def likelihood(theta, cells):
        return sum(n * math.log(sum(w * math.exp(log_p[k][c]) for k, w in theta.items())) for c, n in cells.items())

    def em(theta, cells, rounds):
        total = sum(cells.values())
        for _ in range(rounds):
            new = dict.fromkeys(theta, 0.0)
            for c, n in cells.items():
                each = {k: w * math.exp(log_p[k][c]) for k, w in theta.items()}
                z = sum(each.values())
                for k in each:
                    new[k] += n * each[k] / z / total
            done = max(abs(new[k] - theta[k]) for k in theta) < 1e-3
            theta = new
            if done:
                break
        return theta

    for r in docs.collect():
        got = rows[r.doc_id]
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got.lang_pred == "und"
            continue
        cells = Counter(language.trigram_cells(r.text).tolist())
        price = language.PENALTY * math.log(sum(cells.values()) + 1)
        single = {k: sum(n * log_p[k][c] for c, n in cells.items()) for k in range(len(langs))}
        best = max(single, key=lambda k: (single[k], -k))
        theta = em(dict.fromkeys(range(len(langs)), 1 / len(langs)), cells, language.ROUNDS)
        ll = likelihood(theta, cells)
        if ll - single[best] <= price:
            theta = {best: 1.0}
        else:
            while len(theta) > 1:
                weakest = min(theta, key=lambda k: (theta[k], k))
                rest = {k: w for k, w in theta.items() if k != weakest}
                size = sum(rest.values())
                rest = em({k: w / size for k, w in rest.items()}, cells, language.ROUNDS) if len(rest) > 1 else dict.fromkeys(rest, 1.0)
                less = likelihood(rest, cells)
                if ll - less > price:
                    break
                theta, ll = rest, less
        top = max(theta, key=lambda k: (theta[k], -k))
        assert (got.lang_pred, sorted(got.languages)) == (langs[top], sorted(langs[k] for k in theta))
        assert abs(got.score - theta[top] / sum(theta.values())) < 1e-3


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.train(documents(spark, [(i, "some text here", "s", f"l{i}") for i in range(9)]))
