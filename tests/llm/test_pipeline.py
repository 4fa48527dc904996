import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quietlake.llm import paragraph_dedup, simhash
from quietlake.session import written

from .helpers import PROSE, documents, empty


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    vocabulary = PROSE.split()
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    rows = [(i, prose(120)) for i in range(20)]
    rows += [(100, rows[0][1]), (101, rows[1][1].replace(" the ", " the ", 1)), (102, "### 123 !!"), (103, None), (104, "")]
    passage = prose(60)
    rows += [(105, prose(30) + "\n" + passage), (106, passage + "\n" + prose(40) + " mail me.now@example.org")]
    return documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), passage


def test_stages(spark, docs):
    docs, passage = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, None).cache()
        assert kept.columns == docs.columns
        seen.append({r.doc_id: r.text for r in kept.collect()})
    language, near, cut, masked = seen
    assert {102, 103, 104}.isdisjoint(language) and len(language) == 24
    assert {100, 101}.isdisjoint(near) and len(near) == 22
    assert passage in cut[105] and passage not in cut[106]
    assert "[EMAIL]" in masked[106] and "example.org" not in masked[106]
    assert all(masked[i] == dict(docs.select("doc_id", "text").collect())[i] for i in range(2, 20))
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, None).collect()
    assert {r.doc_id for r in pieces} == set(masked)


def test_near_duplicates_by_fingerprint(spark):
    """Documents whose fingerprints differ in at most 4 bits are one, also below the similarity of the second step; others stay."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows = []
    while len(rows) < 6:
        a = prose(120)
        b = [f"x{i}" if i % 40 == 20 else w for i, w in enumerate(a)]
        apart = bin(simhash.fingerprint(" ".join(a), 4) ^ simhash.fingerprint(" ".join(b), 4)).count("1")
        if apart <= 4 and len(shingles(a) & shingles(b)) < 0.8 * len(shingles(a) | shingles(b)):
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    rows += [(50 + i, " ".join(prose(120))) for i in range(5)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), None)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 50, 51, 52, 53, 54]


def test_columns_with_the_operators_own_names(spark, docs):
    """All extra columns come through every stage with their values, whatever they are called."""
    names = ["score", "languages", "lang_pred", "_hash", "_cuts", "_uid", "_lo", "_h", "base", "found", "spans", "document", "key", "fp", "text_hash", "keys", "a b.c", "_text", "_0"]
    full = docs[0]
    for i, c in enumerate(names):
        full = full.withColumn(c, F.concat(F.lit(f"{i}/"), F.col("doc_id").cast("string")))
    plain, wide = docs[0], full
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, plain, None).cache(), stage(spark, wide, None).cache()
        assert wide.columns == full.columns
        rows = wide.collect()
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in plain.collect())
        assert all(r[c] == f"{i}/{r.doc_id}" for r in rows for i, c in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, wide, None).count() > 0


def test_empty_table(spark):
    kept = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, None)
    assert kept.count() == 0


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and sum(r.length for r in rows) == sum(len(r.ids) for r in rows)


@pytest.mark.parametrize("module, run", [(simhash, lambda d: simhash.similar_documents(d)), (paragraph_dedup, lambda d: paragraph_dedup.deduplicated(d))])
def test_what_is_made_of_a_row_is_not_broadcast(spark, docs, monkeypatch, module, run):
    """Band keys, blocks, pairs and texts, all of which Spark takes for less than they are, go to no driver."""
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return written(df, label)

    given = written(docs[0], "given")
    monkeypatch.setattr(module, "written", seen)
    run(given).count()
    for label in plans.keys() & {"collisions", "shingles", "similar", "removals"}:
        joins = [line for line in plans[label].splitlines() if "Join" in line and "LeftSemi" not in line]
        assert joins and all("SortMergeJoin" in line for line in joins), (label, plans[label])
    assert {"collisions", "shingles", "similar"} <= plans.keys()
