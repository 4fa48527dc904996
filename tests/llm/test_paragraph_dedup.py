import glob
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietlake.llm import paragraph_dedup as P
from quietlake.session import CLEANUP, shared_dir, written

from .helpers import awkward, documents, empty


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + str(rng.randint(0, 9999)) for _ in range(n)]


def text(rng, n):
    return " ".join(words(rng, n))


def test_tuned_bands():
    b, r = P.tuned_bands()
    assert 1 - (1 - 0.8**r) ** b >= 0.995 and b * r <= 32
    assert 1 - (1 - 0.8 ** (r + 1)) ** (32 // (r + 1)) < 0.995


def test_planted_passages(spark):
    rng = random.Random(2)
    passage, spliced = text(rng, 60), text(rng, 52)
    rows = [(i, "\n".join(text(rng, rng.randint(5, 80)) for _ in range(5))) for i in range(30)]
    rows[3] = (3, rows[3][1] + "\n" + passage)
    rows[9] = (9, passage + "\n" + rows[9][1])
    for i in (5, 12, 20):
        rows[i] = (i, text(rng, 40) + " " + spliced + " " + text(rng, 33))
    got = P.repeats(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {3, 9, 5, 12, 20}
    assert {r.doc_id for r in got if r.keep} == {3, 5}
    assert {(r.doc_id, r.class_doc) for r in got if not r.keep} == {(9, 3), (12, 5), (20, 5)}
    left = {r.doc_id: r.text for r in P.without(documents(spark, rows), P.repeats(documents(spark, rows)).where("NOT keep")).collect()}
    assert passage in left[3] and passage not in left[9] and spliced in left[5] and spliced not in left[12]
    assert left[0] == rows[0][1]


def test_similar_paragraphs(spark):
    """One changed word of 70 keeps the similarity over 0.8, seven spread ones do not."""
    rng = random.Random(3)
    base = words(rng, 70)
    near, far = list(base), list(base)
    near[35] = "changed"
    for i in range(3, 70, 8):
        far[i] = f"other{i}"
    got = P.repeats(documents(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))])).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert sum(r.words for r in got if r.doc_id == 2 and not r.keep) == 70


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


@pytest.mark.parametrize("seed", range(3))
def test_forest_connects_what_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 10**9, 40)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(0, 10**9, rng.integers(0, 4))])) for _ in range(40)]
    edges = P.forest(list(range(40)), sets)
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in edges)

    def parts(pairs):
        root = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(edges) == parts([(a, b) for a in range(40) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    assert len(edges) < 40


def test_small_blocks_give_the_same(spark):
    rng = random.Random(7)
    base = words(rng, 60)
    rows = []
    for i in range(30):
        w = list(base)
        w[(i * 2) % 60] = f"edit{i}"
        rows.append((i, " ".join(w)))
    a = {(r.doc_id, r.class_doc, r.keep, r.start, r.words) for r in P.repeats(documents(spark, rows)).collect()}
    b = {(r.doc_id, r.class_doc, r.keep, r.start, r.words) for r in P.repeats(documents(spark, rows), block=4).collect()}
    assert a == b and len({x[0] for x in a}) > 5


def test_short_common_lines_are_left_alone(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, 50) + "\nAll rights reserved by the usual owners.\n" + text(rng, 20)) for i in range(20)]
    assert P.repeats(documents(spark, rows)).count() == 0


def test_repeats_inside_one_document_do_not_count(spark):
    rng = random.Random(9)
    p = text(rng, 40)
    assert P.repeats(documents(spark, [(1, f"{p}\n{p}"), (2, text(rng, 60))])).count() == 0


def test_awkward_rows(spark):
    got = P.repeats(awkward(spark)).collect()
    assert got == []
    assert P.repeats(empty(spark)).count() == 0
    docs = awkward(spark)
    out = P.without(docs, P.repeats(docs).where("NOT keep"))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 4, 5, 6, None, 7}


def test_windows_do_not_depend_on_their_surroundings():
    rng = random.Random(1)
    inner = text(rng, 60)
    a = P.doc_units(text(rng, 37) + " " + inner + " " + text(rng, 11), 8, 3)
    b = P.doc_units(text(rng, 90) + " " + inner + " " + text(rng, 50), 8, 3)
    assert len(set(a[2].tolist()) & set(b[2].tolist())) >= 1


@pytest.mark.parametrize("n", [51, 60, 100])
def test_every_word_of_a_spliced_passage_goes(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(20):
        p = text(rng, n)
        rows += [(2 * i, f"{text(rng, 40)} {p} {text(rng, 33)}"), (2 * i + 1, f"{text(rng, 31)} {p} {text(rng, 45)}")]
    got = P.repeats(documents(spark, rows)).collect()
    assert {(r.doc_id, r.start, r.words, r.class_doc) for r in got if not r.keep} == {(2 * i + 1, 31, n, 2 * i) for i in range(20)}
    assert {(r.doc_id, r.start, r.words) for r in got if r.keep} == {(2 * i, 40, n) for i in range(20)}


def edited(rng, p, kind):
    w = list(p)
    if kind == "middle":
        w[len(w) // 2] = "changed"
    elif kind == "early":
        w[9] = "changed"
    elif kind == "dropped":
        del w[len(w) // 2]
    elif kind == "added":
        w.insert(len(w) // 3, "added")
    return w


@pytest.mark.parametrize("kind", ["middle", "early", "dropped", "added"])
def test_edited_passages_in_other_lines(spark, kind):
    """A passage of 60 words with one edit (over 0.8) goes as a whole, from within a line and from wrapped lines."""
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(20):
        p = words(rng, 60)
        q = edited(rng, p, kind)
        wrapped = "\n".join(" ".join(q[k : k + 11]) for k in range(0, len(q), 11))
        rows += [(3 * i, f"{text(rng, 40)} {' '.join(p)} {text(rng, 33)}"), (3 * i + 1, f"{text(rng, 31)} {' '.join(q)} {text(rng, 45)}"), (3 * i + 2, f"{text(rng, 12)}\n{wrapped}\n{text(rng, 9)}")]
        want |= {(3 * i + 1, 31, len(q)), (3 * i + 2, 12, len(q))}
    assert {(r.doc_id, r.start, r.words) for r in P.repeats(documents(spark, rows)).collect() if not r.keep} == want


def test_passages_that_are_not_alike_enough_stay():
    """Two edits in 60 words are under 0.8: only the runs of MIN_WORDS words go; of a shared run of 20 words nothing."""
    rng = np.random.default_rng(1)
    x = rng.integers(1 << 63, size=60, dtype=np.uint64)
    y = x.copy()
    y[[14, 40]] = 1, 2
    assert P.grow(x, y, [(15, 15), (20, 20)]) == [(15, 40, 15, 40)]
    z = np.concatenate([rng.integers(1 << 63, size=30, dtype=np.uint64), x[20:40], rng.integers(1 << 63, size=30, dtype=np.uint64)])
    assert P.grow(x, z, [(21, 31)]) == []


def test_a_shared_run_of_25_words_has_a_seed_in_common():
    rng = random.Random(5)
    for _ in range(300):
        p = text(rng, P.SEED + P.WINNOW - 1)
        a, b = (P.doc_units(f"{text(rng, rng.randint(10, 40))} {p} {text(rng, rng.randint(10, 40))}", 8, 3)[2].tolist() for _ in range(2))
        assert set(a) & set(b)


def test_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(21)
    p, q = text(rng, 60), text(rng, 60)
    rows = [(1, p + "\n" + text(rng, 30)), (1, "short"), (1, text(rng, 20) + "\n" + p), (2, q), (2, q), (2, text(rng, 90)), (None, p)]
    got = {(r.doc_id, r.words, r.class_doc, r.keep) for r in P.repeats(documents(spark, rows)).collect()}
    assert got == {(1, 60, 1, True), (1, 60, 1, False)}
    out = P.deduplicated(documents(spark, rows)).collect()
    assert len(out) == len(rows) and sum(p in r.text for r in out) == 2 and sorted(r.text for r in out if r.doc_id == 2) == sorted(t for d, t in rows if d == 2)


def test_lines_against_all_pairs(spark):
    """All lines go that all-pairs Jaccard similarity puts into a class with an earlier one."""
    rng = random.Random(31)
    heads = [words(rng, rng.randint(30, 70)) for _ in range(40)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randint(1, 3)):
            w = list(rng.choice(heads)) if rng.random() < 0.4 else words(rng, rng.randint(24, 60))
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 10**6))
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    units = [(d, i, line) for d, t in rows for i, line in enumerate(t.split("\n"))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (u[2].split() for u in units)]
    root = list(range(len(units)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(units)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    of = {}
    for i, u in enumerate(units):
        of.setdefault(find(i), []).append(u)
    want = {(d, i) for c in of.values() if len({u[0] for u in c}) > 1 for d, i, _ in sorted(c)[1:]}
    lengths = {d: [len(line.split()) for line in t.split("\n")] for d, t in rows}
    gone = {}
    for r in P.repeats(documents(spark, rows)).where("NOT keep").collect():
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.words))
    got = set()
    for d, n in lengths.items():
        at = 0
        for i, size in enumerate(n):
            if set(range(at, at + size)) <= gone.get(d, set()):
                got.add((d, i))
            at += size
    # lines of stretches that several earlier passages hold go too
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


def test_disk_is_given_back(spark):
    """The shuffle files of a written table go when it is written, its session's setting stays; of the passages' tables only those that the result reads are left."""
    files = lambda: set(glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir')}/**/shuffle_*", recursive=True))
    before, setting = files(), spark.conf.get(CLEANUP, None)
    out = written(spark.range(2000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids")).repartition(3, "k"), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 100 and spark.conf.get(CLEANUP, None) == setting
    rng = random.Random(7)
    passage = text(rng, 60)
    tables = set(os.listdir(shared_dir(spark)))
    left = P.deduplicated(documents(spark, [(1, text(rng, 40) + "\n" + passage), (2, passage + "\n" + text(rng, 40)), (3, text(rng, 50))]))
    made = {t.split("-")[1] for t in set(os.listdir(shared_dir(spark))) - tables}
    assert "removals" in made and not made & {"units", "paragraphs", "collisions", "shingles", "members"}
    assert {r.doc_id: passage in r.text for r in left.collect()} == {1: True, 2: False, 3: False}
