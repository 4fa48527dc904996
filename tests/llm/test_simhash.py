import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietlake.llm import simhash

from .helpers import PROSE, awkward, documents, empty


def brute_fingerprint(text, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: best[find(i)] for i, d in enumerate(ids)}


@pytest.mark.parametrize("text", [None, "", "  ", "one", "A b C d", "Ä B\tc\nD e F g", "x y z q w", "a b c d e f g h i j k l m n o p"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == brute_fingerprint(text, 4)


def test_fingerprint_matches_sparks_hash(spark):
    h = spark.sql("SELECT xxhash64('one two three four')").first()[0]
    assert simhash.fingerprint("One TWO three four", 4) == h % 2**64


def _nodes(spark, fps):
    rows = [(int(np.array([f], np.uint64).view(np.int64)[0]), i) for i, f in enumerate(fps)]
    return spark.createDataFrame(rows, "fp long, rep long")


@pytest.mark.parametrize("hot", [1000, 2])
def test_links_are_complete(spark, hot):
    """All pairs within 4 bits are connected, also through hot keys, and no others."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(120)}
    for f in list(fps)[:40]:
        for n in (1, 3, 4, 5, 6):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    got = simhash.components(simhash.links(_nodes(spark, fps), hot)).collect()
    found = {r.node: r.root for r in got}
    want = brute_components(fps, list(range(len(fps))))
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:3])]
    for i, t in enumerate(base):
        w = t.split()
        w[150] = "changed"
        rows.append((200 + i, " ".join(w)))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(documents(spark, rows), 4).collect()}
    fps = [brute_fingerprint(t, 4) for _, t in rows]
    assert [got[d][0] for d, _ in rows] == fps
    assert {d: got[d][1] for d, _ in rows} == brute_components(fps, [d for d, _ in rows])
    assert got[100][1] == 0


def test_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == 9
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in got if r.doc_id in (5, 6)] == [5, 5, 5]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star + [(5, 5)], "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and all(got[i] == 100 for i in range(101, 160))


def test_longer_keys_find_the_same(spark):
    """All key lengths give the components of brute force."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for n in (2, 3, 4, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    want = brute_components(fps, list(range(len(fps))))
    for _, sets in simhash.KEYS:
        found = {r.node: r.root for r in simhash.components(simhash.links(_nodes(spark, fps), 1000, sets)).collect()}
        assert {i: found.get(i, i) for i in range(len(fps))} == want
    assert [len(simhash.keys_for(n)) for n in (10, 1 << 23, 1 << 30)] == [2, 4, 22]


def test_a_row_without_an_id_is_a_bridge(spark, monkeypatch):
    prints = {"a": 0, "b": 0x0F, "c": 0xFF}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n: docs.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for p in prints.items() for x in p]), F.col("text")).cast("long").alias("fp")))
    got = simhash.near_duplicates(documents(spark, [(1, "a"), (None, "b"), (2, "c")])).collect()
    assert [r.component_id for r in got] == [1, 1, 1]


def test_pairs_are_given_once(spark):
    nodes = _nodes(spark, [0, 1, 3, 7, 15, 1 << 63])
    pairs = simhash.links(nodes).collect()
    assert len(pairs) == len({(r.u, r.v) for r in pairs}) > 0


def test_similar_documents(spark):
    """Edits spread over texts: classes are those of brute-force Jaccard similarity on five-word shingles."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randint(0, 400)) for _ in range(240)]
        for v, edits in enumerate((0, 1, 2, 4, 8, 24)):
            w = list(base)
            for p in rng.sample(range(240), edits):
                w[p] = f"edit{rng.randint(0, 10**6)}"
            rows.append((g * 10 + v, " ".join(w)))
    rows += [(900, rows[0][1].upper()), (901, ""), (902, None), (903, "few words"), (904, "few words"), (905, "other words")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    want = {d: rows[root[i]][0] for i, (d, _) in enumerate(rows)}
    for block in (1024, 2):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, rows), block=block).collect()} == want


def test_similar_documents_awkward(spark):
    got = simhash.similar_documents(awkward(spark)).collect()
    repeated = documents(spark, [(5, PROSE), (5, "another text of the same number altogether"), (5, PROSE), (6, PROSE), (None, PROSE)])
    kept = simhash.first_of_each(repeated, simhash.similar_documents(repeated)).collect()
    assert sorted((r.doc_id or 0, r.text[:7]) for r in kept) == [(0, PROSE[:7]), (5, "another"), (5, PROSE[:7])]
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7)]
    assert simhash.similar_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["appended", "block", "spread"])
def test_similar_documents_by_kind_of_edit(spark, kind):
    """Pairs a little over 0.8, whatever the edit: one added passage, one replaced block, words spread over a text that repeats its words."""
    rng = random.Random(4)
    rows = []
    for g in range(40):
        n = rng.randint(200, 400)
        base = [f"w{rng.randint(0, 100) if kind == 'spread' else rng.getrandbits(40)}" for _ in range(n)]
        w, new = list(base), lambda k: [f"new{rng.getrandbits(40)}" for _ in range(k)]
        if kind == "appended":
            w += new(int((n - 4) * 0.24))
        elif kind == "block":
            k = int((n - 4) / 9) - 5
            w[n // 3 : n // 3 + k] = new(k)
        else:
            e = (n - 4) // 45
            for i in range(e):
                w[10 + i * n // e] = new(1)[0]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, w))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.87
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, rows)).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_band_recall():
    """Of pairs at 0.8 and little more at least 0.998 share a band."""
    rng = np.random.default_rng(3)
    bands, rows = simhash.tuned_bands(0.8, simhash.BAND_RECALL, simhash.MOST_HASHES)
    found = 0
    for _ in range(2000):
        s = rng.integers(1 << 63, size=300, dtype=np.uint64)
        found += bool((simhash.band_keys(s, bands, rows) == simhash.band_keys(s[:240], bands, rows)).any())
    assert found >= 1996


@pytest.mark.parametrize("hot", [1000, 1])
def test_keys_and_points_are_not_broadcast(spark, hot):
    """Spark takes the many keys and points of a fingerprint for one row; sent to all executors they filled the driver."""
    fps = [1, 2, 3, 2**40, 2**40 + 1]
    plan = simhash.links(simhash.written(_nodes(spark, fps), "nodes"), hot)._jdf.queryExecution().sparkPlan().toString()
    wide = [line for line in plan.splitlines() if "Join" in line and ("rep" in line or "point" in line)]
    assert len(wide) == (1 if hot == 1000 else 2) and all("SortMergeJoin" in line for line in wide), plan
