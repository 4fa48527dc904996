import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

from quietlake.llm import sharding

from .helpers import awkward, documents, empty


def brute(rows, shards, seed):
    by = defaultdict(list)
    for d, text, source in rows:
        h = int(np.array([xxhash.xxh64_intdigest((text or "").encode(), seed=42)], np.uint64).view(np.int64)[0])
        by[source].append((hashlib.md5(f"{seed}:{d}:{h}".encode()).hexdigest(), d, zlib.crc32((text or "").encode()), len((text or "").encode()) + 1))
    line = []
    for s, group in by.items():
        for i, r in enumerate(sorted(group)):
            line.append((Fraction(2 * i + 1, 2 * len(group)), s, r))
    line.sort()
    out, slots = {}, Counter()
    for p, (_, _, r) in enumerate(line):
        shard = p * shards // len(line)
        out[r[1]] = (r[3], r[2], shard, slots[shard])
        slots[shard] += 1
    return out


def test_against_brute_force(spark):
    rows = [(i, f"text {i % 50} é" * (i % 7), f"s{0 if i % 3 else i % 11}") for i in range(701)]
    got = sharding.interleave(documents(spark, rows), shards=8, seed=3).collect()
    want = brute(rows, 8, 3)
    assert len(got) == 701
    for r in got:
        assert (r.size, r.text_crc32, r.shard, r.slot) == want[r.doc_id]
        assert r.law == "rows" and r.grown_shard is None
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    mixture = Counter((r.shard, r.stratum) for r in got)
    # cuts fall at equal counts of rows, so a source is off its share by at most a row for each other source
    for source in {r[2] for r in rows}:
        share = sum(1 for r in rows if r[2] == source) / 8
        assert all(abs(mixture[(s, source)] - share) <= 11 for s in range(8))
    assert max(mixture[(s, "s0")] for s in range(8)) - min(mixture[(s, "s0")] for s in range(8)) <= 11


def test_awkward_rows(spark):
    got = sharding.interleave(awkward(spark), shards=3).collect()
    assert len(got) == 9
    assert {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert {r.text_crc32 for r in got if r.doc_id in (1, 2)} == {0}
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_null_source_and_empty_table(spark):
    got = sharding.interleave(documents(spark, [(1, "a", None), (2, "b", None), (3, "c", "x")]), shards=8).collect()
    assert len(got) == 3 and sharding.interleave(empty(spark)).count() == 0


def test_partitioning_does_not_matter(spark):
    docs = documents(spark, [(i, str(i), f"s{i % 3}") for i in range(100)])
    a = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs.repartition(1)).collect()}
    assert a == {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs.repartition(7)).collect()}


def test_plan_is_native(spark):
    plan = sharding.interleave(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
