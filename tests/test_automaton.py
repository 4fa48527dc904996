"""Dictionaries by automaton against plain searches."""

import random

import numpy as np
import pytest

from quietlake.operators import automaton as A


def plain(text, words):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = set()
    for w in words:
        f = "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
        at = low.find(f)
        while at >= 0:
            out.add((at, f))
            at = low.find(f, at + 1)
    return out


def got(machine, text):
    start, word = machine.find(A.points_of(text))
    return sorted((int(s), machine.words[w].lower()) for s, w in zip(start, word))


@pytest.mark.parametrize("letters", ["ab", "abcdeé日本", "ABxyz_ "])
def test_random_dictionaries(letters):
    rng = random.Random(len(letters))
    for _ in range(40):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))).lower() for _ in range(rng.randint(1, 60))})
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 3000)))
        assert got(A.Automaton(words, [False] * len(words)), text) == sorted(plain(text, words))


def test_words_over_lane_edges(monkeypatch):
    monkeypatch.setattr(A, "LANE", 8)
    rng = random.Random(1)
    words = ["abc", "bca" * 5, "a" * 30, "cab"]
    text = "".join(rng.choice("abc") for _ in range(2000)) + "a" * 70 + "bca" * 9
    assert got(A.Automaton(words, [False] * 4), text) == sorted(plain(text, words))


def test_many_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 12))) for _ in range(100_000)})
    machine = A.Automaton(words, [False] * len(words))
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30_000)) + " ".join(rng.sample(words, 500))
    low = set(words)
    want = sorted((i, text[i : i + n]) for n in range(3, 13) for i in range(len(text) - n + 1) if text[i : i + n] in low)
    assert got(machine, text) == want
    assert len(machine.check) < 4 * len(machine.base)


def test_edges_of_whole_words_and_single_characters():
    machine = A.Automaton(["cat", "a", "李", "中文", "dog!"], [True, False, False, True, True])
    assert got(machine, "cat Cat, concat catx a ab 李a x中文y dog!x dog") == [(0, "cat"), (4, "cat"), (21, "a"), (26, "李"), (27, "a"), (30, "中文"), (34, "dog!")]


def test_leftmost_longest():
    start, stop = np.array([3, 0, 0, 2, 5, 5]), np.array([6, 2, 4, 5, 6, 9])
    assert [(start[i], stop[i]) for i in A.leftmost_longest(start, stop)] == [(0, 4), (5, 9)]


def test_tables_in_parts(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(300)})
    texts = ["".join(rng.choice("ABcde ") for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None, "", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id long, text string, word string")
    table = spark.createDataFrame([(w, False) for w in words] + [(None, False), ("", True), ("re:x+", False)], "word string, whole boolean")
    for size in (A.PART_CHARS, 100):  # one part, and about ten
        rows = A.found(docs, table, spans="hits", part_chars=size).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert sorted((h.start, h.word) for h in r.hits) == sorted(plain(r.text or "", words))
    picked = {r.id: r.hits for r in A.chosen(A.found(docs, table, spans="hits", part_chars=100), "hits").collect()}
    for hits in picked.values():
        assert all(a.stop <= b.start for a, b in zip(hits, hits[1:]))
    assert A.found(docs, table.limit(0), spans="hits").count() == len(texts)


def test_masking_shares_placeholders_between_spellings(spark):
    docs = spark.createDataFrame([(1, "Acme Corp and ACME CORP, acme; 王小明在。")], "id long, text string")
    words = spark.createDataFrame([("Acme",), ("acme corp",), ("王小明",)], "word string")
    out = A.masked(docs, words, "CUSTOM", "key").first().text
    parts = out.split(" and ")
    assert parts[0] == parts[1].split(",")[0] and parts[0].startswith("{{CUSTOM_") and "王" not in out and out.endswith("在。")
