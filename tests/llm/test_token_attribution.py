import numpy as np
import pytest
from quietlake.llm import token_attribution as A
from quietlake.llm.bpe import rank_path

from .helpers import PROSE, awkward, documents, empty


def brute(text, spans, rule):
    """Per token: its share of every section, from byte sets."""
    encoding, sizes = A._encoding(rank_path())
    owner = []
    for k, (a, b) in enumerate(spans):
        owner += [k] * len(text[a:b].encode())
    counts, at = [0.0] * len(spans), 0
    for i in encoding.encode_ordinary(text):
        mine = owner[at : at + sizes[i]]
        at += sizes[i]
        if rule == "start":
            counts[mine[0]] += 1
        elif rule == "split":
            for k in mine:
                counts[k] += 1 / len(mine)
        else:
            counts[max(sorted(set(mine)), key=mine.count)] += 1
    return counts


@pytest.mark.parametrize("rule", A.RULES)
def test_against_brute_force(spark, rule):
    rows = [(i, f"{PROSE[: i * 9]}\n\n{'é日🙂' * (i % 4)}\r\nx{i}  y\n", f"s{i}") for i in range(20)]
    got = {}
    for r in A.attribute(documents(spark, rows), ["source", "text"], rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, text, source in rows:
        whole = source + "\n" + text
        parts = sorted(got[d], key=lambda r: (r.start, r.stop))
        assert parts[0].start == 0 and parts[-1].stop == len(whole)
        want = brute(whole, [(r.start, r.stop) for r in parts], rule)
        assert np.allclose([r.n_tokens for r in parts], want)
        assert abs(sum(r.n_tokens for r in parts) - parts[0].doc_tokens) < 1e-9


def test_sections_need_not_cover():
    ends = np.array([3, 6, 9, 12])
    n, crossing = A.allocate(ends, np.array([1, 7]), np.array([5, 12]), "majority")
    assert n.tolist() == [2.0, 2.0] and crossing.tolist() == [2, 1]
    n, _ = A.allocate(ends, np.array([2]), np.array([3]), "majority")
    assert n.tolist() == [0.0]


def test_fields_without_sections(spark):
    rows = A.attribute(documents(spark, [(1, "one two", "src0")]), ["source", "lang", "text"], sections=False).collect()
    assert [r.field for r in sorted(rows, key=lambda r: r.start)] == ["source", "lang", "text"]


def test_awkward_rows(spark):
    rows = A.attribute(awkward(spark), ["lang", "text"]).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [r.n_tokens for r in rows if r.doc_id == 1 and r.field == "text"] == [0]
    assert A.attribute(empty(spark), ["text"]).count() == 0
    with pytest.raises(ValueError):
        A.attribute(empty(spark), ["text"], rule="none")
