"""The structural index against the plain walk over parsed JSON."""

import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietlake.operators import jsonwalk as J
from quietlake.operators import structure as S


def got(bodies):
    out = S.index(pa.array(bodies, pa.string()), J.BUSINESS_KEYS, J.DEFINITION_KEYS, J.MAX_DEPTH).to_pylist()
    return [None if x is None else [{k: v for k, v in leaf.items() if k != "repeated"} for leaf in x] for x in out]


def want(body):
    return J._placed(body)


NAMES = st.sampled_from(["role", "type", "input", "tools", "content", "a", "b.c", 'q"x', "日本", ""])
TREES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8) | st.sampled_from(["user", "text", "\\", '"', "a\n\t", "🙂"]),
    lambda below: st.lists(below, max_size=4) | st.dictionaries(NAMES, below, max_size=4), max_leaves=25,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(TREES, max_size=6), st.booleans(), st.sampled_from([None, 1]))
def test_trees(trees, ascii_, indent):
    bodies = [json.dumps(t, ensure_ascii=ascii_, indent=indent) for t in trees]
    assert got(bodies) == [want(b) for b in bodies]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='{}[],:"\\ 1-ea.tru\n', max_size=12), max_size=8))
def test_anything(bodies):
    assert got(bodies) == [want(b) for b in bodies]


@pytest.mark.parametrize("seed", range(4))
def test_damaged(seed):
    """One character changed, left out or added: the index and the parser agree on what is JSON."""
    rng = random.Random(seed)
    base = '{"role": "user", "x": [1, -2.5e3, true, null, {"type": "t", "a": "b\\"\\\\"}], "input": {"k": []}, "y": {}, "x": "z"}'
    bodies = []
    for _ in range(600):
        i = rng.randrange(len(base))
        bodies.append(base[:i] + rng.choice(["", *'{}[],:"\\0 x']) + base[i + rng.choice([0, 1]) :])
    assert got(bodies) == [want(b) for b in bodies]


def test_edges_and_slices():
    bodies = [None, "", " ", "1", '"x"', "[]", "{}", "nul", "01", "1 2", '"\\ud800"', "[" * 24 + "1" + "]" * 24, "[" * 25 + "]" * 25, "[" * 26 + "]" * 26, '{"a":1}\\', '\\{"a":1}']
    result = got(bodies)
    for b, r in zip(bodies, result):
        if b == '"\\ud800"':  # half a character cannot be written as UTF-8
            assert r[0]["value"] == "?"
        else:
            assert r == want(b), b
    part = pa.array(["x", *bodies], pa.string()).slice(1)
    assert len(S.index(part, (), (), 24)) == len(bodies) and S.index(pa.array([], pa.string()), (), (), 24).to_pylist() == []


def test_repeated_keys():
    out = S.index(pa.array(['{"a":1,"b":{"c":2,"c":[3]},"a":4}', '{"a":1,"b":{"a":2}}']), (), (), 24).to_pylist()
    assert [x["repeated"] for x in out[0]] == [True, True, False, True] and not any(x["repeated"] for x in out[1])


def test_slices_bound_the_index():
    """All bodies in order, in slices of bounded bytes, whatever the array's own offset; together they give the index of all."""
    rng = random.Random(5)
    bodies = [None if i % 9 == 0 else json.dumps({"messages": [{"role": "user", "content": "x" * rng.randint(0, 90)}]}) for i in range(200)] + ["x" * 5000, "", None]
    for given_ in (pa.array(bodies, pa.string()), pa.array(["z", *bodies], pa.string()).slice(1)):
        parts = list(S.slices(given_, 1000))
        assert len(parts) > 10 and pa.concat_arrays(parts).to_pylist() == bodies
        assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 1000 for p in parts)
        walk = lambda a: S.index(a, J.BUSINESS_KEYS, J.DEFINITION_KEYS, J.MAX_DEPTH).to_pylist()
        assert [x for p in parts for x in walk(p)] == walk(given_)
    assert [len(p) for p in S.slices(pa.array([], pa.string()))] == [0]
