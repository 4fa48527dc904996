"""JSON texts by structural index: a whole batch at once, without an object for each value.

The bytes of all bodies lie end to end. Masks tell escaped quotes, insides of strings and the
structural characters; from these come the tokens, their depths and the container that each one
lies in, by sorting and running maxima. Whether a body is JSON is decided by which token may
follow which in its container. Keys, roles, types and zones are handed down level by level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, OBJECT_END, ARRAY, ARRAY_END, COMMA, COLON, STRING, SCALAR = range(8)
_KIND = np.full(256, 255, np.uint8)
for _k, _c in enumerate(b"{}[],:"):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_CONSTANTS = {"true": 1, "false": 1, "NaN": 1, "Infinity": 1, "-Infinity": 1, "null": 2}

FIELDS = [
    ("path", pa.string()), ("key", pa.string()), ("parent", pa.string()), ("role", pa.string()), ("type", pa.string()), ("kind", pa.string()), ("value", pa.string()),
    ("business", pa.bool_()), ("definition", pa.bool_()), ("depth", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("repeated", pa.bool_()),
]


def _slices(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """raw[start:stop] of each as strings."""
    sizes = stop - start
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    data = raw[np.arange(total) + np.repeat(start - (ends - sizes), sizes)]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _texts(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, escaped: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Contents of string tokens (between their quotes), and which of them are wrong; only those with a backslash are looked at singly."""
    out = _slices(raw, start + 1, stop - 1)
    wrong = np.zeros(len(start), bool)
    at = np.flatnonzero(escaped)
    if not len(at):
        return out, wrong
    made = []
    for i, s in zip(at.tolist(), _slices(raw, start[at], stop[at]).to_pylist()):
        try:
            made.append(json.loads(s).encode("utf-8", "replace").decode())
        except ValueError:
            made.append("")
            wrong[i] = True
    return pc.replace_with_mask(out, pa.array(escaped), pa.array(made, pa.string())), wrong


def _last(order_by: tuple[np.ndarray, ...], provides: np.ndarray) -> np.ndarray:
    """For each entry, by the order of position within its group, the last one so far that provides something (-1: none)."""
    order = np.lexsort(order_by)
    run = np.maximum.accumulate(np.where(provides[order] >= 0, np.arange(len(order)), -1))
    out = np.empty(len(order), np.int64)
    out[order] = np.where(run >= 0, provides[order][run], -1)
    return out


#: Bytes of bodies that are indexed at a time; the index needs some hundred times as many. A longer body is one slice.
SLICE_BYTES = 1 << 19


def slices(bodies: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The bodies in turn, in slices of at most so many bytes."""
    sizes = pc.fill_null(pc.binary_length(bodies), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield bodies.slice(at, i - at)
            at, size = i, 0
        size += n
    yield bodies.slice(at)


def index(bodies: pa.Array, business: tuple[str, ...], definitions: tuple[str, ...], most_depth: int) -> pa.Array:
    """Per body the list of its leaves in order, with FIELDS; null for a body that is no JSON or too deep.

    start and stop are the characters of the literal; repeated says that its object has a key
    twice. Roles go down to all levels below, types to the next objects only.
    """
    n = len(bodies)
    texts = pc.fill_null(bodies, "")
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    bad = np.zeros(n + 1, bool)
    bad[:n] = bodies.is_null().to_numpy(zero_copy_only=False) if n else []
    of = np.repeat(np.arange(n), np.diff(edges))
    place = np.arange(len(raw))
    begin = edges[of] if len(of) else place

    # quotes that no odd run of backslashes stands before
    slash = raw == 92
    solid = np.maximum.accumulate(np.where(slash, -1, place)) if len(raw) else place
    previous = np.append(-1, solid[:-1]) if len(raw) else place
    run = np.where(place > begin, place - 1 - np.maximum(previous, begin - 1), 0)
    quote = (raw == 34) & (run % 2 == 0)
    count = np.cumsum(quote)
    count = count - np.append(0, count)[edges[:-1]][of] if len(of) else count
    bad[of[(place == edges[1:][of] - 1) & (count % 2 == 1)]] = True
    inside = (count % 2 == 1) & ~quote
    bad[of[inside & (raw < 32)]] = True
    opens = quote & (count % 2 == 1)

    # tokens
    outside = ~inside & ~quote
    kinds = np.where(outside, _KIND[raw], 255)
    plain = outside & (kinds == 255) & ~_SPACE[raw]
    starts = plain & ~np.where(place > begin, np.append(False, plain[:-1]), False) if len(raw) else plain
    token = np.flatnonzero((kinds != 255) | opens | starts)
    kind = np.where(opens[token], STRING, np.where(starts[token], SCALAR, kinds[token])).astype(np.int64)
    body = of[token]
    stop = token + 1
    closes = np.flatnonzero(quote & ~opens)
    strings = np.flatnonzero(kind == STRING)
    after = np.searchsorted(closes, token[strings])
    stop[strings] = np.append(closes, len(raw))[after] + 1
    after = np.flatnonzero(~plain)
    scalars = np.flatnonzero(kind == SCALAR)
    stop[scalars] = np.minimum(np.append(after, len(raw))[np.searchsorted(after, token[scalars])], edges[1:][body[scalars]])
    bad[body[strings][stop[strings] > edges[1:][body[strings]]]] = True
    stop = np.minimum(stop, len(raw))

    # depths and containers
    opener, closer = (kind == OBJECT) | (kind == ARRAY), (kind == OBJECT_END) | (kind == ARRAY_END)
    depth = np.cumsum(opener.astype(np.int64) - closer)
    first = np.append(True, body[1:] != body[:-1]) if len(body) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    base = np.append(0, depth)[heads][np.cumsum(first) - 1] if len(body) else depth
    depth = depth - base
    last = np.append(body[1:] != body[:-1], True) if len(body) else first
    bad[body[(depth < 0) | (last & (depth != 0))]] = True
    level = np.where(opener, depth - 1, np.where(closer, depth + 1, depth))
    bad[body[level > most_depth + closer]] = True
    t = np.arange(len(token))
    entry = np.concatenate([t[opener], t])
    levels = np.concatenate([depth[opener], level])
    gives = np.concatenate([t[opener], np.full(len(t), -1)])
    # an opener takes part twice: first as the container of the level that it opens
    within = _last((np.concatenate([np.zeros(opener.sum()), np.ones(len(t))]), entry, levels, np.concatenate([body[opener], body])), gives)[opener.sum() :]
    within = np.where((level <= 0) | (within < 0), -1, within)
    home = np.where(within >= 0, kind[within], -1)
    bad[body[closer & (home != kind - 1)]] = True
    bad[body[(within >= 0) & (body[within] != body)]] = True

    # which token may follow which
    prior = np.where(first, -1, np.append(-1, kind[:-1])) if len(kind) else kind
    value = (kind >= STRING) | opener
    is_key = (kind == STRING) & (home == OBJECT) & ((prior == OBJECT) | (prior == COMMA))
    key_before = np.append(False, is_key[:-1]) & ~first if len(kind) else is_key
    done = ((prior >= STRING) & ~key_before) | (prior == OBJECT_END) | (prior == ARRAY_END)
    right = np.select(
        [is_key, value & (home == OBJECT), value & (home == ARRAY), value, kind == COLON, kind == COMMA],
        [True, prior == COLON, (prior == ARRAY) | (prior == COMMA), first, key_before, done & (home >= 0)],
        done | (prior == kind - 1),
    )
    right &= ~is_key | (np.append(kind[1:], -1) == COLON if len(kind) else is_key)
    bad[body[~right.astype(bool)]] = True
    full = np.zeros(n, bool)
    full[body] = True
    bad[:n] |= ~full

    # literals
    words = _slices(raw, token[scalars], stop[scalars]).dictionary_encode()
    sort = np.array([_CONSTANTS.get(w, 0 if _NUMBER.fullmatch(w) else -1) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    bad[body[scalars[sort < 0]]] = True
    slashes = np.append(0, np.cumsum(slash))
    ok = ~bad[body[strings]]
    strings = strings[ok]
    escaped = slashes[stop[strings]] > slashes[token[strings]]
    content, wrong = _texts(raw, token[strings], stop[strings], escaped)
    bad[body[strings[wrong]]] = True
    text_of = np.full(len(token), -1, np.int64)
    text_of[strings] = np.arange(len(strings))

    # from here on only bodies that are right
    keep = np.flatnonzero(~bad[body]) if len(body) else t
    names = content.take(pa.array(text_of[keep][is_key[keep]])).dictionary_encode()
    listed = names.dictionary.to_pylist()
    number = np.full(len(token), -1, np.int64)  # of a key, among the names
    number[keep[is_key[keep]]] = names.indices.to_numpy() if len(names) else []
    known = {name: i for i, name in enumerate(listed)}
    nothing = len(listed)
    own = np.full(len(token), nothing, np.int64)
    after_colon = keep[(value & (prior == COLON))[keep]]
    own[after_colon] = number[after_colon - 2]
    of_key = lambda k: np.isin(own, [known[x] for x in k if x in known])
    zone_b, zone_d = of_key(business), of_key(definitions)

    def own_text(name: str) -> np.ndarray:
        """Per object the string token of its last field of this name (-1: none, or no string)."""
        out = np.full(len(token), -1, np.int64)
        if name in known:
            at = after_colon[own[after_colon] == known[name]]  # in order, so that the last one stays
            out[within[at]] = np.where(kind[at] == STRING, at, -1)
        return out

    role_own, type_own = own_text("role"), own_text("type")
    some = role_own >= 0
    some[some] = pc.utf8_length(content.take(pa.array(text_of[role_own[some]]))).to_numpy() > 0
    nodes = keep[value[keep] & ~is_key[keep]]
    key, parent = np.full(len(token), nothing, np.int64), np.full(len(token), nothing, np.int64)
    role, type_ = np.full(len(token), -1, np.int64), np.full(len(token), -1, np.int64)
    in_b, in_d = np.zeros(len(token), bool), np.zeros(len(token), bool)
    commas = keep[(kind == COMMA)[keep] & (home == ARRAY)[keep]]
    order = np.lexsort((np.concatenate([commas, nodes]), within[np.concatenate([commas, nodes])]))
    both = np.concatenate([commas, nodes])[order]
    passed = np.cumsum(np.isin(both, commas, assume_unique=True))
    group = np.append(True, within[both][1:] != within[both][:-1]) if len(both) else np.zeros(0, bool)
    before = np.append(0, passed)[np.flatnonzero(group)][np.cumsum(group) - 1] if len(both) else passed
    item = np.zeros(len(token), np.int64)
    item[both] = passed - before
    paths, path_at, filled = [pa.array(["$"])], np.zeros(len(token), np.int64), 1
    all_names = pa.array([*listed, ""], pa.string())
    for d in range(int(level[nodes].max(initial=-1)) + 1):
        here = nodes[level[nodes] == d]
        if d == 0:
            continue
        up = within[here]
        named = kind[up] == OBJECT
        key[here] = np.where(named, own[here], key[up])
        parent[here] = np.where(named, key[up], parent[up])
        role[here] = np.where(named & some[up], role_own[up], role[up])
        type_[here] = np.where(named, type_own[up], type_[up])
        in_b[here] = in_b[up] | (named & zone_b[here])
        in_d[here] = in_d[up] | (named & zone_d[here])
        above = pa.concat_arrays(paths).take(pa.array(path_at[up]))
        by_name = pc.binary_join_element_wise(above, all_names.take(pa.array(own[here])), ".")
        by_item = pc.binary_join_element_wise(above, pc.binary_join_element_wise("[", pa.array(item[here]).cast(pa.string()), "]", ""), "")
        paths.append(pc.if_else(pa.array(named), by_name, by_item))
        path_at[here] = filled + np.arange(len(here))
        filled += len(here)

    # keys that their object has twice
    twice = np.zeros(len(token), bool)
    if len(after_colon):
        pair = np.stack([within[after_colon], own[after_colon]], 1)
        _, which, counts = np.unique(pair, axis=0, return_inverse=True, return_counts=True)
        twice[after_colon] = counts[which.ravel()] > 1

    leaf = nodes[~opener[nodes]]
    is_text = kind[leaf] == STRING
    of_scalar = np.full(len(token), 0, np.int64)
    of_scalar[scalars] = np.arange(len(scalars))
    scalar_sort = np.append(sort, 0)[np.where(is_text, len(sort), of_scalar[leaf])]
    what = pa.array(["number", "boolean", "null", "string"]).take(pa.array(np.where(is_text, 3, np.maximum(scalar_sort, 0))))
    both_texts = pa.concat_arrays([content, words.cast(pa.string()) if len(words) else pa.array([], pa.string())])
    values = both_texts.take(pa.array(np.where(is_text, text_of[leaf], len(content) + of_scalar[leaf])))
    texts_or_null = lambda at: content.take(pa.array(text_of[at], mask=at < 0))
    characters = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    column = [
        pa.concat_arrays(paths).take(pa.array(path_at[leaf])), all_names.take(pa.array(key[leaf])), all_names.take(pa.array(parent[leaf])), texts_or_null(role[leaf]), texts_or_null(type_[leaf]),
        what, values, pa.array(in_b[leaf]), pa.array(in_d[leaf]), pa.array(level[leaf], pa.int32()),
        pa.array(characters[token[leaf]] - characters[edges[body[leaf]]], pa.int32()), pa.array(characters[stop[leaf]] - characters[edges[body[leaf]]], pa.int32()), pa.array(twice[leaf]),
    ]
    struct = pa.StructArray.from_arrays(column, fields=[pa.field(name, t) for name, t in FIELDS])
    sizes = np.bincount(body[leaf], minlength=n) if n else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(bad[:n], False)), struct)
