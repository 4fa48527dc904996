"""Dictionaries of any size: an Aho-Corasick automaton that reads many stretches of text at once.

Transitions lie in a double array (a state's base plus the character's code gives the slot; the
slot names its state). Text is laid end to end and cut into lanes of equal length, each of which
begins with as many characters of the one before as a word may have; all lanes take a step
together, so a step costs a few numpy gathers however many lanes there are.

A dictionary is dealt into parts of bounded size. Each part's automaton is built in a task of its
own and is broadcast, which its size bounds; texts go through the parts one after another and are
never shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import slices

#: Characters of all words of a part: an automaton has at most as many states (about 40 bytes each).
PART_CHARS = 2_000_000
#: Characters of text that go through the lanes together, and of a lane.
SLICE_CHARS, LANE = 1_000_000, 512
#: Trials to put a state's branches into gaps of the array before they go to its end.
TRIALS = 16
_MOST_CODES = 0x110000


def _folded() -> np.ndarray:
    """Lower case of every code point that has one of a single character."""
    out = np.arange(_MOST_CODES, dtype=np.uint32)
    for c in range(0x1FFFF):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


_FOLD: list[np.ndarray] = []


def folded(points: np.ndarray) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_folded())
    return _FOLD[0][points]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _wordly(points: np.ndarray) -> np.ndarray:
    """Whether a character is an ASCII letter, a digit or an underscore."""
    return ((points | 32) - 97 < 26) & (points < 128) | (points - 48 < 10) | (points == 95)


class Automaton:
    """Words of any case; marks say whether a word must not touch word characters before or behind it."""

    def __init__(self, words: list[str], whole: list[bool], new: list[str] | None = None):
        folds = [folded(points_of(w)) for w in words]
        keep = [i for i, f in enumerate(folds) if len(f)]
        self.words = [words[i] for i in keep]
        self.new = [new[i] for i in keep] if new else None
        folds = [folds[i] for i in keep]
        self.sizes = np.array([len(f) for f in folds], np.int32)
        edge = np.array([whole[i] for i in keep], bool) | (self.sizes == 1)
        self.head = edge & np.array([bool(_wordly(f[:1])[0]) for f in folds], bool)
        self.tail = edge & np.array([bool(_wordly(f[-1:])[0]) for f in folds], bool)
        self.longest = int(self.sizes.max()) if len(folds) else 0
        alphabet = np.unique(np.concatenate(folds)) if folds else np.zeros(0, np.uint32)
        self.codes = np.zeros(_MOST_CODES, np.uint32)
        self.codes[alphabet] = np.arange(1, len(alphabet) + 1)
        self._trie(folds, len(alphabet) + 1)

    def _trie(self, folds: list[np.ndarray], width: int) -> None:
        flat = self.codes[np.concatenate(folds)].astype(np.int64) if folds else np.zeros(0, np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        at = np.zeros(len(folds), np.int64)
        parents, codes, levels, n = [], [], [1], 1
        word = [np.full(1, -1, np.int32)]
        for depth in range(self.longest):
            more = np.flatnonzero(self.sizes > depth)
            key = at[more] * width + flat[starts[more] + depth]
            kinds, which = np.unique(key, return_inverse=True)
            parents.append(kinds // width), codes.append(kinds % width)
            at[more] = n + which
            ends = np.full(len(kinds), -1, np.int32)
            last = more[self.sizes[more] == depth + 1]
            ends[at[last][::-1] - n] = last[::-1]  # of equal words the first
            word.append(ends)
            n += len(kinds)
            levels.append(n)
        self.word = np.concatenate(word)
        parent = np.concatenate([np.zeros(1, np.int64), *parents]).astype(np.int64)
        code = np.concatenate([np.zeros(1, np.int64), *codes]).astype(np.int64)
        self._array(parent, code, n, width)
        self.fail, self.link = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for lo, hi in zip(levels[1:], levels[2:]):
            states = np.arange(lo, hi)
            self.fail[states] = self.step(self.fail[parent[states]], code[states])
            f = self.fail[states]
            self.link[states] = np.where(self.word[f] >= 0, f, self.link[f])
        if len(levels) > 1:  # words of one character: their states fall back to the root
            self.fail[levels[0] : levels[1]] = 0
        self.says = (self.word >= 0) | (self.link >= 0)

    def _array(self, parent: np.ndarray, code: np.ndarray, n: int, width: int) -> None:
        """Bases: states with several branches in gaps or at the end, those with one in what is left."""
        order = np.argsort(parent[1:], kind="stable") + 1
        owners, first, count = np.unique(parent[order], return_index=True, return_counts=True)
        base = np.zeros(n, np.int64)
        free = np.ones(4 * width + 4 * n, bool)
        end = width
        several = np.flatnonzero(count > 1)
        for i in several[np.argsort(-count[several], kind="stable")].tolist():
            cs = code[order[first[i] : first[i] + count[i]]]
            b = max(0, end - width)
            for _ in range(TRIALS):
                if free[b + cs].all():
                    break
                b += 1
            else:
                b = end
            while b + width >= len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            free[b + cs] = False
            base[owners[i]] = b
            end = max(end, b + int(cs[-1]) + 1)
        single = np.flatnonzero(count == 1)
        slots = np.flatnonzero(free[width:])[: len(single)] + width
        if len(slots) < len(single):
            slots = np.concatenate([slots, len(free) + np.arange(len(single) - len(slots))])
        base[owners[single]] = slots - code[order[first[single]]]
        place = base[parent[1:]] + code[1:]
        size = int(max(place.max(initial=0), base.max(initial=0))) + width + 1
        self.base = base.astype(np.int32)
        self.check, self.target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.check[place], self.target[place] = parent[1:], np.arange(1, n)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one character each."""
        states = states.astype(np.int64)
        place = self.base[states] + codes
        hit = self.check[place] == states
        out = np.where(hit, self.target[place], 0)
        left = np.flatnonzero(~hit & (states != 0))
        now = states[left]
        while len(left):
            now = self.fail[now]
            place = self.base[now] + codes[left]
            hit = self.check[place] == now
            out[left[hit]] = self.target[place[hit]]
            stay = ~hit & (now != 0)
            left, now = left[stay], now[stay]
        return out

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, word) of every occurrence in one stretch of characters."""
        warm = max(0, self.longest - 1)
        lane = max(LANE, 4 * self.longest)
        lanes = -(-len(points) // lane)
        if not lanes or not self.longest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.zeros(warm + lanes * lane, np.int64)
        codes[warm : warm + len(points)] = self.codes[folded(points)]
        rows = np.lib.stride_tricks.sliding_window_view(codes, warm + lane)[::lane]
        steps = np.ascontiguousarray(rows.T)
        states = np.zeros(lanes, np.int64)
        origin = np.arange(lanes) * lane - warm
        where, what = [], []
        for t in range(warm + lane):
            states = self.step(states, steps[t])
            if t >= warm:
                on = np.flatnonzero(self.says[states])
                if len(on):
                    where.append(origin[on] + t)
                    what.append(states[on])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last, state = np.concatenate(where), np.concatenate(what)
        starts, found = [], []
        while len(state):
            w = self.word[state]
            own = w >= 0
            starts.append(last[own] + 1 - self.sizes[w[own]])
            found.append(w[own])
            state = self.link[state]
            more = state >= 0
            last, state = last[more], state[more]
        start, word = np.concatenate(starts), np.concatenate(found).astype(np.int64)
        # edges
        wordly = np.concatenate(([False], _wordly(points), [False]))
        ok = ~(self.head[word] & wordly[start]) & ~(self.tail[word] & wordly[start + self.sizes[word] + 1])
        return start[ok], word[ok]


def leftmost_longest(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of occurrences the indices of those that remain: from the left, of equal starts the longest, none over another."""
    order = np.lexsort((-stop, start))
    out, at = [], -1
    for i, s, e in zip(order.tolist(), start[order].tolist(), stop[order].tolist()):
        if s >= at:
            out.append(i)
            at = e
    return np.array(out, np.int64)


def automata(words: DataFrame, part_chars: int = PART_CHARS) -> Iterator[bytes]:
    """Pickled automata of the parts, one after another: words (word, whole, new) with whole and new optional."""
    whole = F.coalesce("whole", F.lit(False)) if "whole" in words.columns else F.lit(False)
    new = F.col("new") if "new" in words.columns else F.lit(None).cast("string")
    given = words.where("word IS NOT NULL AND word <> '' AND NOT startswith(word, 're:')").select("word", whole.alias("whole"), new.alias("new")).dropDuplicates(["word"])
    parts = int((given.agg(F.sum(F.length("word"))).first()[0] or 0) // part_chars + 1)

    def build(key: tuple, found: pa.Table) -> pa.Table:
        rows = found.sort_by("word").to_pydict()
        made = Automaton(rows["word"], rows["whole"], rows["new"] if any(x is not None for x in rows["new"]) else None)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(made, 5)], pa.binary())})

    dealt = given.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    for row in dealt.groupBy("part").applyInArrow(build, "part long, blob binary").toLocalIterator():
        yield bytes(row.blob)


SPANS = "array<struct<start:int,stop:int,word:string,new:string>>"


def found(docs: DataFrame, words: DataFrame, text: str = "text", spans: str = "words", part_chars: int = PART_CHARS) -> DataFrame:
    """docs with a column of all occurrences of the words in any case: start, stop (code points), word, new.

    words: word and, if wanted, whole (the word must not touch ASCII word characters where it
    begins or ends with one; single characters never may) and new (what to put in its place).
    `re:` words are left to dictionary.rule(). Occurrences may overlap. Of words that differ by
    case only the one that sorts first is reported. A null text has none; texts of any length are
    searched whole.
    """
    out = docs.withColumn(spans, F.array().cast(SPANS))
    kinds = out.schema
    at, into = out.columns.index(text), out.columns.index(spans)
    for blob in automata(words, part_chars):
        shared = docs.sparkSession.sparkContext.broadcast(blob)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = None
            for batch in batches:
                machine = machine or pickle.loads(shared.value)
                for part in slices(batch.column(at), SLICE_CHARS):
                    # what is found may be many times the text, so it goes out piece by piece
                    yield _searched(batch.slice(part.offset - batch.column(at).offset, len(part)), at, into, machine)

        out = out.mapInArrow(work, kinds)
    return out


def _searched(batch: pa.RecordBatch, at: int, into: int, machine: Automaton) -> pa.RecordBatch:
    texts = [points_of(t) if t is not None else None for t in batch.column(at).to_pylist()]
    hits: list[tuple[np.ndarray, ...]] = []
    todo, size = [], 0
    for i, p in enumerate(texts):
        if p is not None and len(p):
            todo.append(i)
            size += len(p) + 1
        if todo and (size >= SLICE_CHARS or i == len(texts) - 1):
            hits.append(_occurrences(machine, texts, todo))
            todo, size = [], 0
    old = batch.column(into)
    kind = old.type.value_type
    counts = np.diff(old.offsets.to_numpy())
    row, start, stop, word = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*hits)) or [()] * 4)]
    which = pa.array(word)
    named = pa.array(machine.words, pa.string()).take(which)
    new = pa.array(machine.new, pa.string()).take(which) if machine.new else pa.nulls(len(word), pa.string())
    fresh = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), named, new], fields=list(kind))
    rows = np.concatenate([np.repeat(np.arange(len(counts)), counts), row])
    both = pa.concat_arrays([old.flatten().cast(kind), fresh]).take(pa.array(np.argsort(rows, kind="stable")))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int32)
    columns = list(batch.columns)
    columns[into] = pa.ListArray.from_arrays(pa.array(offsets), both, type=old.type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _occurrences(machine: Automaton, texts: list, todo: list[int]) -> tuple[np.ndarray, ...]:
    """(row, start, stop, word) in these texts, which go through together with a character between them that is in no word."""
    gap = np.zeros(1, np.uint32)
    edges = np.cumsum([0] + [len(texts[i]) + 1 for i in todo])
    start, word = machine.find(np.concatenate([x for i in todo for x in (texts[i], gap)]))
    of = np.searchsorted(edges, start, side="right") - 1
    stop = start + machine.sizes[word]
    inside = stop <= edges[of + 1] - 1
    of, start, stop, word = of[inside], start[inside], stop[inside], word[inside]
    return np.array(todo)[of], start - edges[of], stop - edges[of], word


def chosen(docs: DataFrame, spans: str = "words") -> DataFrame:
    """docs whose column of occurrences keeps the leftmost and, of equal starts, the longest ones; none over another."""
    into = docs.columns.index(spans)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found_ in batch.column(into).to_pylist():
                if found_ and len(found_) > 1:
                    keep = leftmost_longest(np.array([f["start"] for f in found_]), np.array([f["stop"] for f in found_]))
                    found_ = [found_[i] for i in keep.tolist()]
                out.append(found_)
            columns = list(batch.columns)
            columns[into] = pa.array(out, batch.schema.field(into).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)


def replaced(docs: DataFrame, words: DataFrame, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """docs with each chosen occurrence of a word replaced by its `new`; other columns stay."""
    from ..functions.text import spliced

    spans = "_words"
    done = chosen(found(docs, words, text, spans, part_chars), spans)
    return done.withColumn(text, spliced(F.col(text), F.col(spans), lambda s: F.coalesce(s["new"], s["word"]))).drop(spans)


def masked(docs: DataFrame, words: DataFrame, category: Column | str, key: str, text: str = "text") -> DataFrame:
    """docs with words (word, whole and perhaps columns for category) replaced by placeholders; spellings in other case share one."""
    from .tokens import token

    label = F.lit(category) if isinstance(category, str) else category
    return replaced(docs, words.withColumn("new", token(label, F.lower("word"), key)), text)
