"""Chinese personal names: evidence first, and counter-examples learned from the corpus.

Names always stand by something that says so: a role or a verb before them, a form of address or
a verb behind them. One pass finds these anchors; only within a few characters of an anchor are
words with a surname looked at, each with the weight of its evidence. What looks like a name by
surname but stands without evidence nearly everywhere in the corpus is an ordinary word; such
words are counted over all texts, and candidates that are one, or the beginning of one, are
rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import DOUBLE, GRAMMAR, STRONG_LEFT, STRONG_RIGHT, SURNAMES

#: Two points make a name. Before a name, a separator may follow: words that only people have, and verbs whose object is a person.
BEFORE = {w: 2 for w in (*STRONG_LEFT, "联系", "转给", "告诉", "通知", "委托", "拜访", "负责人", "经办人", "法人", "同事")} | {
    w: 1 for w in ("作者", "签名", "电话", "用户", "代表", "编辑", "成员", "主持")
}
#: Behind a name: forms of address, and verbs that people do (and programs too).
AFTER = {w: 2 for w in STRONG_RIGHT} | {w: 1 for w in ("说", "表示", "认为", "提交", "同意", "回复", "签署", "来电")}
#: Characters between an anchor and the name, and of the longest name.
GAP, LONGEST = 2, 4
#: A word is a counter-example if it stands this often or more, and with strong evidence in less than this share of places.
LEAST, SHARE = 20, 0.2

_HAN = r"[一-鿿]"
_SEPARATORS = " \t:：,，是为"
_DOUBLE = "|".join(DOUBLE)
_SURNAME = re.compile(f"(?:{_DOUBLE}|[{SURNAMES}])")
_ANCHOR = re.compile("|".join(sorted(map(re.escape, {*BEFORE, *AFTER}), key=len, reverse=True)))
_TAILS = sorted(AFTER, key=len, reverse=True)
_HEADS = sorted(BEFORE, key=len, reverse=True)
#: A label that makes weak evidence strong: the word, a colon, the name.
_LABEL = ":："


def _after(text: str, stop: int) -> tuple[str, int]:
    for w in _TAILS:
        if text.startswith(w, stop):
            return w, AFTER[w]
    return "", 0


def _before(text: str, start: int) -> int:
    at = start
    while at > 0 and start - at < GAP and text[at - 1] in _SEPARATORS:
        at -= 1
    for w in _HEADS:
        if text.endswith(w, 0, at):
            return 2 if text[at:start].strip(" \t") in _LABEL and at < start and text[at:start].strip() else BEFORE[w]
    return 0


def evidence(text: str, start: int, stop: int) -> int:
    """Points for a name at this place: 2 and more are enough."""
    return _before(text, start) + _after(text, stop)[1]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, name) by surname, shape and evidence of at least two points, apart, in order."""
    starts: set[int] = set()
    for m in _ANCHOR.finditer(text):
        for s in _SURNAME.finditer(text, max(0, m.start() - LONGEST), min(len(text), m.end() + GAP + 2)):
            starts.add(s.start())
    out, at = [], 0
    for start in sorted(starts):
        if start < at:
            continue
        surname = _SURNAME.match(text, start).end()
        best = None
        for size in (2, 1):  # of given names with the same evidence the longer one
            stop = surname + size
            given = text[surname:stop]
            if len(given) < size or not re.fullmatch(f"{_HAN}+", given) or any(c in GRAMMAR for c in given):
                continue
            if any(given[i:].startswith(w) for w in AFTER for i in range(size)) or any(text.startswith(w, stop - 1) for w in STRONG_RIGHT if size == 2):
                continue
            points = evidence(text, start, stop)
            # what goes on in Chinese behind the name must be an anchor, or the name would end in the middle of a word
            whole = stop == len(text) or not re.match(_HAN, text[stop]) or bool(_after(text, stop)[0]) or text[stop] in GRAMMAR
            rank = (points if whole else points - 1, size)
            if points >= 2 and (best is None or rank > best[0]):
                best = (rank, (start, stop, text[start:stop]))
        if best:
            out.append(best[1])
            at = best[1][1]
    return out


def _rows(docs: DataFrame, text: str, work, fields: str) -> DataFrame:
    """docs' other columns with what work yields for a text."""
    rest = [c for c in docs.columns if c != text]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for r in work(t) if t else ():
                    rows.append(r)
                    of.append(i)
            if rows:
                new = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.select(rest).take(pa.array(of)).columns, *new], [*rest, *names])

    return docs.select(*rest, text).mapInArrow(run, ", ".join(filter(None, [kept, fields])))


def _words(text: str) -> Iterator[tuple[str, int, int]]:
    """(word, places, places with strong evidence) of all strings of two and three characters that begin with a surname.

    Evidence for one of the two at a place is evidence for both: 王伟先 in 王伟先生 speaks as little
    against the name 王伟 as the first half of a longer name does.
    """
    counts: dict[str, list[int]] = {}
    for s in _SURNAME.finditer(text):
        stops = [stop for stop in (s.end() + 1, s.end() + 2) if stop <= len(text) and re.fullmatch(f"{_HAN}+", text[s.start() : stop])]
        strong = any(evidence(text, s.start(), stop) >= 2 for stop in stops)
        for stop in stops:
            c = counts.setdefault(text[s.start() : stop], [0, 0])
            c[0] += 1
            c[1] += strong
    yield from ((w, n, e) for w, (n, e) in counts.items())


def counter_examples(docs: DataFrame, text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(word, n): strings that begin with a surname and stand without strong evidence nearly everywhere in the corpus.

    Counts cover all texts; what a text repeats is summed before it is shuffled.
    """
    each = _rows(docs.select(text), text, _words, "word string, n long, e long")
    sums = each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return sums.where((F.col("n") >= least) & (F.col("e") < F.col("n") * share)).select("word", "n")


def beginnings(words: DataFrame) -> DataFrame:
    """(word): the counter-examples and all their beginnings of two characters and more."""
    return words.select(F.explode(F.transform(F.sequence(F.lit(2), F.length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("word")).distinct()


def rejected(found: DataFrame, counter: DataFrame, value: str = "value") -> DataFrame:
    """Rows of found whose value is a counter-example or the beginning of one: pseudo-names, also of other taggers."""
    return found.join(beginnings(counter).withColumnRenamed("word", value), value, "left_semi")


def names(docs: DataFrame, counter: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs' other columns with start, stop (code points) and value of each name; counter: words that are none.

    A null text has no names; texts of any length are read whole.
    """
    found = _rows(docs, text, candidates, "start int, stop int, value string")
    return found if counter is None else found.join(beginnings(counter).withColumnRenamed("word", "value"), "value", "left_anti").select(*found.columns)


def strong_context(text: Column, start: Column, stop: Column) -> Column:
    """Whether a span (code points, end exclusive) has two points of evidence: one strong piece or two weak ones, next to it."""
    head = F.regexp_replace(F.substr(text, F.greatest(start - 8, F.lit(0)) + 1, F.least(start, F.lit(8))), rf"[{_SEPARATORS}]{{0,{GAP}}}$", "")
    label = F.regexp_like(F.substr(text, F.greatest(start, F.lit(1)), F.lit(1)), F.lit(f"^[{_LABEL}]$"))
    tail = F.substr(text, stop + 1, F.lit(4))
    ends = lambda n: F.lit(False) if not (w := [x for x, p in BEFORE.items() if p == n]) else head.rlike(f"(?:{'|'.join(w)})$")
    begins = lambda n: tail.rlike(f"^(?:{'|'.join(x for x, p in AFTER.items() if p == n)})")
    before = F.when(ends(2) | (ends(1) & label), 2).when(ends(1), 1).otherwise(0)
    return before + F.when(begins(2), 2).when(begins(1), 1).otherwise(0) >= 2
