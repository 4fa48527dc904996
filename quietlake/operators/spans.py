"""Span algebra on array<struct<start, stop, ...>> columns, and offset maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import spliced


def resolved(spans: Column) -> Column:
    """Non-overlapping spans from left to right; of those that begin together the longest; later overlapping ones are dropped whole.

    spans: array<struct<start:int, stop:int, token:string>>.
    """
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    begin = F.struct(F.lit(0).alias("at"), F.filter(ordered, lambda _: F.lit(False)).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = (s["start"] >= acc["at"]) & (s["stop"] > s["start"])
        return F.when(fits, F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)

    return F.aggregate(ordered, begin, step)["out"]


def applied(text: Column, spans: Column) -> Column:
    """text with each resolved span replaced by its token."""
    return spliced(text, resolved(spans), lambda s: s["token"])


def merged(spans: Column, gap: int = 0) -> Column:
    """Spans that overlap or are at most `gap` apart as one (start, stop)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    none = F.filter(ordered, lambda _: F.lit(False))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["stop"] + gap), F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, none, step)


def clipped(spans: Column) -> Column:
    """Overlapping spans cut at the end of the one before instead of dropped."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    begin = F.struct(F.lit(0).alias("at"), F.filter(ordered, lambda _: F.lit(False)).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        cut = F.struct(start.alias("start"), s["stop"].alias("stop"))
        return F.when(start < s["stop"], F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(cut)).alias("out"))).otherwise(acc)

    return F.aggregate(ordered, begin, step)["out"]


class OffsetMap:
    """Where points of a text lie after edits (start, stop, length of the new text); monotone, composable.

    A point inside an edit maps to the edit's edge: its start for left ends, its end for right ends.
    """

    def __init__(self, edits: list[tuple[int, int, int]], length: int):
        at = 0
        for start, stop, size in edits:
            if start < at or stop < start or stop > length or size < 0:
                raise ValueError("edits must be sorted, apart and inside the text")
            at = stop
        self.edits, self.length = list(edits), length

    def point(self, p: int, right: bool = False) -> int:
        shift = 0
        for start, stop, size in self.edits:
            if p <= start:
                break
            if p >= stop:
                shift += size - (stop - start)
                continue
            return start + shift + (size if right else 0)
        return p + shift

    def range(self, start: int, stop: int) -> tuple[int, int]:
        return self.point(start), self.point(stop, right=True)

    def new_length(self) -> int:
        return self.length + sum(size - (stop - start) for start, stop, size in self.edits)


def compose(first: OffsetMap, second: OffsetMap):
    """Maps points through both in turn."""
    return lambda p, right=False: second.point(first.point(p, right), right)
