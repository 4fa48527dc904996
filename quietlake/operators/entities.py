"""What follows any tagger of entities: windows, tags, overlaps, growth and rejection of spans. Needs no model."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import PLACEHOLDER, java
from ..functions.text import let

#: Tags of common taggers and what they stand for here.
TAGS = {"PER": "NAME", "PERSON": "NAME", "ORG": "ORG", "GPE": "ADDR", "LOC": "ADDR", "FAC": "ADDR"}
#: Endings of the names of organisations and of regions.
ORG_ENDINGS = "有限公司|股份公司|公司|集团|银行|医院|大学|学院|研究所|委员会"
REGION_ENDINGS = "特别行政区|自治区|自治州|自治县|省|市|县|区|州"
HAN = r"[\x{4e00}-\x{9fff}]"
SPAN = "array<struct<start:int,stop:int,label:string>>"


def category(tag: Column) -> Column:
    """NAME, ORG or ADDR of a tag, with or without the letter of its position (B-, I-, E-, S-); null for others."""
    bare = F.regexp_replace(F.upper(tag), "^[BIES]-", "")
    return F.create_map(*[F.lit(x) for p in TAGS.items() for x in p])[bare]


def without_text(text: Column) -> Column:
    """Whether a text has nothing for a tagger: no Han character is left once its placeholders are gone."""
    return ~F.coalesce(F.regexp_replace(text, java(PLACEHOLDER), "").rlike(HAN), F.lit(False))


def windows(text: Column, size: int = 400, step: int = 350) -> Column:
    """array<struct<start, text>>: overlapping windows that hold a Han character; a text shorter than a window is one."""
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substr(text, i * step + 1, F.lit(size)).alias("text")))
    return F.coalesce(F.filter(cut, lambda w: w["text"].rlike(HAN)), F.array().cast("array<struct<start:int,text:string>>"))


def segments(text: Column, size: int = 4000, back: int = 64) -> Column:
    """array<string>: parts of at most `size` characters on a fixed grid, each cut moved back to the end of a sentence within `back` characters."""
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")

    def edge(i: Column) -> Column:
        near = F.substr(text, i * size - back + 1, F.lit(back))
        after = F.length(F.regexp_extract(near, r"[。！？.!?\n]([^。！？.!?\n]*)$", 1))
        found = near.rlike(r"[。！？.!?\n]")
        return F.when((i == 0) | (i == count), F.least(i * size, F.length(text))).when(found, i * size - after).otherwise(i * size)

    def parts(edges: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.substr(text, F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i)))

    return let(F.transform(F.sequence(F.lit(0), count), edge), parts)


def clipped(spans: Column) -> Column:
    """Overlapping spans cut at the end of those before them; what is left of none goes. spans: SPAN."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["label"].alias("label"))))

    def cut(all_: Column) -> Column:
        before = lambda i: F.coalesce(F.array_max(F.transform(F.slice(all_, F.lit(1), i), lambda s: s["stop"])), F.lit(0))
        each = F.transform(all_, lambda s, i: F.struct(F.greatest(s["start"], before(i)).alias("start"), s["stop"].alias("stop"), s["label"].alias("label")))
        return F.filter(each, lambda s: s["start"] < s["stop"])

    return let(ordered, cut)


def bare_region(value: Column) -> Column:
    """The name of a region only, such as a province or a city, which tells nobody's address."""
    return F.coalesce(value.rlike(rf"^{HAN}{{2,6}}(?:{REGION_ENDINGS})$") & ~value.rlike("[0-9号路街弄室栋]"), F.lit(False))


def grown(text: Column, spans: Column) -> Column:
    """Organisations grown over their endings, addresses over door numbers; bare regions dropped. spans: SPAN."""

    def one(s: Column) -> Column:
        after = F.substr(text, s["stop"] + 1, F.lit(16))
        more = F.when(s["label"] == "ORG", F.regexp_extract(after, rf"^{HAN}{{0,4}}?(?:{ORG_ENDINGS})", 0)).when(
            s["label"] == "ADDR", F.regexp_extract(after, r"^[0-9A-Za-z一二三四五六七八九十-]{1,8}(?:号|弄|室|栋|楼|单元|层)(?:[0-9A-Za-z-]{1,6}(?:号|室|楼|层))?", 0)
        )
        return F.struct(s["start"].alias("start"), (s["stop"] + F.length(F.coalesce(more, F.lit("")))).alias("stop"), s["label"].alias("label"))

    out = F.transform(spans, one)
    value = lambda s: F.substr(text, s["start"] + 1, s["stop"] - s["start"])
    return F.filter(out, lambda s: ~((s["label"] == "ADDR") & bare_region(value(s))))


def addresses_joined(text: Column, spans: Column, gap: int = 6) -> Column:
    """Addresses at most `gap` characters apart without punctuation between them as one. spans: SPAN, sorted and apart."""

    def near(a: Column, b: Column) -> Column:
        between = F.substr(text, a["stop"] + 1, b["start"] - a["stop"])
        return (a["label"] == "ADDR") & (b["label"] == "ADDR") & (b["start"] - a["stop"] <= gap) & ~between.rlike(r"[，。；、,.;!?！？\n]")

    def join(all_: Column) -> Column:
        heads = F.filter(F.transform(all_, lambda s, i: F.when((i == 0) | ~near(F.get(all_, i - 1), s), i)), lambda i: i.isNotNull())

        def runs(h: Column) -> Column:
            def run(first: Column, i: Column) -> Column:
                last = F.coalesce(F.get(h, i + 1), F.size(all_)) - 1
                return F.struct(F.get(all_, first)["start"].alias("start"), F.get(all_, last)["stop"].alias("stop"), F.get(all_, first)["label"].alias("label"))

            return F.transform(h, run)

        return let(heads, runs)

    return let(spans, join)


def preferred(certain: Column, guessed: Column) -> Column:
    """Spans of rules and those guessed ones that overlap none of them. Both: SPAN."""
    free = F.filter(guessed, lambda g: ~F.exists(certain, lambda c: (c["start"] < g["stop"]) & (g["start"] < c["stop"])))
    return F.array_sort(F.concat(certain, free))


def without_rejected(found: DataFrame, rejected: DataFrame, id_column: str) -> DataFrame:
    """Rows (id, start, value) less those that a rejected one (id, start, value) of the same place is the beginning of."""
    r = rejected.select(F.col(id_column).alias("_i"), F.col("start").alias("_s"), F.col("value").alias("_v"))
    on = (F.col(id_column) == F.col("_i")) & (F.col("start") == F.col("_s")) & F.startswith(F.col("value"), F.col("_v"))
    return found.join(r, on, "left_anti")


def masked_run(run: Column) -> Column:
    """Whether a run of 11 digits or more, as recognition gives it without its spaces, holds a mobile number, an old or a new identity card: the whole run or a window of 18, 15 or 11 digits."""
    from ..functions import validators as V

    ok = lambda v, n: V.cn_mobile_ok(v) if n == 11 else V.id_card_ok(v)
    out = F.when(F.length(run) == 11, ok(run, 11)).when(F.length(run).isin(15, 18), ok(run, 15)).otherwise(F.lit(False))
    def window(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1)))
        return (F.length(run) >= n) & F.exists(places, lambda i: ok(F.substr(run, i, F.lit(n)), n))

    for n in (18, 15, 11):
        out = out | window(n)
    return F.coalesce(out & run.rlike("^[0-9]{10,}[0-9Xx]$"), F.lit(False))


def _differences(texts: pd.Series, masked: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(texts, masked):
        edits = [] if a is None or b is None else difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        out.append([{"start": i, "stop": j, "token": b[k:m]} for tag, i, j, k, m in edits if tag != "equal"])
    return pd.Series(out)


def spans_from_mask(text: Column, masked: Column) -> Column:
    """array<struct<start, stop, token>>: what was replaced, from a text and its masked form where only these are left."""
    return F.pandas_udf(_differences, "array<struct<start:int,stop:int,token:string>>")(text, masked)
