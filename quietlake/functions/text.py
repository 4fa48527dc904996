"""Text helpers as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """What lies before each of the numbers (an array of ints) in sum, by blocks: copies no growing array."""
    zero = F.lit(0)
    total = lambda xs: F.aggregate(xs, zero, lambda acc, x: acc + x)
    count = F.greatest(F.ceil(F.size(numbers) / block).cast("int"), F.lit(1))
    sums = F.transform(F.sequence(zero, count - 1), lambda b: total(F.slice(numbers, b * block + 1, F.lit(block))))

    def places(both: Column) -> Column:
        before = F.transform(both["sums"], lambda _, b: total(F.slice(both["sums"], F.lit(1), b)))
        place = lambda before: F.transform(
            both["numbers"],
            lambda _, i: F.get(before, (i / block).cast("int")) + total(F.slice(both["numbers"], (i / block).cast("int") * block + 1, i % block)),
        )
        return let(before, place)

    return let(F.struct(numbers.alias("numbers"), sums.alias("sums")), places)


def spliced(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """text with each of the spans (sorted, apart; 0-based start, stop) replaced by new(span); copies each stretch once."""

    def pieces(all_: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.coalesce(F.get(all_, i - 1)["stop"], F.lit(0)))
            return F.concat(F.substr(text, begin + 1, s["start"] - begin), new(s))

        last = F.coalesce(F.try_element_at(all_, F.lit(-1))["stop"], F.lit(0))
        return F.concat(F.array_join(F.transform(all_, piece), ""), F.substr(text, last + 1, F.length(text)))

    return let(spans, lambda all_: F.when(F.size(all_) == 0, text).otherwise(pieces(all_)))


#: Entities in the order in which they are decoded; the ampersand last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#64;", "@"), ("&amp;", "&"))

DECODE_SQL = "{}"
for _a, _b in ENTITIES:
    DECODE_SQL = f"replace({DECODE_SQL}, '{_a}', '{_b if _b != chr(39) else chr(39) * 2}')"


def decode_entities(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def redact_evidence(value: Column, kind: str | Column) -> Column:
    """kind, length and the first 16 hex digits of the hash; never the value."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit(" len="), F.length(value).cast("string"), F.lit(" sha="), F.substring(F.sha2(value, 256), 1, 16))


def code_fences(text: Column) -> Column:
    """array<struct<line, inside>>: each line and whether it lies in a fenced block (fence lines do)."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<line:string,inside:boolean>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s{0,3}(```|~~~)")
        inside = acc["open"] | fence
        return F.struct((acc["open"] != fence).alias("open"), F.concat(acc["out"], F.array(F.struct(line.alias("line"), inside.alias("inside")))).alias("out"))

    return F.aggregate(lines, start, step)["out"]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def domain_matches(host: Column, domain: Column) -> Column:
    """The domain itself or one of its subdomains."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first differing character, -1 if there is none, null if a text is null: equal beginnings are halved, no array of characters."""
    n = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(30), F.lit(0), F.lit(-1))

    def step(same: Column, bit: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), bit)
        # what is equal up to `same` is not compared again
        more = (same + size <= n) & (F.substr(a, same + 1, size) == F.substr(b, same + 1, size))
        return F.when(more, same + size).otherwise(same)

    return F.when(a == b, -1).when(a.isNotNull() & b.isNotNull(), F.aggregate(steps, F.lit(0), step))
