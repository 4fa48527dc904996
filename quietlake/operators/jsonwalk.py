"""Nested JSON bodies as leaf tables, and which leaves may be scanned."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, spliced

#: Fields of the protocol that are never text of a user, outside business zones.
PROTOCOL_KEYS = ("role", "type", "model", "id", "name", "tool_call_id", "tool_use_id", "cache_control", "object", "finish_reason", "stop_reason", "media_type")
#: Keys whose whole value is business content, whatever its keys are called.
BUSINESS_KEYS = ("input", "arguments", "parameters_values")
#: Keys under which only natural-language fields are scanned.
DEFINITION_KEYS = ("tools", "functions", "response_format")
NATURAL_KEYS = ("description", "title", "examples", "example")
#: Block types of answers that are never restored: their content is bound to a signature.
SEALED_TYPES = ("thinking", "redacted_thinking", "reasoning.encrypted")
MAX_DEPTH = 24

LEAF = "array<struct<path:string,key:string,parent:string,role:string,type:string,kind:string,value:string,business:boolean,definition:boolean,depth:int>>"


def walk(body: str | None) -> list[dict] | None:
    """Leaves in document order; null if the body is no JSON or deeper than MAX_DEPTH (callers must then fail closed)."""
    try:
        tree = json.loads(body, object_pairs_hook=lambda pairs: ("obj", pairs), parse_float=lambda x: ("num", x), parse_int=lambda x: ("num", x))
    except (TypeError, ValueError, RecursionError):
        return None
    out, stack = [], [(tree, "$", "", "", None, None, False, False, 0)]
    while stack:
        node, path, key, parent, role, kind, business, definition, depth = stack.pop()
        if depth > MAX_DEPTH:
            return None
        if isinstance(node, tuple) and node[0] == "obj":
            own = dict(node[1])
            text = lambda k: own[k] if isinstance(own.get(k), str) else None
            role, kind = text("role") or role, text("type")
            below = [(v, f"{path}.{k}", k, key, role, kind, business or k in BUSINESS_KEYS, definition or k in DEFINITION_KEYS, depth + 1) for k, v in node[1]]
            stack += reversed(below)
        elif isinstance(node, list):
            below = [(v, f"{path}[{i}]", key, parent, role, kind, business, definition, depth + 1) for i, v in enumerate(node)]
            stack += reversed(below)
        else:
            number = isinstance(node, tuple)
            what = "number" if number else "string" if isinstance(node, str) else "null" if node is None else "boolean"
            value = node[1] if number else node if what == "string" else json.dumps(node)
            out.append({"path": path, "key": key, "parent": parent, "role": role, "type": kind, "kind": what, "value": value, "business": business, "definition": definition, "depth": depth})
    return out


_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?|-?[0-9][0-9.eE+-]*|true|false|null', re.S)


def literals(body: str) -> list[tuple[int, int]]:
    """Where the values (not the keys) stand in a JSON text, in its order, which is that of walk()."""
    return [m.span() for m in _SCALAR.finditer(body) if m.group(1) is None]


def _placed(body: str | None) -> list[dict] | None:
    found = walk(body)
    if found is None:
        return None
    return [x | {"start": a, "stop": b} for x, (a, b) in zip(found, literals(body))]


def _indexed(body: Column) -> Column:
    """The leaves of each body with their places, by structural index; made on call, since workers import this module without a session."""
    import pyarrow as pa

    from .structure import FIELDS, index, slices

    def work(bodies: pa.Array) -> pa.Array:
        found = [index(part, BUSINESS_KEYS, DEFINITION_KEYS, MAX_DEPTH) for part in slices(bodies)]
        return found[0] if len(found) == 1 else pa.concat_arrays(found)

    work.__annotations__ = {"bodies": pa.Array, "return": pa.Array}
    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int"}
    return F.arrow_udf(work, f"array<struct<{','.join(f'{n}:{kinds[t]}' for n, t in FIELDS)}>>")(body)


def rewritten(body: Column, masked: Callable[[Column], Column], fail_closed: bool = True) -> Column:
    """struct(body, changed, exempt, repeated): a JSON text in which the literals of leaves that masked() changes are replaced, and no other byte.

    masked: of a leaf's text. Numbers are masked in their decimal form and become strings. The
    opaque fields of carriers stay as they are, and exempt counts them. repeated counts the
    leaves under keys that their object has twice; each of them is masked where it stands, so that no
    reader of the body sees one that is not. A text that cannot be walked is masked as a whole
    if fail_closed, else left as it is (changed is null then).
    """
    from .tokens import json_escaped

    def splice(changed: Column, all_: Column) -> Column:
        quoted = lambda c: F.concat(F.lit('"'), json_escaped(c["new"]), F.lit('"'))
        exempt, twice = F.size(F.filter(all_, carried)), F.size(F.filter(all_, lambda x: x["repeated"]))
        return F.struct(spliced(body, changed, quoted).alias("body"), F.size(changed).alias("changed"), exempt.alias("exempt"), twice.alias("repeated"))

    def work(all_: Column) -> Column:
        mine = F.filter(all_, lambda x: scannable(x["key"], x["kind"], x["value"], x["business"], x["definition"]) & ~carried(x))
        each = F.transform(mine, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("old"), masked(x["value"]).alias("new")))
        return let(F.filter(each, lambda x: x["old"] != x["new"]), lambda changed: splice(changed, all_))

    none = lambda name: F.lit(None).cast("int").alias(name)
    whole = F.struct((masked(body) if fail_closed else body).alias("body"), none("changed"), none("exempt"), none("repeated"))
    return let(_indexed(body), lambda all_: F.when(all_.isNull(), whole).otherwise(work(all_)))


def leaves(body: Column) -> Column:
    """LEAF of each body; null for one that cannot be walked."""
    names = [f.split(":")[0] for f in LEAF[len("array<struct<") : -2].split(",")]
    return F.transform(_indexed(body), lambda x: F.struct(*[x[n].alias(n) for n in names]))


def leaf_table(bodies: DataFrame, id_column: str, body: str = "body") -> DataFrame:
    """One row per leaf. Bodies that cannot be walked give one row of kind 'unreadable' with the whole text."""
    walked = bodies.select(id_column, body, leaves(F.col(body)).alias("_l"))
    whole = F.array(F.struct(
        F.lit("$").alias("path"), F.lit("").alias("key"), F.lit("").alias("parent"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("type"),
        F.lit("unreadable").alias("kind"), F.col(body).alias("value"), F.lit(False).alias("business"), F.lit(False).alias("definition"), F.lit(0).alias("depth"),
    ))
    return walked.select(id_column, F.posexplode(F.coalesce("_l", whole)).alias("n", "l")).select(id_column, "n", "l.*")


def media(value: Column) -> Column:
    """Data URLs of media; textual types are scanned all the same."""
    textual = r"(?i)^data:(?:text/|application/(?:json|xml|javascript|[a-z.+-]*\+(?:json|xml))|image/svg)"
    return value.rlike(r"(?i)^data:[a-z]+/") & ~value.rlike(textual)


def scannable(key: Column, kind: Column, value: Column, business: Column, definition: Column) -> Column:
    """Strings and numbers; protocol fields only in business zones, definitions only in their natural-language fields."""
    content = kind.isin("string", "number", "unreadable") & ~media(value)
    return content & F.when(business, True).when(definition, key.isin(*NATURAL_KEYS)).otherwise(~key.isin(*PROTOCOL_KEYS))


def restorable(type_: Column) -> Column:
    return ~F.coalesce(type_.isin(*SEALED_TYPES), F.lit(False))


def duplicate_keys(leaf: DataFrame, id_column: str) -> DataFrame:
    """(id, path) that occur more than once in a body: it must be rewritten even if it is clean."""
    return leaf.groupBy(id_column, "path").agg(F.count("*").alias("n")).where("n > 1").select(id_column, "path")


#: The places where protocols carry opaque content, as (carrier, role, type, field).
CARRIERS = (
    ("thinking_block", "assistant", "thinking", "signature"),
    ("redacted_block", "assistant", "redacted_thinking", "data"),
    ("image_block", None, "image", "data"),
    ("document_block", None, "document", "data"),
    ("audio_block", None, "input_audio", "data"),
    ("reasoning_item", None, "reasoning", "encrypted_content"),
)


def carried(leaf: Column) -> Column:
    """Whether a leaf (a struct with key, role, type, value and business) is the opaque field of a carrier; never in business zones."""
    out = F.lit(False)
    for _, role, type_, field in CARRIERS:
        here = (leaf["type"] == type_) & (leaf["key"] == field)
        out = out | F.coalesce(here & (leaf["role"] == role) if role else here, F.lit(False))
    return out & ~leaf["business"] & (F.length(leaf["value"]) > 0)


def carriers(leaf: DataFrame) -> DataFrame:
    """leaf with the name of the carrier that it is the opaque field of, or null. Business zones have none."""
    spark = leaf.sparkSession
    known = spark.createDataFrame(list(CARRIERS), "carrier string, c_role string, c_type string, c_field string")
    on = (F.col("type") == F.col("c_type")) & (F.col("key") == F.col("c_field")) & (F.col("c_role").isNull() | (F.col("role") == F.col("c_role"))) & ~F.col("business") & (F.length("value") > 0)
    return leaf.join(F.broadcast(known), on, "left").drop("c_role", "c_type", "c_field")


def completeness(reasons: Column) -> Column:
    """Of a map reason -> count: complete, partial or blocked."""
    blocking = F.exists(F.map_keys(reasons), lambda k: k.isin("unreadable", "too_deep", "timeout"))
    return F.when(F.size(reasons) <= 0, "complete").when(blocking, "blocked").otherwise("partial")


def usage(body: Column) -> Column:
    """struct(prompt, completion, cache_read) from either of two vendors' spellings; null where absent."""
    number = lambda *paths: F.coalesce(*[F.get_json_object(body, p).try_cast("long") for p in paths])
    return F.struct(
        number("$.usage.prompt_tokens", "$.usage.input_tokens").alias("prompt"),
        number("$.usage.completion_tokens", "$.usage.output_tokens").alias("completion"),
        number("$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens").alias("cache_read"),
    )


def text_enums(values: Column) -> Column:
    """A tool's list of allowed values (JSON) with its strings only; null if it is no list."""
    each = F.try_parse_json(values).try_cast("array<variant>")
    return F.to_json(F.transform(F.filter(each, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")))


#: Efforts of reasoning that every service takes.
EFFORTS = ("low", "medium", "high")


def effort_hint(body: Column, status: Column) -> Column:
    """A hint where a request that was refused (400 or 422) asked for another effort of reasoning; the request itself is never changed."""
    asked = F.coalesce(F.get_json_object(body, "$.reasoning_effort"), F.get_json_object(body, "$.reasoning.effort"))
    return F.when(asked.isNotNull() & ~asked.isin(*EFFORTS) & status.isin(400, 422), F.concat(F.lit("reasoning effort "), asked))


def decision(reasons: Column, masked: Column, fail_closed: bool) -> Column:
    """Of a map reason -> count and the number of masked values: block (a blocking reason, gate closed), mask, or pass."""
    return F.when((completeness(reasons) == "blocked") & F.lit(fail_closed), "block").when(masked > 0, "mask").otherwise("pass")


def report(kind: str, reasons: Column, masked: Column, fail_closed: bool = True) -> Column:
    """struct(kind, decision, completeness, reason_codes) of an inspection: of kind mask, skip or restore."""
    made = decision(reasons, masked, fail_closed) if kind == "mask" else F.lit("pass")
    return F.struct(F.lit(kind).alias("kind"), made.alias("decision"), completeness(reasons).alias("completeness"), reasons.alias("reason_codes"))


def dialogue(parts: DataFrame, id_column: str) -> DataFrame:
    """(id, reasoning, answer) of streamed parts (id, seq, section, source, text): sections in order; of several copies of the reasoning that of one source, the first by name."""
    one = parts.where("section = 'reasoning'").groupBy(id_column).agg(F.min("source").alias("_one"))
    both = parts.join(one, id_column, "left").where("section <> 'reasoning' OR source = _one")
    line = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("seq", "text")))), lambda x: F.coalesce(x["text"], F.lit(""))), "").alias(s)
    return both.groupBy(id_column).agg(line("reasoning"), line("answer"))
