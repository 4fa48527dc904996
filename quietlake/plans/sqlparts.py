"""The detectors' rules in DuckDB SQL, for the oracles: the same patterns, validators written out again."""

from __future__ import annotations

from ..functions import detect as D
from ..functions import validators as V
from ..operators import tokens as T

#: The default rules and all classes of addresses.
LABELS = (
    "PRIVATEKEY", "CONNSTR", "JWT", "SECRET", "TOKEN", "ACCESSKEY", "APIKEY", "EMAIL", "IP_PRIVATE", "IP_INTERNAL", "IP_PUBLIC", "IDCARD", "PHONE", "CARD",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(d: str) -> str:
    v = f"CAST({d}[zz] AS INTEGER)"
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda zz: CASE WHEN (length({d}) - zz) % 2 = 1 "
        f"THEN 2 * {v} - CASE WHEN {v} > 4 THEN 9 ELSE 0 END ELSE {v} END)) % 10 = 0)"
    )


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def card_ok(v: str) -> str:
    shapes = ["[0-9]{13,19}"]
    for s in " -":
        shapes += [f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}(?:{s}[0-9]{{3}})?", f"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}"]
    shape = "^(?:" + "|".join(shapes) + ")$"
    return f"(regexp_matches({v}, '{shape}') AND regexp_matches({digits(v)}, '^[3-6]') AND {luhn(digits(v))})"


def ipv4_ok(v: str) -> str:
    shape = r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"
    return f"(regexp_matches({v}, '{shape}') AND list_max(list_transform(string_split({v}, '.'), lambda o: TRY_CAST(o AS BIGINT))) <= 255)"


def ip_class(v: str) -> str:
    a, b, c = (f"TRY_CAST(split_part({v}, '.', {i}) AS BIGINT)" for i in (1, 2, 3))
    return f"""CASE WHEN NOT {ipv4_ok(v)} THEN NULL
      WHEN ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 100 AND {b} BETWEEN 64 AND 127) THEN 'IP_PRIVATE'
      WHEN {a} = 10 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) THEN 'IP_INTERNAL'
      WHEN {a} IN (0, 127) OR {a} >= 224 OR ({a} = 192 AND {b} = 0 AND {c} IN (0, 2)) OR ({a} = 198 AND {b} IN (18, 19))
        OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113)
        OR {v} IN {V.PUBLIC_DNS} OR regexp_matches({v}, '{V.VERSION_LIKE}') THEN NULL
      ELSE 'IP_PUBLIC' END"""


def id_card_ok(v: str) -> str:
    total = " + ".join(f"coalesce(TRY_CAST(substr({v}, {i + 1}, 1) AS INTEGER), 0) * {w}" for i, w in enumerate(V.ID_WEIGHTS))
    day = lambda d: f"(try_strptime({d}, '%Y%m%d') IS NOT NULL AND {d} BETWEEN '18000101' AND '21001231')"
    region = f"TRY_CAST(substr({v}, 1, 2) AS INTEGER) IN {V.PROVINCES}"
    long = f"(regexp_matches({v}, '^[0-9]{{17}}[0-9Xx]$') AND {day(f'substr({v}, 7, 8)')} AND upper(substr({v}, 18, 1)) = substr('{V.ID_CHECKS}', ({total}) % 11 + 1, 1))"
    born = f"('19' || substr({v}, 7, 6))"
    short = f"(regexp_matches({v}, '^[0-9]{{15}}$') AND {day(born)})"
    return f"({region} AND ({long} OR {short}))"


def cn_mobile_ok(v: str) -> str:
    core = "1[3-9][0-9](?:[0-9]{8}| [0-9]{4} [0-9]{4}|-[0-9]{4}-[0-9]{4})"
    shape = rf"^(?:(?:\+?86|0086|\(86\))[ -]?)?{core}$"
    return f"(regexp_matches({v}, '{shape}') AND len(list_distinct(string_split(right({digits(v)}, 11), ''))) > 1)"


IDENTIFIERS = (
    r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$",
    r"^_*[a-z][a-z0-9]*(?:_[a-z0-9]+)+$",
    r"^[a-z]+(?:[A-Z][a-z0-9]*)+$",
    r"^(?:[A-Z][a-z0-9]+){2,}$",
    r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$",
    r"^[A-Za-z_][A-Za-z0-9_.]*\(.*\)?$",
    r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$",
)


def code_identifier(v: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({v}, {quoted(p)})" for p in IDENTIFIERS) + ")"


def _rules(name: str) -> list:
    return [r for r in D.RULES if r.label == name]


def value(label_: str, m: str) -> str:
    """What is between head and tail of a candidate of this label."""
    cases = []
    for r in D.rules_for(LABELS):
        if r.keep or r.tail:
            v = f"regexp_replace({m}, {quoted('^' + r.keep)}, '')" if r.keep else m
            v = f"regexp_replace({v}, {quoted(r.tail)}, '')" if r.tail else v
            hit = f" AND regexp_matches({m}, {quoted('^' + r.keep)})" if r.keep else ""
            cases.append(f"WHEN {label_} = '{r.label}'{hit} THEN {v}")
    return f"(CASE {' '.join(cases)} ELSE {m} END)"


def head(label_: str, m: str) -> str:
    cases = [f"WHEN {label_} = '{r.label}' AND regexp_matches({m}, {quoted('^' + r.keep)}) THEN regexp_extract({m}, {quoted('^' + r.keep)})" for r in D.rules_for(LABELS) if r.keep]
    return f"(CASE {' '.join(cases)} ELSE '' END)"


def tail(label_: str, m: str) -> str:
    cases = [f"WHEN {label_} = '{r.label}' THEN regexp_extract({m}, {quoted(r.tail)})" for r in D.rules_for(LABELS) if r.tail]
    return f"(CASE {' '.join(cases)} ELSE '' END)"


def _jwt(v: str) -> str:
    part = f"replace(replace(split_part({v}, '.', 1), '-', '+'), '_', '/')"
    padded = f"rpad({part}, (ceil(length({part}) / 4.0) * 4)::INTEGER, '=')"
    return f"coalesce(TRY(json_extract_string(decode(from_base64({padded})), '$.alg')) IS NOT NULL, false)"


def label(m: str) -> str:
    """CASE expression: the label of a candidate, or null."""
    out = [f"WHEN regexp_matches({m}, {quoted('^' + D.PLACEHOLDER + '$')}) THEN NULL"]
    ips = False
    for r in D.rules_for(LABELS):
        if r.label.startswith("IP_"):
            if not ips:
                out.append(f"WHEN regexp_matches({m}, '^[0-9.]+$') AND ({ip_class(m)}) IS NOT NULL THEN {ip_class(m)}")
            ips = True
            continue
        v = f"regexp_replace({m}, {quoted('^' + r.keep)}, '')" if r.keep else m
        v = f"regexp_replace({v}, {quoted(r.tail)}, '')" if r.tail else v
        test = {
            "SECRET": f"regexp_matches({v}, '[0-9!@#$%^&*+/=_-]') AND NOT {code_identifier(v)}",
            "CONNSTR": f"NOT regexp_matches({v}, {quoted(V.TEMPLATE)}) AND NOT regexp_matches({v}, {quoted(V.TEMPLATE_WORDS)})",
            "JWT": _jwt(m), "IDCARD": id_card_ok(m), "PHONE": cn_mobile_ok(m), "CARD": card_ok(m),
        }.get(r.label, "true")
        out.append(f"WHEN regexp_matches({m}, {quoted('^(?:' + r.pattern + ')$')}) AND {test} THEN '{r.label}'")
    return f"CASE {' '.join(out)} END"


def fused() -> str:
    return quoted(D.fused(LABELS))


def hidden() -> str:
    """Pattern of what a refused candidate may hide."""
    return quoted(D.fused(D.inside(LABELS)))


def refused(m: str) -> str:
    return f"length({m}) >= {D.HIDING} AND NOT starts_with({m}, '{{{{') AND NOT contains({m}, '://') AND ({label(m)}) IS NULL"


def found(table: str = "documents", id_column: str = "doc_id", text: str = "text", extra: str = "") -> str:
    """CTEs: `cand` (one row per candidate with pos from 0) and `hits` (accepted ones: label, value)."""
    more = f", {extra}" if extra else ""
    return f"""
raw AS (SELECT {id_column}{more}, regexp_extract_all({text}, {fused()}) AS ms FROM {table} WHERE {text} IS NOT NULL),
whole AS (
  SELECT {id_column}{more}, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS nth FROM raw
),
split AS (SELECT {id_column}{more}, nth, CASE WHEN {refused('m')} THEN regexp_extract_all(m, {hidden()}) ELSE [m] END AS ms FROM whole),
cand AS (SELECT {id_column}{more}, unnest(ms) AS m, 1000000 * nth + generate_subscripts(ms, 1) AS nth FROM split),
labelled AS (SELECT *, {label('m')} AS label FROM cand),
hits AS (
  SELECT {id_column}{more}, nth, label, {value('label', 'm')} AS value
  FROM labelled WHERE label IS NOT NULL
)"""


def suffix(label_: str, value_: str, key: str, round_: str = "'0'") -> str:
    inner = f"sha256('{key}.i' || chr(31) || {label_} || chr(31) || {value_} || chr(31) || {round_})"
    outer = f"sha256('{key}.o' || {inner})"
    chars = [f"substr('bcdfghjkmnpqrstvwxz', CAST(('0x' || substr({outer}, {4 * i + 1}, 4)) AS INTEGER) % 19 + 1, 1)" for i in range(6)]
    return "(" + " || ".join(chars) + ")"


def token(label_: str, value_: str, key: str, round_: str = "'0'") -> str:
    return _written(label_, suffix(label_, value_, key, round_))


def mapping(values: str, key: str) -> str:
    """CTEs for WITH RECURSIVE, from distinct (label, value): `known` (label, value, token), no suffix twice.

    The first value of a suffix by label and value keeps it. The others try the next round's, all of
    them again, until each has one that no value had before.
    """
    return f"""
issued AS (SELECT label, value, {suffix('label', 'value', key)} AS s FROM (SELECT DISTINCT label, value FROM {values})),
nth AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY label, value) AS n FROM issued),
tries AS (
  SELECT 0 AS r, label, value, NULL::VARCHAR AS s, false AS won FROM nth WHERE n > 1
  UNION ALL
  SELECT r, label, value, s, won OR (first = 1 AND NOT taken AND s NOT IN (SELECT s FROM issued)) AS won FROM (
    SELECT *, row_number() OVER (PARTITION BY s, won ORDER BY label, value) AS first, bool_or(won) OVER (PARTITION BY s) AS taken FROM (
      SELECT r + 1 AS r, label, value, won, CASE WHEN won THEN s ELSE {suffix('label', 'value', key, '(r + 1)::VARCHAR')} END AS s FROM tries
      WHERE r < {T.ROUNDS} AND r < (SELECT CASE WHEN bool_and(won) THEN 0 ELSE {T.ROUNDS} END FROM tries)))
),
known AS (
  SELECT label, value, {_written('label', 's')} AS token FROM (
    SELECT label, value, s FROM nth WHERE n = 1 UNION ALL SELECT label, value, s FROM tries WHERE r = (SELECT max(r) FROM tries))
)"""


def _written(label_: str, suffix_: str) -> str:
    return f"('{{{{' || substr(replace({label_}, '_', ''), 1, 12) || '_' || {suffix_} || '}}}}')"
