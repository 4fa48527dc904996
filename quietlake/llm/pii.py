"""Operator 7: personal data, by weak-supervision aggregation.

Every text is searched for candidate spans: the base shapes (always kept when valid) and looser
ones, such as card numbers inside a longer run, numbers without a plus, spelled-out addresses and
credentials after a keyword. Five labelers vote on each candidate: its own shape, a gazetteer
of cue words to its left, its neighbouring characters, a register of what such values may begin or
end with (top-level domains, address blocks, issuers, number plans, prefixes of keys), and values
of other kinds near it. Spark counts how often each pattern
of votes and features occurs over the whole table; expectation-maximisation on these counts
estimates the labelers' reliabilities, and its posteriors train a logistic span classifier on
the features. A pattern has a fixed number of values, so what reaches the driver is bounded by
a constant (PATTERNS), and the classifier's decision is a set of accepted patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]{1,63}){1,8}"
)
_SECRET = re.compile(
    r"(?i)\b(token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|id|key|hash)\b[\"']?\x20?[=:]\x20?([\"']?)([A-Za-z0-9_+/=-]{12,}+)"
)

#: Cue words of each kind, looked for among the words left of a candidate.
GAZETTEER = {
    "email": {"email", "mail", "e-mail", "contact", "write", "to", "from"},
    "ip": {"ip", "host", "server", "address", "addr", "from", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "pan"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "contact", "whatsapp"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "credential"},
}
#: Words to the left that speak against a kind.
AGAINST = {"version", "v", "chapter", "section", "fig", "figure", "page", "isbn", "commit", "sha", "hash", "checksum", "id", "order"}

#: Generic top-level domains; those of two letters are countries.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro example test invalid local".split())
#: Country calling codes by their first digits: zones with one code, and the two-digit codes; others have three digits.
CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]")
KEY_PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|glpat-|npm_|hf_|eyJ)")
#: Characters between a value and one of another kind that still count as near.
NEAR = 120

#: kind, votes of five labelers, valid, size, before, after, cue, register.
PATTERNS = 5 * 243 * 2 * 4 * 4 * 4 * 3 * 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """As the pattern finds them, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), True
            end = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four dotted numbers at a time from each maximal dotted run, as the pattern finds them."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            yield at, at + size, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at += size + 1


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 9:
            d = _digits(m.group())
            yield m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, valid) of every match of the four base patterns; invalid ones are no base spans."""
    out = []
    for kind, find in enumerate((_emails, _ips, _cards, _phones)):
        out += [(kind, s, e, ok) for s, e, ok in find(text)]
    return out


def _looser(text: str, base: list[tuple[int, int, int, bool]]) -> Iterator[tuple[int, int, int, bool, str]]:
    """Further candidates; the last value is the keyword of a credential."""
    for kind, s, e, ok in base:
        if kind == 2 and not ok and e - s >= 13:
            for m in _GROUPS.finditer(text, s, e):
                whole = (m.start() == s or text[m.start() - 1] in " -") and (m.end() == e or text[m.end()] in " -")
                yield 2, m.start(), m.end(), whole and luhn(_digits(m.group())), ""
    taken = [(s, e) for kind, s, e, ok in base if ok and kind in (2, 3)]
    for m in _LOCAL_PHONE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in taken):
            yield 3, m.start(), m.end(), True, ""
    if "at" in text:
        for m in _SPELLED.finditer(text):
            yield 0, m.start(), m.end(), True, ""
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            value = m.group(3)
            yield 4, m.start(3), m.end(3), any(c.isdigit() for c in value) and any(c.isalpha() for c in value), m.group(1).lower()


def _char(text: str, at: int) -> int:
    if at < 0 or at >= len(text) or text[at].isspace():
        return 0
    return 1 if text[at].isalpha() else 2 if text[at].isdigit() else 3


def _registered(kind: int, value: str) -> int:
    """1 if a register speaks for the value, -1 if it speaks against it, else 0."""
    if kind == 0:
        top = value[value.rfind(".") + 1 :].rstrip("]})").lower()
        return 1 if top in DOMAINS or (len(top) == 2 and top.isalpha()) else -1 if top.isdigit() else 0
    digits = _digits(value)
    if kind == 1:
        parts = [int(x.lstrip("0") or 0) if len(x.lstrip("0")) <= 3 else 999 for x in value.split(".")]
        return -1 if parts[0] in (0, 127) or parts[0] >= 224 or max(parts) < 10 else 1
    if kind == 2:
        return 1 if digits[0] in "3456" or "2221" <= digits[:4] <= "2720" else -1
    if kind == 3:
        if value.startswith("+"):
            return 1 if CALLING.match(digits) else -1
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    classes = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)
    return 1 if classes == 3 or KEY_PREFIX.match(value) else -1 if classes == 1 else 0


def _pattern(text: str, kind: int, s: int, e: int, valid: bool, keyword: str) -> tuple[int, int]:
    """(votes, features) of a candidate, each as one number; the last labeler's vote is still missing."""
    name = KINDS[kind]
    before, after = _char(text, s - 1), _char(text, e)
    left = [w.strip("()[]{}<>\"'.,;:=#*") for w in text[max(0, s - 48) : s].lower().split()[-3:]]
    if keyword:
        left = [keyword.replace("-", "_")]
    cue = 2 if any(w in GAZETTEER[name] for w in left) else 0 if any(w in AGAINST for w in left) else 1
    size = e - s
    shape = 1 if valid else -1
    if kind == 4 and valid:
        shape = 1 if size >= 20 else 0
    tight = before in (1, 2) or after in (1, 2)
    register = _registered(kind, text[s:e])
    votes = (((shape + 1) * 3 + cue) * 3 + (0 if tight else 2)) * 3 + register + 1
    bucket = 0 if size < 12 else 1 if size < 20 else 2 if size < 33 else 3
    return votes, (((((kind * 2 + valid) * 4 + bucket) * 4 + before) * 4 + after) * 3 + cue) * 3 + register + 1


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, features), base ones first."""
    base = base_spans(text)
    out = [(k, s, e, ok, *_pattern(text, k, s, e, ok, "")) for k, s, e, ok in base]
    ends: dict[int, int] = {}
    for k, s, e, ok, word in _looser(text, base):
        if s >= ends.get(k, 0):
            ends[k] = e
            out.append((k, s, e, False, *_pattern(text, k, s, e, ok, word)))
    order = sorted(range(len(out)), key=lambda i: out[i][1:3])
    near = [False] * len(out)
    for i, j in zip(order, order[1:]):
        if out[i][0] != out[j][0] and 0 <= out[j][1] - out[i][2] <= NEAR:
            near[i] = near[j] = True
    return [(k, s, e, ok, votes * 3 + (2 if near[i] else 1), features) for i, (k, s, e, ok, votes, features) in enumerate(out)]


_CANDIDATE = "array<struct<kind:int,start:long,stop:long,base:boolean,votes:int,features:int>>"


def detections(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns named in keep and `found`, the candidates of the text (null: empty)."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]))
    names = ("kind", "start", "stop", "base", "votes", "features")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [[dict(zip(names, c)) for c in candidates(t.as_py() or "")] for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], "found"])

    given = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = map_texts(given, work, f"{kinds}found {_CANDIDATE}", text="_text")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "found")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (p(vote | class) as class x labeler x 3, posterior of each pattern, prior).

    votes: pattern x labeler in 0, 1, 2 (against, abstain, for). Starts from the majority.
    """
    post = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
    post = np.where(votes[:, 0] == 0, np.minimum(post, 0.2), post)
    table_ = np.zeros((2, votes.shape[1], 3))
    prior = 0.5
    for _ in range(rounds):
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for j in range(votes.shape[1]):
                n = np.bincount(votes[:, j], w, 3) + 1.0
                table_[c, j] = n / n.sum()
        prior = float((counts @ post + 1) / (counts.sum() + 2))
        logs = [np.log(p) + sum(np.log(table_[c, j, votes[:, j]]) for j in range(votes.shape[1])) for c, p in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return table_, post, prior


def _one_hot(features: np.ndarray) -> np.ndarray:
    f = features.copy()
    columns = []
    for size in (3, 3, 4, 4, 4, 2, 5):
        columns.append(np.eye(size)[f % size])
        f = f // size
    kind, valid = columns[6], columns[5]
    cross = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(features), -1)
    return np.hstack([*columns[:5], cross(kind, valid), cross(kind, columns[0]), np.ones((len(features), 1))])


def train(found: DataFrame) -> list[int]:
    """Feature patterns that the span classifier accepts, learned from `found` of detections()."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.votes", "c.features").agg(F.count("*").alias("n"))
    rows = each.collect()
    if not rows:
        return []
    rows.sort()
    votes, features, n = (np.array(x) for x in zip(*rows))
    split = np.stack([votes // 3**i % 3 for i in (4, 3, 2, 1, 0)], 1)
    kinds = features // (2 * 4 * 4 * 4 * 3 * 3)
    post = np.zeros(len(rows))
    for k in np.unique(kinds):
        at = kinds == k
        post[at] = reliabilities(split[at], n[at].astype(float))[1]
    x, w = _one_hot(features), np.log1p(n.astype(float))
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge-penalised logistic regression on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (post - p)) - 0.1 * beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    valid = features // (4 * 4 * 4 * 3 * 3) % 2 == 1
    return sorted(set(features[(x @ beta > 0) & valid].tolist()))


def spans(accepted: list[int]) -> Column:
    """Of `found`: structs (kind, start, stop), sorted; base spans and those of accepted patterns."""
    ok = F.array(*[F.lit(a) for a in accepted]).cast("array<int>")
    chosen = F.filter("found", lambda c: c["base"] | F.array_contains(ok, c["features"]))
    return F.array_sort(F.transform(chosen, lambda c: F.struct(c["kind"], c["start"], c["stop"])))


def _digest(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["stop"].cast("string")))
    return F.array_join(each, ",")


def find(docs: DataFrame, keep: list[str] | None = None, materialise: bool = True) -> DataFrame:
    """docs' columns named in keep (doc_id if none), base (valid matches of the base patterns) and spans (all).

    Offsets are code points, ends exclusive. A null or empty text has none. Ties cannot arise:
    spans of a kind do not overlap. Repeated rows stay; an empty table gives no rows. With
    materialise the candidates (not the texts) are kept in the shared folder between training and use.
    """
    found = detections(docs, keep or ["doc_id"])
    if materialise:
        found = written(found, "candidates")
    accepted = train(found)
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), lambda c: F.struct(c["kind"], c["start"], c["stop"])))
    return found.select(*(keep or ["doc_id"]), base.alias("base"), spans(accepted).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """text with each span (of `spans`) replaced by its kind in brackets; overlapping ones, to the end of their union, by that of the longest (of equal ones the first)."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    by_start = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("s"), c["stop"].alias("e"), c["kind"].alias("k"))))
    merged = F.aggregate(by_start, F.filter(F.transform(by_start, _alone), lambda _: F.lit(False)), _merged)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, c: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (c["s"] - acc["at"]).cast("int")), F.lit("["), F.get(names, c["k"]), F.lit("]"))
        return F.struct(piece.alias("out"), c["e"].alias("at"))

    done = F.aggregate(merged, start, step)
    return F.when(F.size(found) <= 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def _alone(c: Column) -> Column:
    """A span of a union so far: its start, end, kind and the length of the span that gives the kind."""
    return F.struct(c["s"].cast("long").alias("s"), c["e"].cast("long").alias("e"), c["k"].alias("k"), (c["e"] - c["s"]).cast("long").alias("n"))


def _merged(acc: Column, c: Column) -> Column:
    last, now = F.try_element_at(acc, F.lit(-1)), _alone(c)
    kind = F.when(now["n"] > last["n"], now["k"]).otherwise(last["k"])
    both = F.struct(last["s"].alias("s"), F.greatest(last["e"], now["e"]).alias("e"), kind.alias("k"), F.greatest(last["n"], now["n"]).alias("n"))
    head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.when((F.size(acc) > 0) & (now["s"] < last["e"]), F.concat(head, F.array(both))).otherwise(F.concat(acc, F.array(now)))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    secrets = F.size(F.filter("spans", lambda c: c["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret")
    counts += [secrets, F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


QUERIES = {"op7_weak_supervision_pii": op7_weak_supervision_pii}
ORACLE_SQL: dict[str, str] = {}
