"""Detectors as one fused pattern over a text, with labels by Column validators.

Candidates are matches of one alternation, in the order of the rules: earlier rules win where
two begin at the same place, and a placeholder that is already there is passed over whole. Values
have no upper length: their characters are one class, matched possessively, so matching is linear
in the text. Cheap look-aheads (hints) pass over words at which no rule can begin. The pattern
runs once for each text: it marks the candidates, and the text is split at the marks. A candidate
that no validator accepts is searched once more for what it may hide (a phone number after another
number, say) by the rules with narrow patterns, and else left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names as N
from . import validators as V
from .text import let, prefix_sums

#: Marks candidates within a text: a code point that is no character.
MARK = "\ufdd0"

#: \b by ASCII word characters; Java 17's own also counts letters of other scripts.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

PLACEHOLDER = r"\{\{[A-Z0-9\x{4e00}-\x{9fff}]{1,12}_(?:[0-9a-f]{6}|[bcdfghjkmnpqrstvwxz]{6})\}\}"

_SECRET_HEAD = (
    r"(?:[A-Za-z0-9]{1,20}[_-]){0,3}(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|credential)"
    r"[\"']?[ \t]{0,4}(?:=|:|：)[ \t]{0,4}[\"']?"
)
_SECRET_HEAD_ZH = r"(?:密码|口令|令牌|密钥)[\"']?[ \t]{0,4}(?:=|:|：|是|为)[ \t]{0,4}[\"']?"


#: The default prefixes of credentials. Callers may have a list of their own, see with_prefixes().
SECRET_PREFIXES = (
    "sk-", "ah-", "ghp_", "glpat-", "xoxb-", "xoxp-", "pypi-", "npm_", "dify-", "sk-proj-", "sk-svcacct-", "sk-admin-", "sk-ant-", "sk-or-",
    "hf_", "gsk_", "xai-", "nvapi-", "pplx-", "dop_v1_", "SG.",
)

def java(pattern: str) -> str:
    """The same pattern for Java: ASCII word edges, and runs without an upper bound are never given back."""
    # before a group of patterns that all begin with a word character half of the test is enough
    out = pattern.replace(r"\b(?:", r"(?<![A-Za-z0-9_])(?:").replace(r"\b", _EDGE).replace("{1,63}@", "{1,63}+@")
    return re.sub(r"(\{[0-9]+,\})(?!\+)", r"\1+", out)


@dataclass(frozen=True)
class Rule:
    """label, pattern of the whole candidate, test of the value, patterns of what stands before and after the value and stays.

    hint: a cheap pattern that every candidate begins with (Java), for rules that begin a word.
    behind: characters that no candidate stands after (Java), for rules that begin elsewhere; keeps long runs linear.
    fold: values that differ by case only have one placeholder.
    """

    label: str
    pattern: str
    ok: Callable[[Column], Column] | None = None
    keep: str | None = None
    credential: bool = False
    enabled: bool = True
    tail: str | None = None
    hint: str | None = None
    fold: bool = False
    behind: str | None = None


def valid_prefixes(prefixes: Sequence[str]) -> list[str]:
    """Prefixes of letters, digits, dots, dashes and underscores, an @ before them or not; others are left out, repeated ones too."""
    return list(dict.fromkeys(p for p in prefixes if re.fullmatch(r"@?[A-Za-z0-9][A-Za-z0-9._-]*", p)))


def prefix_rules(prefixes: Sequence[str] = SECRET_PREFIXES) -> list[Rule]:
    """Rules for credentials that begin with one of the prefixes (dash and underscore are alike) and go on for 8 characters or more.

    A prefix with a dot may be followed by more dots. No rule for no (valid) prefix.
    """
    out = []
    for at, dot in ((False, False), (False, True), (True, False), (True, True)):
        given = [p for p in valid_prefixes(prefixes) if p.startswith("@") == at and p.endswith(".") == dot]
        kept = [p for p in given if not any(p != q and p.startswith(q) for q in given)]  # the shorter prefix finds what the longer one does
        if kept:
            any_of = "|".join(re.sub("[-_]", "[_-]", p.replace(".", r"\.")) for p in kept)
            tail = r"[A-Za-z0-9_.-]{8,}" if dot else r"[A-Za-z0-9_-]{8,}"
            out.append(Rule("APIKEY", rf"{'' if at else chr(92) + 'b'}(?:{any_of}){tail}", None, None, True, hint=None if at else rf"(?:{any_of})"))
    return out


def _secret_ok(v: Column) -> Column:
    return v.rlike(r"[0-9!@#$%^&*+/=_-]") & ~V.code_identifier(v)


def _ip(label: str) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(V.ip_class(v) == label, F.lit(False))


#: Four numbers and what would make them a version: a name before them, more parts or a suffix after them.
_IP = r"\b(?:[A-Za-z][A-Za-z0-9_]{0,40}[-_.])?[0-9]{1,10}(?:\.[0-9]{1,10}){1,9}(?:[-_.][A-Za-z0-9_]{1,40}){0,4}"
_DOTTED = r"[0-9]{1,10}(?:\.[0-9]{1,10}){1,9}"
#: An address behind digits belongs to their candidate as a whole: inside() finds it again, while half of it would be lost.
_ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,10}){3,9}"
_DIGITS = rf"\b(?:[0-9](?:[ -]?[0-9]){{6,30}}[ -]{_ADDRESS}|[0-9](?:[ -]?[0-9]){{9,30}})\b"
_SECRET = r"[A-Za-z0-9_+/=!@#$%^&*-]{8,}"
_CONN = r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:"
#: Shapes of vendors that are no prefixes of the list below; application ids need a digit.
_KEYS = r"pk|rk|gho|ghs|ghu|ghr|github_pat|xoxa"
_APPS = r"(?:cli_|ding)[a-z]{0,20}[0-9][a-z0-9]{5,}"

#: Characters before a region's letter on number plates (GA 36).
REGIONS = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"
_HAN = r"\x{4e00}-\x{9fff}"
#: What is said before an address in Chinese and belongs to no name.
_LEAD = r"(?:请|联系人|联系|邮箱|电邮|邮件|地址|发送|发|抄送|至|给|到|是|为|和|或|与|及){0,6}"
_DOMAIN = r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,}"

#: Hints: a digit, a word before an @ or an assignment, and the beginnings of credentials.
_DIGIT, _WORD = "[0-9]", r"[A-Za-z0-9._%+-]{0,100}+(?:@|[\"']?[ \t]{0,4}[=:：])"
_ALNUM = r"[A-Z]*+[0-9]"

_PREFIXED = tuple(prefix_rules())

#: In order of priority.
RULES: tuple[Rule, ...] = (
    Rule("PRIVATEKEY", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s{1,2}[A-Za-z-]{1,30}: [^\n]{0,200}){0,4}[A-Za-z0-9+/=\s]{1,}-----END [A-Z ]{0,20}PRIVATE KEY-----", credential=True),
    Rule("CONNSTR", rf"\b{_CONN}[^\s/@]{{1,}}@[A-Za-z0-9.-]{{1,128}}", V.connection_password_ok, _CONN, True, tail=r"@[A-Za-z0-9.-]{1,128}$", hint=_WORD),
    Rule("JWT", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", V.jwt_ok, None, True, hint="eyJ"),
    Rule("SECRET", rf"\b(?i:{_SECRET_HEAD}){_SECRET}", _secret_ok, rf"(?i:{_SECRET_HEAD})", True, hint=_WORD),
    Rule("SECRET", rf"{_SECRET_HEAD_ZH}{_SECRET}", _secret_ok, _SECRET_HEAD_ZH, True),
    Rule("TOKEN", r"\b(?i:bearer)[ \t]{1,4}[A-Za-z0-9._~+/=-]{16,}", None, r"(?i:bearer)[ \t]{1,4}", True, hint=r"(?i:bearer)[ \t]"),
    Rule("ACCESSKEY", r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|LTAI[0-9A-Za-z]{12,20}|AKID[0-9A-Za-z]{32}|AIza[0-9A-Za-z_-]{35})\b", None, None, True, hint="A[KSI]|LTAI"),
    *_PREFIXED,
    Rule("APIKEY", rf"\b(?:(?:{_KEYS})[_-][A-Za-z0-9_-]{{16,}}|{_APPS})", None, None, True, hint=rf"(?:{_KEYS})[_-]|cli_|ding"),
    Rule("EMAIL", rf"\b[A-Za-z0-9_][A-Za-z0-9._%+-]{{1,63}}@{_DOMAIN}", hint=_WORD),
    Rule("EMAIL", rf"[{_HAN}][A-Za-z0-9._%+{_HAN}-]{{1,63}}@{_DOMAIN}", None, _LEAD, behind=f"[{_HAN}]"),
    Rule("MAC", r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b", V.mac_ok, enabled=False, hint="[0-9A-Fa-f]{2}[:-]"),
    Rule("IPV6PRIVATE", r"(?i:fe[89ab][0-9a-f]|fd[0-9a-f]{2})(?::[0-9A-Fa-f]{0,4}){2,7}(?:%[A-Za-z0-9]{1,16})?", V.ipv6_private_ok, enabled=False, behind="[A-Za-z0-9_:.]"),
    Rule("IBAN", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", V.iban_ok, enabled=False, hint=_ALNUM),
    Rule("USCC", r"\b[0-9A-Z]{18}\b", V.uscc_ok, enabled=False, hint="[0-9A-Z]{18}"),
    Rule("IP_PRIVATE", _IP, _ip("IP_PRIVATE"), hint=rf"{_DIGIT}|[A-Za-z0-9_]{{1,50}}+[-_.][0-9]"),
    Rule("IP_INTERNAL", _IP, _ip("IP_INTERNAL"), enabled=False, hint=rf"{_DIGIT}|[A-Za-z0-9_]{{1,50}}+[-_.][0-9]"),
    Rule("IP_PUBLIC", _IP, _ip("IP_PUBLIC"), enabled=False, hint=rf"{_DIGIT}|[A-Za-z0-9_]{{1,50}}+[-_.][0-9]"),
    Rule("LANDLINE", rf"(?:{V.CODE}[ -]?{V.AREA}|{V.BRACKETS}|\b0[0-9]{{2,3}}[ -]){V.LOCAL}\b", V.landline_ok, enabled=False),
    Rule("IDCARD", r"\b(?:[0-9]{17}[0-9Xx]|[0-9]{15})\b", V.id_card_ok, hint=_DIGIT),
    Rule("PHONE", r"\b(?:(?:00)?86[ -]?)?1[3-9][0-9](?:[0-9]{8}| [0-9]{4} [0-9]{4}|-[0-9]{4}-[0-9]{4})\b", V.cn_mobile_ok, hint=_DIGIT),
    Rule("CARD", _DIGITS, V.card_ok, hint=_DIGIT),
    Rule("HKID", r"\bH[0-9]{8}\b", V.hkid_ok, enabled=False, hint="H[0-9]"),
    Rule("PLATE", rf"[{REGIONS}][A-HJ-NP-Z][A-HJ-NP-Z0-9]{{5,6}}\b", V.plate_ok, enabled=False),
    Rule("HIGHENTROPY", r"\b[A-Za-z0-9_+/=-]{20,}", V.high_entropy, None, True, enabled=False, hint="[A-Za-z0-9_+/=-]{20}"),
    Rule("NAME", rf"(?:{'|'.join(N.STRONG_LEFT)})(?:是|为|：|:|\s){{0,2}}(?:{N.PATTERN})", N.name_ok, rf"(?:{'|'.join(N.STRONG_LEFT)})(?:是|为|：|:|\s){{0,2}}", enabled=False),
    Rule("NAME", rf"(?:{N.SHORT})(?:{'|'.join(N.STRONG_RIGHT)})", N.name_ok, enabled=False, tail=rf"(?:{'|'.join(N.STRONG_RIGHT)})$"),
)
LABELS = tuple(dict.fromkeys(r.label for r in RULES))
CREDENTIALS = tuple(dict.fromkeys(r.label for r in RULES if r.credential))

#: What callers choose rules by: labels, rules of their own, or both; None for the default ones.
Chosen = Sequence["str | Rule"] | None


def rules_for(chosen: Chosen = None) -> list[Rule]:
    """Own rules first, then the named ones in order of priority; those enabled by default if none are named."""
    if chosen is None:
        return [r for r in RULES if r.enabled]
    own = [c for c in chosen if isinstance(c, Rule)]
    return own + [r for r in RULES if r.label in [c for c in chosen if isinstance(c, str)]]


def with_prefixes(prefixes: Sequence[str], chosen: Chosen = None) -> list[Rule]:
    """The chosen rules with these prefixes of credentials in place of the default ones, at their priority; [] turns prefixes off."""
    rules = rules_for(chosen)
    at = next((i for i, r in enumerate(rules) if r in _PREFIXED), len(rules))
    rest = lambda rs: [r for r in rs if r not in _PREFIXED]
    return [*rest(rules[:at]), *prefix_rules(prefixes), *rest(rules[at:])]


def fused(chosen: Chosen = None, hints: bool = False) -> str:
    """One alternation: placeholders, patterns that begin anywhere, and those that begin a word under one test for that."""
    rules = rules_for(chosen)
    patterns = list(dict.fromkeys(r.pattern for r in rules))
    words = [p[2:].replace(r"|\b", "|") for p in patterns if p.startswith(r"\b")]
    given = [r.hint for r in rules if r.pattern.startswith(r"\b")]
    ahead = f"(?={'|'.join(dict.fromkeys(given))})" if hints and all(given) else ""
    behind = {r.pattern: f"(?<!{r.behind})" for r in rules if hints and r.behind}
    return "|".join([PLACEHOLDER, *(behind.get(p, "") + p for p in patterns if not p.startswith(r"\b")), *([rf"\b(?:{ahead}(?:{'|'.join(words)}))"] if words else [])])


#: Rules whose candidates may be wider than a value, and those that are not tried again within what they refused.
_WIDE = ("JWT", "SECRET", "IP_PRIVATE", "IP_INTERNAL", "IP_PUBLIC", "CARD")
_NOT_AGAIN = ("PRIVATEKEY", "CONNSTR", "NAME", *_WIDE)
#: Addresses within others. What makes four numbers a version comes first and is passed over, and so is a card number in groups with
#: its address: without lookahead, which SQL lacks, it is like one before any number, and masking one of the two would show the other.
_GROUPED = r"(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}(?: [0-9]{3})?|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}(?:-[0-9]{3})?|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})"
_IP_WITHIN = rf"\b(?:[A-Za-z][A-Za-z0-9_]{{0,40}}[-_.]{_DOTTED}|{_DOTTED}(?:[-_]{_DOTTED}){{1,4}}|{_DOTTED}[-_]|{_ADDRESS}\.|{_ADDRESS}\b)"
#: Characters that a candidate has at least if it hides a value: a number's 11 and one more.
HIDING = 12


def inside(chosen: Chosen = None) -> list[Rule]:
    """Rules for what a refused candidate hides; none if no wide rule is chosen. A card number behind other numbers must be one run."""
    rules = rules_for(chosen)
    if not any(r.label in _WIDE for r in rules):
        return []
    cards = [replace(r, pattern=r"\b[0-9]{13,19}\b") for r in rules if r.label == "CARD"]
    ips = [replace(r, pattern=p) for r in rules if r.label.startswith("IP_") and cards for p in (rf"^{_GROUPED}[ -]{_ADDRESS}$", _IP_WITHIN)]
    return [r for r in rules if r.label not in _NOT_AGAIN] + ips + cards


def parts(text: Column, chosen: Chosen = None) -> Column:
    """array<string>: what stands between the candidates at even places, the candidates at odd ones.

    A refused candidate that hides others gives way to an empty one, its own parts and another empty one.
    """
    first, within = _parts(text, chosen), inside(chosen)
    if not within:
        return first

    def again(m: Column) -> Column:
        def hidden(found: Column) -> Column:
            more = (F.size(found) > 1) & (F.get(found, F.lit(1)) != m)
            return F.when(more & _label(m, chosen).isNull(), F.concat(F.array(F.lit("")), found, F.array(F.lit("")))).otherwise(F.array(m))

        may = (F.length(m) >= HIDING) & ~F.startswith(m, F.lit("{{")) & ~F.contains(m, F.lit("://"))
        return F.when(may, let(_parts(m, within), hidden)).otherwise(F.array(m))

    return F.flatten(F.transform(first, lambda p, i: F.when(i % 2 == 1, again(p)).otherwise(F.array(p))))


def _parts(text: Column, chosen: Chosen) -> Column:
    pattern = java(fused(chosen, hints=True))
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.flatten(F.transform(F.split(text, pattern, -1), lambda g, i: F.array(g, F.get(found, i))))
    # a text that holds the mark itself is searched twice instead
    return F.when(F.contains(text, F.lit(MARK)), F.slice(apart, F.lit(1), F.greatest(F.size(apart) - 1, F.lit(0)))).otherwise(marked)


def _label(match: Column, chosen: Chosen) -> Column:
    """Label of a candidate by the first rule that accepts it, else null; each rule is evaluated once."""
    rules = rules_for(chosen)
    ips = [r.label for r in rules if r.label.startswith("IP_")]
    out = F.when(match.rlike(java(f"^{PLACEHOLDER}$")), F.lit(None).cast("string"))
    done = False
    for r in rules:
        if r.label in ips:
            if not done:
                kind = V.ip_class(match)
                out, done = out.when(match.rlike(r"^[0-9.]+$") & F.coalesce(kind.isin(*ips), F.lit(False)), kind), True
            continue
        whole = match.rlike(java(f"^(?:{r.pattern})$"))
        v = F.regexp_replace(match, java(f"^{r.keep}"), "") if r.keep else match
        v = F.regexp_replace(v, r.tail, "") if r.tail else v
        out = out.when(whole & r.ok(v) if r.ok else whole, r.label)
    return out


def _split(c: Column, chosen: Chosen) -> Column:
    """match and label with head and tail: what stays before and after the value."""
    head, tail = F.lit(""), F.lit("")
    for r in rules_for(chosen):
        mine = c["label"] == r.label
        if r.keep:
            found = F.regexp_extract(c["match"], java(f"^{r.keep}"), 0)
            head = F.when(mine & (found != ""), found).otherwise(head)
        if r.tail:
            found = F.regexp_extract(c["match"], r.tail, 0)
            tail = F.when(mine & (found != ""), found).otherwise(tail)
    known = lambda x: F.when(c["label"].isNull(), "").otherwise(x)
    return F.struct(c["match"].alias("match"), c["label"].alias("label"), known(head).alias("head"), known(tail).alias("tail"))


def _value(c: Column) -> Column:
    size = F.length(c["match"]) - F.length(c["head"]) - F.length(c["tail"])
    value = F.substr(c["match"], F.length(c["head"]) + 1, size)
    return F.struct(c["match"].alias("match"), c["label"].alias("label"), c["head"].alias("head"), value.alias("value"), c["tail"].alias("tail"))


def candidates_of(pieces: Column, chosen: Chosen) -> Column:
    found = F.filter(pieces, lambda _, i: i % 2 == 1)
    labelled = F.transform(found, lambda m: F.struct(m.alias("match"), _label(m, chosen).alias("label")))
    return F.transform(F.transform(labelled, lambda c: _split(c, chosen)), _value)


def candidates(text: Column, chosen: Chosen = None) -> Column:
    """array<struct<match, label, head, value, tail>> of every candidate, in order; a null label means that it stays as it is."""
    return F.coalesce(candidates_of(parts(text, chosen), chosen), F.array().cast("array<struct<match:string,label:string,head:string,value:string,tail:string>>"))


def detect(text: Column, chosen: Chosen = None) -> Column:
    """array<struct<start, stop, label, value>>: accepted values with 0-based code points, ends exclusive; none for a null text."""

    def spans(pieces: Column) -> Column:
        def each(both: Column) -> Column:
            begins, found = both["begins"], both["found"]

            def one(c: Column, i: Column) -> Column:
                start = F.get(begins, 2 * i + 1) + F.length(c["head"])
                return F.struct(start.alias("start"), (start + F.length(c["value"])).alias("stop"), c["label"].alias("label"), c["value"].alias("value"))

            return F.filter(F.transform(found, one), lambda s: s["label"].isNotNull())

        return let(F.struct(prefix_sums(F.transform(pieces, F.length)).alias("begins"), candidates_of(pieces, chosen).alias("found")), each)

    return F.coalesce(let(parts(text, chosen), spans), F.array().cast("array<struct<start:int,stop:int,label:string,value:string>>"))


def replaced(text: Column, token: Callable[[Column], Column], chosen: Chosen = None) -> Column:
    """text with the value of each accepted candidate c replaced by token(c)."""
    return replaced_parts(parts(text, chosen), token, chosen)


def replaced_parts(pieces: Column, token: Callable[[Column], Column], chosen: Chosen = None) -> Column:
    """The same from parts() of the text."""

    def new(both: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            c = F.get(both["found"], ((i - 1) / 2).cast("int"))
            return F.when((i % 2 == 0) | c["label"].isNull(), p).otherwise(F.concat(c["head"], token(c), c["tail"]))

        return F.array_join(F.transform(both["pieces"], piece), "")

    # a test of pieces outside would search the text twice
    return let(pieces, lambda p: F.when(p.isNotNull(), let(F.struct(p.alias("pieces"), candidates_of(p, chosen).alias("found")), new)))
