"""One pass over an answer for all audit signals: every hit, with where it stands.

A text is split at its code fences; every other piece is code. One pattern made of all kinds
marks candidates in each piece; only these are looked at kind by kind. What the request holds
already is no finding. All is Column code: no shuffle, no Python. Patterns repeat no group without
bound, and what they skip over ends at a character with which the next match may begin or after
some hundred characters, so that no text takes more than linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, redact_evidence
from ..functions.validators import entropy, ordered_sequence

#: Public shapes of secrets, (kind, severity in an error body, pattern).
SECRETS = (
    ("api_key", "CRITICAL", r"\bsk-[A-Za-z0-9_-]{20,}+"),
    ("bearer", "CRITICAL", r"\bBearer[ \t]++[A-Za-z0-9._~+/-]{20,}+=*+"),
    ("aws_key", "CRITICAL", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("private_key", "CRITICAL", r"-----BEGIN[A-Z \-]{0,40}PRIVATE KEY-----"),
    ("google_key", "HIGH", r"\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    ("url_key", "HIGH", r"[?&]key=[A-Za-z0-9_-]{25,}+"),
    ("oauth", "HIGH", r"\bya29\.[A-Za-z0-9_.~+/-]{20,}+"),
    ("jwt", "HIGH", r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+"),
    ("connection_string", "HIGH", r"\b[a-z][a-z0-9+.-]{1,30}://[^\s'\"/@:]*+:[^\s'\"@]{1,512}+@"),
)
#: An assignment of a credential by the shape of its name; its value decides.
ENVIRONMENT = r"\b[A-Z][A-Z0-9_]{0,120}_(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIALS?)\b\s{0,4}[=:]\s{0,4}[^\s'\"`,;\]}]++"
#: What an error body tells about the machine.
TRACES = (
    ("home_path", r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9._-]++"),
    ("stack_frame", r"(?:File \"[^\"\n]++\", line [0-9]++|\bat [A-Za-z0-9_.$<>]++\([A-Za-z0-9_.]++:[0-9]++\))"),
)
#: A value is a sample if it is shorter than this or has at most this entropy.
LEAST_LENGTH, LEAST_ENTROPY = 20, 3.0
#: Zero-width characters from which on they are a finding.
ZERO_WIDTH = 8
#: (kind, pattern) of commands that destroy, publish or spend; all of them LOW.
ACTIONS = (
    ("filesystem", r"\brm[ \t]++(?:-[a-zA-Z-]++[ \t]++){0,8}?-[a-zA-Z]*?[rR][a-zA-Z]*+[ \t]++[/~*.$][^\s;&|]*+"),
    ("disk", r"\b(?:mkfs(?:\.[a-z0-9]++)?[ \t]|dd[ \t][^\n;|]{0,400}?\bof=/dev/[a-z0-9]++|shred[ \t]++-)"),
    ("database", r"(?i:\b(?:drop[ \t]++(?:table|database|schema)|truncate[ \t]++table|delete[ \t]++from[ \t]++[a-z0-9_.]++[ \t]*+;))"),
    ("version_control", r"\bgit[ \t]++(?:push[ \t][^\n;|]{0,400}?(?:--force\b|-f\b)|reset[ \t]++--hard|clean[ \t]++-[a-z]*f)"),
    ("infrastructure", r"\b(?:terraform[ \t]++destroy|kubectl[ \t]++delete|docker[ \t]++system[ \t]++prune)\b"),
    ("remote_execution", r"\b(?:curl|wget)[ \t][^\n|]{0,400}+\|[ \t]*+(?:sudo[ \t]++)?(?:ba|z|da)?sh\b"),
    ("resources", r":\(\)[ \t]*+\{[ \t]*+:\|:&[ \t]*+\};:"),
)
#: Turn markers of chat templates, headings that pose as a system's, and instructions. A marker behind a line's beginning (with its line feed) is anchored.
MARKER = r"(?:<\|(?:im_start|im_end|system|user|assistant|eot_id)\|>|\[/?INST\]|<<SYS>>|</?s>)"
INSTRUCTIONS = (
    ("system_heading", r"(?i:\n[ \t]{0,8}#{1,4}[ \t]*+system(?:[ \t]++(?:prompt|message|instructions?))?[ \t]*+:?(?=\n|\z))"),
    ("prompt_extraction", r"(?i:\b(?:reveal|print|repeat|show|output|disclose)[ \t]++(?:me[ \t]++)?(?:all[ \t]++of[ \t]++)?(?:your|the)[ \t]++(?:hidden[ \t]++|full[ \t]++|initial[ \t]++)?(?:system[ \t]++)?prompt\b)"),
    ("credential_exfil", r"(?i:\b(?:send|post|upload|email|forward)[ \t]++(?:me[ \t]++)?(?:your|the|all|any)[ \t]++(?:[a-z]++[ \t]++){0,3}?(?:api[ _-]?keys?|passwords?|tokens?|credentials?|secrets?)\b)"),
)
OVERRIDE = r"(?i:\b(?:ignore|disregard|forget)[ \t]++(?:all[ \t]++)?(?:of[ \t]++)?(?:your[ \t]++|the[ \t]++)?(?:previous|prior|above|earlier)[ \t]++(?:instructions?|rules|messages?)\b)"
#: Images and styles that a reader fetches by itself, with 24 characters and more of data in their address.
FETCH = r"(?:!\[[^\[\]\n]*+\]\(|(?i:<img\b[^<>\n]*?\bsrc[ \t]*+=[ \t]*+[\"']?))https?://[^\s)\"'>]*?[?&#/=][A-Za-z0-9_=%+-]{24,}+[^\s)\"'>]*+"

#: The number of hits of a kind that are listed is not limited; their evidence is that of findings elsewhere.
FINDING = "array<struct<signal:string,severity:string,kind:string,evidence:string,code:boolean>>"
_FENCE = r"(?m)^[ \t]*```[^\n]*\n?"


def _union(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def pieces(text: Column) -> Column:
    """array<string>: prose and code in turn, each behind a line feed of its own; an open fence lasts to the end."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), _FENCE, -1), lambda s: F.concat(F.lit("\n"), s))


def candidates(text: Column, patterns: list[str]) -> Column:
    """array<struct<hit, code>>: what one of the patterns matches, in one pass over each piece."""
    one = F.lit(_union(patterns))
    return F.flatten(F.transform(pieces(text), lambda s, i: F.transform(F.regexp_extract_all(s, one, F.lit(0)), lambda h: F.struct(h.alias("hit"), (i % 2 == 1).alias("code")))))


def _each(found: Column, pattern: str, build) -> Column:
    """build(value, code) of every match of one kind within the candidates."""
    inner = lambda c: F.transform(F.regexp_extract_all(c["hit"], F.lit(pattern), F.lit(0)), lambda v: build(v, c["code"]))
    return F.flatten(F.transform(found, inner))


def _finding(signal: str, severity: str | Column, kind: str, evidence: Column, code: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(signal).alias("signal"), level.alias("severity"), F.lit(kind).alias("kind"), F.substring(evidence, 1, 300).alias("evidence"), code.alias("code"))


def sample(value: Column) -> Column:
    """A value that looks made up: short, in order or of low entropy."""
    return (F.length(value) < LEAST_LENGTH) | ordered_sequence(value) | (entropy(value) <= LEAST_ENTROPY)


def error_findings(status: Column, body: Column) -> Column:
    """S1, FINDING: all secrets in the body of an error answer (400 and above), redacted, and traces of the machine (LOW)."""

    def kinds(found: Column) -> Column:
        out = [_each(found, p, lambda v, c, k=k, s=s: _finding("S1", s, k, redact_evidence(v, k), c)) for k, s, p in SECRETS]
        value = lambda v: F.regexp_extract(v, r"^[A-Z0-9_]++\s{0,4}[=:]\s{0,4}(.*)$", 1)
        named = _each(found, ENVIRONMENT, lambda v, c: F.struct(v.alias("v"), c.alias("c")))
        named = F.filter(named, lambda x: ~sample(value(x["v"])))
        out.append(F.transform(named, lambda x: _finding("S1", "HIGH", "environment", redact_evidence(value(x["v"]), "environment"), x["c"])))
        out += [_each(found, p, lambda v, c, k=k: _finding("S1", "LOW", k, F.substring(v, 1, 60), c)) for k, p in TRACES]
        return F.concat(*out)

    patterns = [*[p for *_, p in SECRETS], ENVIRONMENT, *[p for _, p in TRACES]]
    # a wider match must not hide a kind inside it, so candidates are searched for every kind
    return F.when(status >= 400, let(candidates(body, patterns), kinds)).otherwise(F.array().cast(FINDING))


def answer_findings(text: Column, request: Column) -> Column:
    """S6 and S9, FINDING: what an answer holds that its request does not.

    bidi and zero_width by count; auto_fetch outside code (HIGH); credential_echo by kind, LOW in
    code or if it looks made up, else MEDIUM; fake_system for two and more markers outside code of
    which one begins a line, and for a system's heading; prompt_extraction and credential_exfil
    (MEDIUM); override only together with another finding of these; actions (LOW, all hits).
    """
    new = lambda v: ~F.coalesce(F.contains(request, F.trim(F.regexp_replace(v, r"^\n", ""))), F.lit(False))
    count = lambda chars: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{chars}]", ""))
    bidi, zero = count("\\u202a-\\u202e\\u2066-\\u2069"), count("\\u200b-\\u200f\\u2060\\ufeff")
    no = F.lit(False)
    hidden = F.filter(F.array(
        F.when(bidi > 0, _finding("S6", "HIGH", "bidi", F.concat(F.lit("count="), bidi.cast("string")), no)),
        F.when(zero >= ZERO_WIDTH, _finding("S6", "MEDIUM", "zero_width", F.concat(F.lit("count="), zero.cast("string")), no)),
    ), lambda f: f.isNotNull())

    def kinds(found: Column) -> Column:
        fresh = lambda p, build: F.filter(_each(found, p, lambda v, c: F.when(new(v), build(v, c))), lambda f: f.isNotNull())
        prose = lambda fs: F.filter(fs, lambda f: ~f["code"])
        echo = [fresh(p, lambda v, c, k=k: _finding("S6", F.when(c | sample(v), "LOW").otherwise("MEDIUM"), f"credential_echo:{k}", redact_evidence(v, k), c)) for k, _, p in SECRETS]
        fetch = prose(fresh(FETCH, lambda v, c: _finding("S6", "HIGH", "auto_fetch", redact_evidence(v, "url"), c)))
        said = [prose(fresh(p, lambda v, c, k=k: _finding("S6", "MEDIUM", "fake_system" if k == "system_heading" else k, F.trim(F.regexp_replace(v, r"\s++", " ")), c))) for k, p in INSTRUCTIONS]
        marks = F.filter(_each(found, rf"(?:\n[ \t`'\"]*+)?{MARKER}", lambda v, c: F.struct(v.alias("v"), c.alias("c"))), lambda m: ~m["c"] & new(m["v"]))

        def fake(m: Column) -> Column:
            names = F.array_sort(F.array_distinct(F.transform(m, lambda x: F.regexp_extract(x["v"], MARKER, 0))))
            enough = (F.size(m) >= 2) & F.exists(m, lambda x: F.startswith(x["v"], F.lit("\n")))
            one = _finding("S6", "MEDIUM", "fake_system", F.concat(F.array_join(names, ","), F.lit(" (count="), F.size(m).cast("string"), F.lit(")")), no)
            return F.when(enough, F.array(one)).otherwise(F.array().cast(FINDING))

        load = F.concat(hidden, fetch, let(marks, fake), *said)
        orders = lambda all_: F.concat(all_, F.when(F.size(all_) > 0, fresh(OVERRIDE, lambda v, c: _finding("S6", "MEDIUM", "override", v, c))).otherwise(F.array().cast(FINDING)))
        actions = [fresh(p, lambda v, c, k=k: _finding("S9", "LOW", k, v, c)) for k, p in ACTIONS]
        return F.concat(let(load, orders), *echo, *actions)

    patterns = [FETCH, *[p for *_, p in SECRETS], *[p for _, p in INSTRUCTIONS], OVERRIDE, rf"(?:\n[ \t`'\"]*+)?{MARKER}", *[p for _, p in ACTIONS]]
    return let(candidates(text, patterns), kinds)


def findings(df: DataFrame, found: Column) -> DataFrame:
    """df's columns with signal, severity, kind, evidence, code and n, one row for each different finding of a row."""
    counted = lambda all_: F.transform(F.array_distinct(all_), lambda f: F.struct(f.alias("f"), F.size(F.filter(all_, lambda g: g == f)).alias("n")))
    return df.select("*", F.explode(let(found, counted)).alias("_x")).select(*df.columns, "_x.f.*", "_x.n")
