"""Queries over documents to which lines with identifiers and with their look-alikes are added.

Each line is made of the hash of its document's id, so every document has other values; the SQL
knows from the lines alone what is to be found where, and uses none of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from .tables import texts

_D = lambda at, n: f"translate(substr(h, {at}, {n}), 'abcdef', '246813')"
_L = lambda at, n: f"translate(substr(h, {at}, {n}), '0123456789abcdef', 'ABCDEFGHJKLMNPQR')"
_X = lambda at, n: f"substr(h, {at}, {n})"
_pairs = lambda sep: f" || '{sep}' || ".join(_X(i, 2) for i in range(1, 13, 2))

#: What stands before a value, the value (SQL of both engines over the hash h), what stands after it, its label or None for look-alikes.
LINES = (
    ("公司前台: ", f"'0755-2' || {_D(1, 7)}", "", "LANDLINE"),
    ("tel ", f"'（010）8' || {_D(2, 7)}", "，", "LANDLINE"),
    ("tel ", f"'(0755) 3' || {_D(3, 7)}", ".", "LANDLINE"),
    ("call ", f"'+86-010-6' || {_D(4, 7)}", "", "LANDLINE"),
    ("call ", f"'0086-0755 5' || {_D(5, 6)} || '-12'", "", "LANDLINE"),
    ("call ", f"'021-7' || {_D(6, 7)} || ' ext 12'", "", "LANDLINE"),
    ("id=", f"'07552' || {_D(1, 7)}", "", None),
    ("id ", f"'010 1' || {_D(1, 7)}", "", None),
    ("车牌是", f"'粤B' || {_D(7, 5)}", "，请登记", "PLATE"),
    ("新能源", f"'京AD' || {_D(8, 5)}", "和", "PLATE"),
    ("", f"'沪' || {_L(9, 1)} || {_L(10, 1)} || {_D(11, 4)}", "", "PLATE"),
    ("更", f"'新' || {_L(12, 7)}", ".md", None),
    ("", f"'共A' || {_D(13, 5)}", "", None),
    ("设备 ", _pairs(":"), " 已连接", "MAC"),
    ("ether ", f"upper({_pairs('-')})", "", "MAC"),
    ("序列 ", _pairs(" "), "", None),
    ("mixed ", f"{_X(1, 2)} || ':' || {_X(3, 2)} || '-' || {_X(5, 2)} || ':' || {_X(7, 2)} || '-' || {_X(9, 2)} || ':' || {_X(11, 2)}", "", None),
    ("LAN ", f"'fd' || {_X(14, 2)} || ':' || {_X(16, 4)} || ':' || {_X(20, 4)} || '::1'", "", "IPV6PRIVATE"),
    ("link ", f"'Fe80::' || upper({_X(24, 4)}) || '%eth0'", "", "IPV6PRIVATE"),
    ("all ", f"'fd' || {' || '.join([_X(14, 2), *(chr(39) + ':' + chr(39) + ' || ' + _X(i, 4) for i in range(16, 44, 4))])}", "", "IPV6PRIVATE"),
    ("doc ", f"'2001:db8:' || {_X(28, 4)} || '::1'", "", None),
    ("doc ", f"'2001:db8:fd' || {_X(28, 2)} || '::1'", "", None),
    ("few ", f"'fd' || {_X(14, 2)} || ':' || {_X(16, 4)} || ':' || {_X(20, 4)}", "", None),
    ("two ", f"'fd' || {_X(14, 2)} || '::' || {_X(16, 4)} || '::1'", "", None),
    ("证件", f"'H' || {_D(30, 8)}", "", "HKID"),
    ("编号", f"'M' || {_D(30, 8)}", "", None),
    ("编号", f"'H' || {_D(30, 7)}", "", None),
    ("联系", f"'张三@' || {_X(31, 6)} || '.example'", " 或", "EMAIL"),
    ("邮箱：", f"'王小明' || {_D(32, 4)} || '@mail.' || {_X(33, 6)} || '.com.cn'", "。", "EMAIL"),
    ("请发送至", f"'ab.' || {_X(34, 6)} || '@x-y.example'", "", "EMAIL"),
    ("to:", f"'ab_' || {_X(35, 6)} || '@a.b.c.d.e.f.g.h.i.j.k.l.example'", ";", "EMAIL"),
    ("", f"'@Override' || {_X(36, 6)}", "", None),
    ("", f"'x@' || {_X(37, 6)} || '.example'", "", None),
    *(("key ", f"'{p}' || {_X(38, 8)}", ";", "APIKEY") for p in D.SECRET_PREFIXES),
    *(("key ", f"'{p}' || {_X(39, 7)}", ";", None) for p in ("sk-", "ah-", "ghp_", "glpat-", "npm_", "hf_", "SG.")),
    ("key=", f"'gsk-' || {_X(40, 8)}", "", "APIKEY"),
    ("id ", f"'cli_a1' || {_X(41, 12)}", "", "APIKEY"),
    ("id ", f"'dinga' || {_D(42, 8)}", "", "APIKEY"),
    ("", "'risk-management disk_partition dinghies'", "", None),
)
_LABELS = ["LANDLINE", "PLATE", "MAC", "IPV6PRIVATE", "HKID", "EMAIL", "APIKEY"]

#: A list of prefixes of the user's own, of which two are not valid.
OWN = ("@token-", "x_", "acme.", "bad prefix", "bad*prefix")
OWN_LINES = (
    ("use ", f"'@token-' || {_X(1, 8)}", "", "APIKEY"),
    ("use ", f"'@token_' || {_X(1, 12)}", "", "APIKEY"),
    ("use ", f"'x_' || {_X(2, 8)}", "!", "APIKEY"),
    ("use ", f"'x-' || {_X(3, 30)}", "", "APIKEY"),
    ("use ", f"'acme.' || {_X(4, 4)} || '.' || {_X(5, 4)}", "", "APIKEY"),
    ("use ", f"'x_' || {_X(6, 7)}", "", None),
    ("use ", f"'tax_' || {_X(6, 9)}", "", None),
    ("use ", f"'sk-' || {_X(7, 12)}", "", None),
    ("use ", f"'bad prefix' || {_X(8, 9)}", "", None),
    ("use ", f"'bad*prefix' || {_X(9, 9)}", "", None),
)


#: Values behind or within what a rule with a wide pattern takes first and then refuses.
HIDDEN_LINES = (
    ("2024 ", f"'138' || {_D(1, 7)} || '0'", " x", "PHONE"),
    ("2024-01-02 ", f"'13912' || {_D(2, 5)} || '1'", "", "PHONE"),
    ("no. 7-", f"'137-0' || {_D(3, 3)} || '-' || {_D(4, 4)}", " end", "PHONE"),
    ("lib-1.2.3-", f"'13711' || {_D(5, 5)} || '2'", "", "PHONE"),
    ("12 ", "'4111111111111111'", "", "CARD"),
    ("2024 ", "'4111111111111112'", "", None),
    ("", f"'1' || {_D(6, 6)} || ' ' || {_D(7, 4)}", "", None),
    ("2.", "'13812345678'", ".1-ab", None),
    ("token=", f"'skip_' || translate({_X(9, 8)}, '0123456789', 'ghijklmnop')", "", None),
)


def _planted(spark, sf_dir: str, lines, chosen: D.Chosen) -> DataFrame:
    """Spans within the lines that are added to every text, with places counted from the end of the text itself."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    added = [F.concat(F.lit("\n" + before), F.expr(value), F.lit(after)) for before, value, after, _ in lines]
    whole = docs.select("doc_id", F.length("text").alias("n"), F.concat("text", *added).alias("t"))
    spans = whole.select("doc_id", "n", F.explode(D.detect(F.col("t"), chosen)).alias("s")).where("s.start >= n")
    return spans.select("doc_id", "s.label", (F.col("s.start") - F.col("n")).alias("pos"), "s.value")


def detect_identifiers(spark, sf_dir):
    """Landlines, plates, MAC and private IPv6 addresses, permits, Chinese mail addresses and keys of 8 characters after a prefix."""
    return _planted(spark, sf_dir, LINES, _LABELS)


def own_prefixes(spark, sf_dir):
    """Keys after prefixes of the user's own, in place of the default ones."""
    return _planted(spark, sf_dir, OWN_LINES, D.with_prefixes(OWN, ["APIKEY"]))


def hidden_values(spark, sf_dir):
    """Phone and card numbers within what wider rules refuse."""
    return _planted(spark, sf_dir, HIDDEN_LINES, ["SECRET", "IP_PRIVATE", "PHONE", "CARD"])


def _sql(lines) -> str:
    rows = ", ".join(
        f"({i}, '{before}', {value}, '{after}', {'NULL' if label is None else repr(label)})" for i, (before, value, after, label) in enumerate(lines)
    )
    return f"""WITH d AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents),
        r AS (SELECT d.doc_id, l.* FROM d, LATERAL (VALUES {rows}) AS l(i, before, value, after, label)),
        p AS (SELECT *, sum(1 + length(before) + length(value) + length(after)) OVER (PARTITION BY doc_id ORDER BY i) - length(value) - length(after) AS pos FROM r)
        SELECT doc_id, label, pos::INTEGER AS pos, value FROM p WHERE label IS NOT NULL"""


QUERIES = {f.__name__: f for f in (detect_identifiers, own_prefixes, hidden_values)}
ORACLE_SQL = {"detect_identifiers": _sql(LINES), "own_prefixes": _sql(OWN_LINES), "hidden_values": _sql(HIDDEN_LINES)}
