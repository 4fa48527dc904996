"""Check-digit, range and shape validators as Column expressions; false on null or malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of GB 11643 (weights, check characters) and GB 32100 (alphabet, weights).
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
#: First two digits of the region codes of GB 2260.
PROVINCES = (11, 12, 13, 14, 15, 21, 22, 23, 31, 32, 33, 34, 35, 36, 37, 41, 42, 43, 44, 45, 46, 50, 51, 52, 53, 54, 61, 62, 63, 64, 65, 71, 81, 82, 83)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def distinct_chars(value: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))


def card_ok(value: Column) -> Column:
    """13 to 19 digits, first digit 3 to 6, Luhn, grouped 4-4-4-4(-3), 4-6-5 or not at all."""
    d = digits(value)
    grouped = value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$")
    return F.coalesce(grouped & d.rlike("^[3-6]") & F.call_function("luhn_check", d), F.lit(False))


def ipv4_ok(value: Column) -> Column:
    """Exactly four numbers of at most three digits, each at most 255, none padded with zeros."""
    shape = value.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$")
    small = F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return F.coalesce(shape & small, F.lit(False))


#: Resolvers that everybody may name.
PUBLIC_DNS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "4.2.2.1", "4.2.2.2", "4.2.2.3", "114.114.114.114", "114.114.115.115",
    "223.5.5.5", "223.6.6.6", "119.29.29.29", "180.76.76.76", "9.9.9.9", "208.67.222.222", "208.67.220.220",
)
#: Versions in the shape of an address: digits only, or a build number.
VERSION_LIKE = r"^(?:[0-9](?:\.[0-9]){3}|[0-9]\.[0-9]{1,3}\.0\.[0-9]{3})$"


def _octet(value: Column, i: int) -> Column:
    return F.split_part(value, F.lit("."), F.lit(i)).try_cast("int")


def ip_class(value: Column) -> Column:
    """IP_PRIVATE, IP_INTERNAL, IP_PUBLIC, or null for addresses that are none of these (loopback, multicast, documentation, reserved)."""
    a, b, c = (_octet(value, i) for i in (1, 2, 3))
    reserved = (
        a.isin(0, 127) | (a >= 224) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return (
        F.when(~ipv4_ok(value), None)
        .when(((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)), "IP_PRIVATE")
        .when((a == 10) | ((a == 172) & b.between(16, 31)), "IP_INTERNAL")
        .when(reserved | value.isin(*PUBLIC_DNS) | value.rlike(VERSION_LIKE), None)
        .otherwise("IP_PUBLIC")
    )


#: Places for passwords in documents: variables in brackets, and the words that stand for one.
TEMPLATE = r"^(?:\$\{[^{}]{1,64}\}|\$[A-Z_]{2,64}|\{\{?[^{}]{1,64}\}\}?|<[^<>]{1,64}>|\[[^\[\]]{1,64}\]|%[A-Z_]{2,64}%)$"
TEMPLATE_WORDS = r"^(?i:password|passwd|pass|pwd|secret|your[_-]?password|changeme|x{3,}|\*{3,})$"


def connection_password_ok(value: Column) -> Column:
    """A password rather than a place for one."""
    return F.coalesce(~value.rlike(TEMPLATE) & ~value.rlike(TEMPLATE_WORDS), F.lit(False))


def cn_mobile_ok(value: Column) -> Column:
    """Mainland mobile number, optionally with its country code; separators 3-4-4 and all alike; not one digit only."""
    core = r"1[3-9][0-9](?:[0-9]{8}| [0-9]{4} [0-9]{4}|-[0-9]{4}-[0-9]{4})"
    shape = value.rlike(rf"^(?:(?:\+?86|0086|\(86\))[ -]?)?{core}$")
    return F.coalesce(shape & (distinct_chars(F.right(digits(value), F.lit(11))) > 1), F.lit(False))


#: Parts of a fixed-line number: country code, area code after it or in brackets of either width, number with extension.
CODE = r"(?:\+|\b00)86"
AREA = r"(?:0?[1-9][0-9]{1,2}[ -]|[(（]0?[1-9][0-9]{1,2}[)）][ -]?)"
BRACKETS = r"[(（]0?[1-9][0-9]{1,2}[)）][ -]?"
LOCAL = r"[2-9][0-9]{6,7}(?:(?:-| ?(?:ext|转)\.? ?)[0-9]{1,5})?"


def landline_ok(value: Column) -> Column:
    """Area code, separator or brackets, 7 or 8 digits that do not begin with 0 or 1; optional country code and extension."""
    return F.coalesce(value.rlike(rf"^(?:(?:\+|00)86[ -]?{AREA}|{BRACKETS}|0[1-9][0-9]{{1,2}}[ -]){LOCAL}$"), F.lit(False))


def _date_ok(text: Column) -> Column:
    found = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    return F.coalesce((F.date_format(found, "yyyyMMdd") == text) & text.between("18000101", "21001231"), F.lit(False))


def id_card_ok(value: Column) -> Column:
    """18 characters with region, birth date and MOD 11-2 check, or 15 digits with region and birth date."""
    total = F.lit(0)
    for i, w in enumerate(ID_WEIGHTS):
        total = total + F.coalesce(F.substring(value, i + 1, 1).try_cast("int"), F.lit(0)) * w
    check = F.substring(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1))
    region = F.substring(value, 1, 2).try_cast("int").isin(*PROVINCES)
    long = value.rlike("^[0-9]{17}[0-9Xx]$") & _date_ok(F.substring(value, 7, 8)) & (F.upper(F.substring(value, 18, 1)) == check)
    short = value.rlike("^[0-9]{15}$") & _date_ok(F.concat(F.lit("19"), F.substring(value, 7, 6)))
    return F.coalesce(region & (long | short), F.lit(False))


def iban_ok(value: Column) -> Column:
    """Country, check digits, 11 to 30 characters, MOD 97 equal to 1."""
    turned = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise((acc * 100 + (F.ascii(c) - 55)) % 97),
    )
    return F.coalesce(value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def uscc_ok(value: Column) -> Column:
    """18 characters of the GB 32100 alphabet with its MOD 31 check character."""
    total = F.lit(0)
    for i, w in enumerate(USCC_WEIGHTS):
        total = total + (F.call_function("locate", F.substring(value, i + 1, 1), F.lit(USCC_ALPHABET)) - 1) * w
    check = F.substring(F.lit(USCC_ALPHABET), (31 - total % 31) % 31 + 1, F.lit(1))
    return F.coalesce(value.rlike(f"^[{USCC_ALPHABET}]{{18}}$") & value.rlike("[A-Z]|^9") & (F.substring(value, 18, 1) == check), F.lit(False))


def plate_ok(value: Column) -> Column:
    """Region character, letter, five or six letters and digits of which one is a digit."""
    return F.coalesce(value.rlike("^[\\u4e00-\\u9fff][A-HJ-NP-Z][A-HJ-NP-Z0-9]{5,6}$") & value.rlike("[0-9]"), F.lit(False))


def hkid_ok(value: Column) -> Column:
    return F.coalesce(value.rlike("^H[0-9]{8}$"), F.lit(False))


def mac_ok(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$|^[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}$"), F.lit(False))


def ipv6_private_ok(value: Column) -> Column:
    """Link-local (with an optional zone) or unique local addresses in fd00::/8: eight groups, or fewer around one double colon."""
    shape = value.rlike(r"^(?i)(?:fe[89ab][0-9a-f]|fd[0-9a-f]{2})(?::[0-9a-f]{0,4}){1,7}(?:%[0-9a-z]+)?$")
    bare = F.split_part(value, F.lit("%"), F.lit(1))
    doubled = F.contains(bare, F.lit("::"))
    whole = ~doubled & bare.rlike("^[^:]+(?::[^:]+){7}$")
    short = doubled & ~F.contains(bare, F.lit(":::")) & (F.size(F.split(bare, "::")) == 2) & bare.rlike("^[^:]+(?:::?[^:]+){0,6}(?:::)?$")
    return F.coalesce(shape & (whole | short), F.lit(False))


def jwt_ok(value: Column) -> Column:
    """Three base64url parts whose first decodes to a JSON object with alg."""
    head = F.translate(F.split_part(value, F.lit("."), F.lit(1)), "-_", "+/")
    padded = F.rpad(head, F.ceil(F.length(head) / 4).cast("int") * 4, "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    shape = value.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$")
    return F.coalesce(shape & F.get_json_object(text, "$.alg").isNotNull(), F.lit(False))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(
        F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n <= 0, F.lit(0.0)).otherwise(total)


def ordered_sequence(value: Column) -> Column:
    """Whether the value is a run of the alphabet or of the digits, forwards or backwards."""
    low = F.lower(value)
    lines = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "zyxwvutsrqponmlkjihgfedcba", "9876543210")
    found = F.lit(False)
    for line in lines:
        found = found | F.contains(F.lit(line), low)
    return found


def code_identifier(value: Column) -> Column:
    """Names of program elements: dotted paths, snake_case, camelCase, kebab-case, calls, files, constants."""
    tests = (
        r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$",
        r"^_*[a-z][a-z0-9]*(?:_[a-z0-9]+)+$",
        r"^[a-z]+(?:[A-Z][a-z0-9]*)+$",
        r"^(?:[A-Z][a-z0-9]+){2,}$",
        r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$",
        r"^[A-Za-z_][A-Za-z0-9_.]*\(.*\)?$",
        r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$",
    )
    found = F.lit(False)
    for t in tests:
        found = found | value.rlike(t)
    return F.coalesce(found, F.lit(False))


def high_entropy(value: Column, least: float = 3.0) -> Column:
    """At least 20 letters and digits of three classes, not ordered, entropy of characters and of pairs high."""
    classes = sum(value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]"))
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))
    varied = F.size(F.array_distinct(pairs)) >= 0.75 * (F.size(chars) - 1)
    shape = value.rlike("^[A-Za-z0-9_+/=-]{20,}$")
    return F.coalesce(F.when(shape & (classes >= 3), (entropy(value) >= least) & varied & ~ordered_sequence(value)).otherwise(F.lit(False)), F.lit(False))
