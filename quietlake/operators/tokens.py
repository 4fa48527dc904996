"""Placeholders: issue, mask, restore, account, verify.

A placeholder's suffix is a keyed hash of label and value, so masking needs no shuffle and is
the same in every job with the same key. Suffixes that two values share are found once over the
distinct values (the mapping), where all but the first of them get another one; mask() takes
these few from the mapping, so no two values ever share a placeholder. Texts are identified by
their own hash wherever pieces are put together again, so repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import normalize as N
from ..functions.text import let
from ..session import written
from . import known as K

#: 19 consonants; a suffix is six of them.
ALPHABET = "bcdfghjkmnpqrstvwxz"
TOKEN = r"\{\{([A-Z0-9\x{4e00}-\x{9fff}]{1,12})_([0-9a-f]{6}|[bcdfghjkmnpqrstvwxz]{6})\}\}"
#: Tolerant form: escaped or half braces, spaces inside, any case of the label.
LOOSE = r"(?:\\{0,3}\{){1,2}\s{0,2}([A-Za-z0-9_\x{4e00}-\x{9fff}]{1,12})_([bcdfghjkmnpqrstvwxz]{6}|[0-9a-f]{6})\s{0,2}(?:\\{0,3}\}){1,2}|%7[Bb]%7[Bb]([A-Za-z0-9_]{1,12})_([bcdfghjkmnpqrstvwxz]{6})%7[Dd]%7[Dd]|\b([A-Z0-9]{1,12})_([bcdfghjkmnpqrstvwxz]{6})\b"


#: Letters of a suffix; all values of a mapping must differ in them.
SIZE = 6
#: Rounds in which a mapping must find free suffixes for its values.
ROUNDS = 100
_SEP = "\u001f"


def digest(label: Column, value: Column, key: str, round_: Column | int = 0) -> Column:
    """Keyed hash as nested SHA-256 (inner key, then outer key)."""
    turn = F.lit(round_) if isinstance(round_, int) else round_
    inner = F.sha2(F.concat_ws(_SEP, F.lit(key + ".i"), label, value, turn.cast("string")), 256)
    return F.sha2(F.concat(F.lit(key + ".o"), inner), 256)


def suffix(hashed: Column, size: int = SIZE) -> Column:
    """Consonants from the first bytes of a hex digest, which is computed once for all of them."""
    char = lambda h, i: F.substring(F.lit(ALPHABET), F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") % len(ALPHABET) + 1, F.lit(1))
    return let(hashed, lambda h: F.concat(*[char(h, i) for i in range(size)]))


def written_token(label: Column, ending: Column) -> Column:
    name = F.regexp_replace(label, "[^A-Z0-9\\x{4e00}-\\x{9fff}]", "")
    return F.concat(F.lit("{{"), F.substring(name, 1, 12), F.lit("_"), ending, F.lit("}}"))


def token(label: Column, value: Column, key: str, round_: Column | int = 0, size: int = SIZE) -> Column:
    return written_token(label, suffix(digest(label, value, key, round_), size))


def found_values(df: DataFrame, text: str = "text", labels: D.Chosen = None) -> DataFrame:
    """One row per accepted value: df's columns without text, pos, start, stop, label, value."""
    rest = [c for c in df.columns if c != text]
    spans = D.detect(F.col(text), labels)
    return df.select(*rest, F.posexplode(spans).alias("pos", "s")).select(*rest, "pos", "s.start", "s.stop", "s.label", "s.value")


def mapping(values: DataFrame, key: str, size: int = SIZE, longest: int | None = None) -> DataFrame:
    """(label, value, token, round) of the distinct values: no two share a suffix.

    Of the values that share a suffix the first by label and value keeps it. The others try the
    suffixes of the next rounds until each has one that no value has; only they are looked at again.
    With `longest`, where a round leaves more than half of them without one, its letters are too few:
    the next rounds' suffixes have one letter more, up to so many.
    """
    names = ["label", "value", "round", "s"]
    issued = lambda df, r, letters=size: df.select("label", "value", F.lit(r).alias("round"), suffix(digest(F.col("label"), F.col("value"), key, r), letters).alias("s"))
    first = lambda df: df.groupBy("s").agg(F.min(F.struct("label", "value")).alias("u"), F.count("*").alias("n"))
    base = written(issued(values.select("label", "value").distinct(), 0), "suffixes")
    shared = first(base).where("n > 1").select("s", "u")
    mine = (F.col("u.label") == F.col("label")) & (F.col("u.value") == F.col("value"))
    left = base.join(shared, "s").where(~mine).select("label", "value")
    done = base.join(shared, "s", "left").where(F.col("u").isNull() | mine).select(*names)
    if left.take(1):
        left, given, letters = written(left, "colliding"), None, size
        n = left.count()
        for r in range(1, ROUNDS + 1):
            tried = issued(left, r, letters).join(base.select("s").distinct(), "s", "left_anti")
            tried = tried.join(given.select("s"), "s", "left_anti") if given else tried
            won = first(tried).select("u.label", "u.value", F.lit(r).alias("round"), "s")
            given = written(given.unionByName(won) if given else won, "given")
            left = written(left.join(given, ["label", "value"], "left_anti"), "colliding")
            before, n = n, left.count()
            if not n:
                break
            letters += n > before / 2 and letters < (longest or size)
        else:
            raise ValueError(f"no free suffix of {letters} letters for every value after {ROUNDS} rounds")
        done = done.unionByName(given.select(*names))
    return done.select("label", "value", written_token(F.col("label"), F.col("s")).alias("token"), "round")


def _identified(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_h", F.sha2(F.col(text), 256))


def mask(df: DataFrame, key: str, text: str = "text", labels: D.Chosen = None, known: DataFrame | None = None, actions: dict[str, str] | None = None, size: int = SIZE, normalise: bool = False) -> DataFrame:
    """df with the values in text replaced by placeholders. Null texts stay null.

    Without `known` one narrow pass, in which two values may share a suffix (about one pair at ten
    thousand values). With `known`, the mapping of these values, colliding ones have the
    placeholders that it gives them: texts that hold such a value are joined with them by their
    hashes. actions: label -> mask, warn (found but left in the text) or block (masked as well);
    anything else is mask. normalise: values in full width or with invisible characters are found
    too, each spelling as a value of its own.
    """
    replaced = N.replaced if normalise else D.replaced
    folds = [r.label for r in D.rules_for(labels) if r.fold]
    norm = lambda c: F.when(c["label"].isin(*folds), F.lower(c["value"])).otherwise(c["value"]) if folds else c["value"]
    warned = [label for label, action in (actions or {}).items() if action == "warn"]

    def new(c: Column, given: Column | None = None) -> Column:
        out = token(c["label"], norm(c), key, 0, size)
        if given is not None:
            out = F.coalesce(F.element_at(given, F.concat_ws(_SEP, c["label"], norm(c))), out)
        return F.when(c["label"].isin(*warned), c["value"]).otherwise(out) if warned else out

    again = known.where("round > 0").select("label", "value", "token") if known is not None else None
    if again is None or not again.take(1):
        return df.withColumn(text, replaced(F.col(text), new, labels))
    texts = _identified(df.select(text), text).dropDuplicates(["_h"])
    found = texts.select("_h", F.explode((N if normalise else D).detect(F.col(text), labels)).alias("c"))
    hits = found.select("_h", "c.label", norm(F.col("c")).alias("value")).distinct().join(again, ["label", "value"])
    entry = F.struct(F.concat_ws(_SEP, "label", "value").alias("k"), F.col("token").alias("v"))
    given = hits.groupBy("_h").agg(F.map_from_entries(F.collect_list(entry)).alias("_given"))
    both = _identified(df, text).join(given, "_h", "left")
    return both.withColumn(text, replaced(F.col(text), lambda c: new(c, F.col("_given")), labels)).drop("_h", "_given")


def occurrences(df: DataFrame, text: str, pattern: str = TOKEN) -> DataFrame:
    """df's columns without text, the placeholder's position among all, fragment, label and suffix."""
    rest = [c for c in df.columns if c != text]
    found = F.regexp_extract_all(F.col(text), F.lit(D.java(pattern)), F.lit(0))
    out = df.select(*rest, F.posexplode(found).alias("pos", "fragment"))
    clean = F.regexp_replace(F.regexp_replace(F.col("fragment"), "%7[BbDd]", ""), r"[\\{}\s]", "")
    return out.withColumn("label", F.upper(F.regexp_replace(F.regexp_extract(clean, "^(.*)_([^_]*)$", 1), "_", ""))).withColumn(
        "suffix", F.regexp_extract(clean, "^(.*)_([^_]*)$", 2)
    )


def lookup(known: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(label, suffix, original) of the placeholders that stand for one value only; a suffix that two labels share stands for none."""
    parts = known.select(F.regexp_extract("token", pattern, 1).alias("label"), F.regexp_extract("token", pattern, 2).alias("suffix"), "value").distinct()
    one = parts.groupBy("suffix").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.min("value").alias("original"))
    return one.where("n = 1").select("label", "suffix", "original")


def json_escaped(value: Column) -> Column:
    """value as it stands between the quotes of a JSON string."""
    return let(F.to_json(F.struct(value.alias("v"))), lambda whole: F.substr(whole, F.lit(7), F.length(whole) - 8))


def restore(df: DataFrame, known: DataFrame, text: str = "text", tolerant: bool = False, in_json: bool = False, size: int = SIZE) -> DataFrame:
    """df with placeholders of the mapping replaced by their values.

    known: label, value, token. Only texts that contain a placeholder meet the mapping: their
    occurrences are joined on (label, suffix), and the pieces are put together again by the
    text's hash. A suffix that two values share, or a label that was changed, restores nothing.
    With in_json the texts are JSON and values are escaped as strings in it. size: letters of the
    shortest suffix, as for mapping(); the tolerant form knows those of SIZE letters only.
    """
    strict = TOKEN if size == SIZE else TOKEN.replace("wxz]{6}", f"wxz]{{{min(size, SIZE)},{max(size, SIZE)}}}")
    pattern = LOOSE if tolerant else strict
    java = D.java(pattern)
    marked = _identified(df.select(text).where(F.col(text).rlike(java)), text).dropDuplicates(["_h"])
    parts = occurrences(marked, text, pattern).join(lookup(known, strict), ["label", "suffix"], "left")
    original = json_escaped(F.col("original")) if in_json else F.col("original")
    new = F.when(F.col("original").isNull(), F.col("fragment")).otherwise(original)
    per = parts.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))).alias("_new"))
    both = _identified(df, text).join(per, "_h", "left")
    pieces = F.zip_with(F.split(F.col(text), java, -1), F.col("_new"), lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.coalesce(n["new"], F.lit(""))))
    return both.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))).drop("_h", "_new")


def accounting(df: DataFrame, known: DataFrame, issued: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """Per document: restored, degraded (damaged in form, restored all the same), unresolved (issued, but its value or label is lost) and foreign (never issued) placeholders."""
    seen = occurrences(df.select(id_column, text), text, LOOSE)
    have = lookup(known).select("label", "suffix", F.lit(True).alias("have"))
    ever = issued.select(F.regexp_extract("token", TOKEN, 2).alias("suffix")).distinct().withColumn("ever", F.lit(True))
    each = seen.join(have, ["label", "suffix"], "left").join(ever, "suffix", "left")
    is_, was, whole = F.coalesce("have", F.lit(False)), F.coalesce("ever", F.lit(False)), F.col("fragment").rlike(f"^{TOKEN}$")
    # without braces an unknown name in capitals is no placeholder at all
    each = each.where(is_ | was | F.col("fragment").contains("{"))
    return each.groupBy(id_column).agg(
        F.count_if(is_ & whole).alias("restored"), F.count_if(is_ & ~whole).alias("degraded"), F.count_if(~is_ & was).alias("unresolved"), F.count_if(~is_ & ~was).alias("foreign")
    )


def preview(label: Column, value: Column) -> Column:
    """What may be shown of a value: type and size of keys, head and last four of long mixed credentials, else the length only."""
    long = (F.length(value) >= 20) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    size = F.concat(F.lit("<"), label, F.lit(" "), F.length(value).cast("string"), F.lit(">"))
    pem = F.concat(F.lit("<"), F.regexp_extract(value, "-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----", 1), F.lit(" "), F.length(value).cast("string"), F.lit(">"))
    short = F.concat(F.left(value, F.lit(3)), F.lit("…"), F.right(value, F.lit(4)))
    return F.when(label == "PRIVATEKEY", pem).when(label.isin(*D.CREDENTIALS) & long, short).otherwise(size)


def credential_digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def records(spans: Column, export: bool = False) -> Column:
    """array<struct<label, preview, digest, original>> for a log: originals of credentials are never kept, none at all in an export."""

    def one(s: Column) -> Column:
        hidden = F.lit(True) if export else s["label"].isin(*D.CREDENTIALS)
        original = F.when(~hidden, s["value"])
        return F.struct(s["label"].alias("label"), preview(s["label"], s["value"]).alias("preview"), credential_digest(s["value"]).alias("digest"), original.alias("original"))

    return F.transform(spans, one)


def masked_word(word: Column, credential: Column) -> Column:
    """For display: credentials as dots; else first and last character around at most six stars."""
    n = F.length(word)
    stars = F.repeat(F.lit("*"), F.least(F.greatest(n - 2, F.lit(1)), F.lit(6)))
    return F.when(credential, F.repeat(F.lit("•"), F.least(n, F.lit(8)))).when(n <= 2, F.concat(F.left(word, F.lit(1)), F.lit("*"))).otherwise(
        F.concat(F.left(word, F.lit(1)), stars, F.right(word, F.lit(1)))
    )


def egress(text: Column, labels: D.Chosen = None, least: int = 4, most: int | None = None, most_bytes: int | None = None) -> Column:
    """struct(leaks, skipped): how many of its own values the masked text still holds outside placeholders.

    Values of at least `least` characters that are no credentials. All values of all texts are
    verified; with `most` or `most_bytes` a text of more values or bytes is not, and skipped says why.
    """

    def verify(both: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(both["found"], lambda c: c["label"].isNotNull() & ~c["label"].isin(*D.CREDENTIALS) & (F.length(c["value"]) >= least)), lambda c: c["value"]))
        bare = F.regexp_replace(both["bare"], TOKEN, "\u0000")
        held = lambda b: F.size(F.filter(b["values"], lambda v: F.contains(b["bare"], v)))
        many = F.size(values) > most if most is not None else F.lit(False)
        long = F.octet_length(both["bare"]) > most_bytes if most_bytes is not None else F.lit(False)
        skipped = F.when(many, "too_many_values").when(long, "too_long")
        return F.struct(F.when(skipped.isNull(), let(F.struct(values.alias("values"), bare.alias("bare")), held)).alias("leaks"), skipped.alias("skipped"))

    def both(pieces: Column) -> Column:
        bare = D.replaced_parts(pieces, lambda c: F.lit("\u0000"), labels)
        return let(F.struct(D.candidates_of(pieces, labels).alias("found"), bare.alias("bare")), verify)

    return let(D.parts(F.coalesce(text, F.lit("")), labels), both)


def forward(df: DataFrame, known: DataFrame, text: str = "text", least: int = 8) -> DataFrame:
    """df with every known value of at least `least` characters replaced by its placeholder wherever it stands between word edges.

    known: label, value, token. Credentials are left to the rules. Chinese, Japanese and the like
    have no edges, so values are found in the middle of their runs. See known.replaced().
    """
    wanted = known.where((F.length("value") >= least) & ~F.col("label").isin(*D.CREDENTIALS))
    return K.replaced(df, wanted.select("value", "token"), text)


def unrestored(df: DataFrame, known: DataFrame, id_column: str, text: str = "text", labels: D.Chosen = None) -> DataFrame:
    """(id, label, value) found in answers that no mapping accounts for: to be warned about, the answer itself is not changed."""
    found = found_values(df.select(id_column, text), text, labels).select(id_column, "label", "value").distinct()
    return found.join(known.select("label", "value"), ["label", "value"], "left_anti").select(id_column, "label", "value")


def renewed(known: DataFrame, used: DataFrame, now: Column, ttl: int = 86400, capacity: int = 32768) -> DataFrame:
    """A mapping (token, value, …, last_seen) after uses (token, ts): use renews, what was not used for ttl seconds goes, and of the rest the `capacity` used last stay.

    The newest `capacity` are found by a sort with a limit, so no task holds the whole mapping.
    """
    seen = used.groupBy("token").agg(F.max("ts").alias("_ts"))
    both = known.join(seen, "token", "left").withColumn("last_seen", F.greatest("last_seen", F.coalesce("_ts", "last_seen"))).drop("_ts")
    alive = both.where(F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(float(ttl))))
    return alive.orderBy(F.desc("last_seen"), "token").limit(capacity)
