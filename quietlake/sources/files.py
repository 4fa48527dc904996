"""Sources and sinks besides Spark's own: damaged JSON lines, .env texts, price lists, compressed bodies, office files, reports."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a body may have after decoding.
BODY_LIMIT = 16_000_000


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, (line) of the bad ones); both read the file anew, nothing is gathered."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select(F.col("value").alias("line"))


def appended(batch: DataFrame, path: str, valid: Column) -> dict[str, int]:
    """Appends the valid rows by day and puts the others beside them; returns how many of each."""
    from pyspark.sql import Observation

    seen = Observation()
    marked = batch.withColumn("_ok", F.coalesce(valid, F.lit(False))).observe(seen, F.count_if("_ok").alias("kept"), F.count_if(~F.col("_ok")).alias("dead"))
    marked.write.mode("append").partitionBy("_ok").parquet(path)
    return seen.get


def price_list(text: DataFrame, column: str = "value") -> DataFrame:
    """(name, input, output) per million tokens from either {"data": [{id, pricing}]} or {name: {input, output}} texts.

    Only finite positive prices, six decimals.
    """
    listed = F.from_json(column, "data array<struct<id:string,pricing:struct<prompt:string,completion:string>>>")["data"]
    plain = F.from_json(column, "map<string,struct<input:double,output:double>>")
    a = text.select(F.explode(listed).alias("m")).select(
        F.col("m.id").alias("name"), (F.col("m.pricing.prompt").try_cast("double") * 1e6).alias("input"), (F.col("m.pricing.completion").try_cast("double") * 1e6).alias("output")
    )
    b = text.where(F.get_json_object(column, "$.data").isNull()).select(F.explode(plain).alias("name", "p")).select("name", "p.input", "p.output")
    good = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) > 0)
    return a.unionByName(b).where(good("input") & good("output")).select("name", F.round("input", 6).alias("input"), F.round("output", 6).alias("output"))


def inflate(raw: bytes | None, encoding: str | None, limit: int = BODY_LIMIT) -> bytes | None:
    """Decoded body; null if it is damaged, of an unknown encoding, or larger than the limit."""
    if raw is None:
        return None
    name = (encoding or "identity").strip().lower()
    try:
        if name == "identity":
            out = raw
        elif name in ("gzip", "x-gzip"):
            with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
                out = f.read(limit + 1)
        elif name == "deflate":
            for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
                d = zlib.decompressobj(bits)
                try:
                    out = d.decompress(raw, limit + 1)
                    if not d.eof and len(out) <= limit:
                        return None
                    break
                except zlib.error:
                    out = None
        elif name == "zstd":
            import zstandard

            try:
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)) as f:
                    out = f.read(limit + 1)
            except zstandard.ZstdError:
                return None
        else:
            return None
    except (OSError, EOFError, zlib.error, ValueError):
        return None
    return out if out is not None and len(out) <= limit else None


def _inflated(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([inflate(r, e) for r, e in zip(raw, encoding)])


def decoded_body(raw: Column, encoding: Column) -> Column:
    return F.pandas_udf(_inflated, "binary", F.PandasUDFType.SCALAR)(raw, encoding)


#: Parts of office files that hold text.
_PARTS = re.compile(r"^(?:word/(?:document|header\d*|footer\d*|footnotes|comments)\.xml|xl/(?:sharedStrings|comments\d*)\.xml|ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml)$")


def office_texts(files: DataFrame) -> DataFrame:
    """(path, part, text) of docx, xlsx and pptx files given as binaryFile rows; unreadable files have one row with a null part, parts over BODY_LIMIT one with a null text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if _PARTS.match(info.filename) and info.file_size > BODY_LIMIT:
                                rows.append((path, info.filename, None))  # too large to be unpacked: said, not left out
                            elif _PARTS.match(info.filename):
                                xml = z.read(info).decode("utf-8", "replace")
                                text = re.sub(r"<[^>]*>", "", re.sub(r"</(?:w:p|a:p|si)>", "\n", xml))
                                for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                                    text = text.replace(a, b)
                                rows.append((path, info.filename, text.rstrip("\n")))
                except (zipfile.BadZipFile, KeyError, RuntimeError):
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "part", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, text string")


def dot_env(texts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, key, value, line, skip_reason) of .env texts: comments, export, quotes with escapes, inline comments; the last of equal keys wins."""
    lines = texts.select(id_column, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line", "raw"))
    row = F.trim(F.regexp_replace("raw", r"^\s*export\s+", ""))
    body = lines.withColumn("row", row).where((F.col("row") != "") & ~F.col("row").startswith("#"))
    # one step for each: a column that is written out where it is used is searched for again at every use
    key, rest = F.regexp_extract("row", r"^([A-Za-z_][A-Za-z0-9_.]*)\s*=", 1), F.regexp_extract("row", r"^[^=]*=\s*([\s\S]*)$", 1)
    halves = body.select(id_column, "line", key.alias("key"), rest.alias("rest"))
    rest, double = F.col("rest"), r'^"((?:[^"\\]|\\.)*)"'
    escaped = F.regexp_extract(rest, double, 1)
    for a, b in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    bare = F.trim(F.regexp_replace(rest, r"(?:^|\s)#.*$", ""))
    value = F.when(rest.startswith('"'), escaped).when(rest.startswith("'"), F.regexp_extract(rest, r"^'([^']*)'", 1)).otherwise(bare)
    open_ = (rest.startswith('"') & ~rest.rlike(double)) | (rest.startswith("'") & ~rest.rlike(r"^'[^']*'"))
    read = halves.select(id_column, "line", "key", value.alias("value"), open_.alias("open"))
    reason = F.when(F.col("key") == "", "no_key").when(F.col("open"), "open_quote").when(F.col("value") == "", "empty")
    said = read.select(id_column, "line", "key", "value", reason.alias("reason"))
    parsed = said.select(
        id_column, F.when(F.col("key") != "", F.col("key")).alias("key"), F.when(F.col("reason").isNull(), F.col("value")).alias("value"), (F.col("line") + 1).alias("line"), "reason"
    )
    later = F.row_number().over(Window.partitionBy(id_column, "key", F.col("reason").isNull()).orderBy(F.desc("line")))
    named = parsed.withColumn("nth", later)
    skip = F.when(F.col("reason").isNull() & (F.col("nth") > 1), "overridden").otherwise(F.col("reason"))
    return named.select(id_column, "key", "value", "line", skip.alias("skip_reason"))


def env_label(key: Column, value: Column) -> Column:
    """Label of an .env entry from its name, then from its value; null for ordinary settings."""
    k = F.upper(key)
    return (
        F.when(k.rlike("PASS(WORD|WD)?|PWD"), "PASSWORD")
        .when(k.rlike("TOKEN|SECRET|API_?KEY|ACCESS_?KEY|PRIVATE_?KEY|CREDENTIAL"), "SECRET")
        .when(value.rlike(r"^[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@"), "CONNSTR")
        .when(value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "EMAIL")
    )


def markdown_report(findings: DataFrame, path: str, title: str = "Report") -> None:
    """findings (signal, severity, kind, evidence) as one Markdown text file, worst first, evidence cut to 300 characters."""
    from ..operators.audit import rank

    clean = F.regexp_replace(F.substring("evidence", 1, 300), r"[|\r\n]", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "signal", "severity", "kind", clean), F.lit(" |"))
    head = findings.sparkSession.range(1).select(F.lit(f"# {title}\n\n| signal | severity | kind | evidence |\n|-|-|-|-|").alias("value"))
    body = findings.select(row.alias("value"), rank(F.col("severity")).alias("r")).orderBy(F.desc("r"), "value").select("value")
    head.unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def repacked(content: bytes, texts: dict[str, dict[str, str]]) -> bytes:
    """An office file in which, part by part, texts between tags are replaced (old -> new); all else is as it was."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = old.read(info)
            if info.filename in texts:
                xml = data.decode("utf-8")
                for a, b in texts[info.filename].items():
                    quote = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                    xml = xml.replace(quote(a), quote(b))
                data = xml.encode()
            new.writestr(info, data)
    return out.getvalue()


def office_masked(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, content) of office files with values replaced; spans: path, part, value, token. Files without spans stay as they are."""
    per = spans.groupBy("path").agg(F.collect_set(F.struct("part", "value", "token")).alias("s"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            out = []
            for content, found in zip(frame["content"], frame["s"]):
                texts: dict[str, dict[str, str]] = {}
                for f in sorted(found if found is not None else [], key=lambda f: -len(f["value"])):
                    texts.setdefault(f["part"], {})[f["value"]] = f["token"]
                out.append(repacked(content, texts) if texts else content)
            yield pd.DataFrame({"path": frame["path"], "content": out})

    return files.select("path", "content").join(per, "path", "left").mapInPandas(run, "path string, content binary")


def exported(log: DataFrame, path: str, kind: str, most: int, hidden: tuple[str, ...] = ("word", "payload")) -> dict[str, int]:
    """The newest `most` rows as CSV or JSON without the hidden columns; returns how many were written and whether any were left out."""
    public = log.drop(*hidden)
    part = public.orderBy(F.desc("id")).limit(most + 1).cache()
    n = part.count()
    kept = part.orderBy(F.desc("id")).limit(most)
    getattr(kept.write.mode("overwrite").option("header", True) if kind == "csv" else kept.write.mode("overwrite"), kind)(path)
    part.unpersist()
    return {"rows": min(n, most), "truncated": int(n > most)}


def price_cache(prices: DataFrame, path: str) -> DataFrame:
    """Keeps a price list at path, replaced as a whole; a list without a row leaves the old one in place."""
    spark = prices.sparkSession
    if prices.take(1):
        prices.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("name string, input double, output double").parquet(path)


#: Settings with their defaults, and the test that a given value must pass.
SETTINGS = {
    "fail_closed": (True, lambda v: isinstance(v, bool)), "log_mode": ("summary", lambda v: v in ("summary", "detailed", "trace")),
    "retention_days": (30, lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0), "rules": ({}, lambda v: isinstance(v, dict)), "categories": ({}, lambda v: isinstance(v, dict)),
}


def settings(text: str | None) -> dict:
    """Settings from a JSON text; what is missing, unknown or wrong falls back to its default. To be read again for each micro-batch."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        given = {}
    given = given if isinstance(given, dict) else {}
    return {k: given[k] if k in given and ok(given[k]) else default for k, (default, ok) in SETTINGS.items()}


def signals(control: DataFrame, now: Column) -> DataFrame:
    """(name, value) in force: of each signal (name, value, ts, ttl) the newest that has not run out."""
    alive = control.where(F.col("ttl").isNull() | (F.col("ts") + F.make_dt_interval(secs=F.col("ttl").cast("double")) > now))
    return alive.groupBy("name").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def imported_once(spark: SparkSession, path: str, schema: str, target: str, day: str) -> int | None:
    """Old JSON lines into the table at target, once: a second call finds the mark beside it and returns null. Bad lines are left out and counted in the mark."""
    mark = f"{target}-imported"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(mark)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    good, bad = json_lines(spark, path, schema)
    good.write.mode("append").parquet(target)
    n = good.count()
    spark.createDataFrame([(day, n, bad.count())], "day string, rows long, bad long").coalesce(1).write.mode("overwrite").json(mark)
    return n
