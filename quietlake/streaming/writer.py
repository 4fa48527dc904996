"""The event log's writer: each micro-batch in one write, bad rows beside the good ones, every event counted.

Rows arrive as JSON texts. A row is dead if it is no object, if a value does not fit its column
or a required one is missing; one bad row loses itself only, as its text and the reason are kept.
Rows from before a clear, and repeats of an id within the batch, are dropped. The three outcomes
are counted per event while they are written, and always add up to the input.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructType

OUTCOMES = ("kept", "dropped", "dead")
#: Types that have counters of their own; all others count together.
TYPES = ("PASS", "MASK", "RESTORE", "BLOCK", "ERR")
COUNTERS = "source string, batch long, type string, " + ", ".join(f"{o} long" for o in OUTCOMES)


def _kind(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def checked(raw: DataFrame, schema: str | StructType, required: tuple[str, ...], cuts: dict[str, int] | None = None, column: str = "value") -> DataFrame:
    """The columns of schema, with _raw and _reason (null for a good row).

    Each value is cast by itself, so that the reason can name the column. cuts: columns that are
    cut to so many characters (evidence, for one).
    """
    kind = _kind(schema)
    fields = StructType()
    for f in kind:
        fields = fields.add(f.name, StringType())
    parsed = raw.select(F.col(column).alias("_raw"), F.from_json(column, fields).alias("r"), F.json_object_keys(column).isNotNull().alias("_object"))
    typed = {f.name: F.col("r").getField(f.name).try_cast(f.dataType) for f in kind}
    wrong = [F.when(F.col("r").getField(c).isNotNull() & v.isNull(), F.lit(f"{c}: value")) for c, v in typed.items()]
    missing = [F.when(F.col("r").getField(c).isNull(), F.lit(f"{c}: missing")) for c in required]
    reason = F.coalesce(F.when(~F.col("_object"), F.lit("no object")), *wrong, *missing)
    out = {c: F.left(v, F.lit(cuts[c])) if cuts and c in cuts else v for c, v in typed.items()}
    return parsed.select(*[v.alias(c) for c, v in out.items()], "_raw", reason.alias("_reason"))


def outcomes(rows: DataFrame, key: str, time: str, cutoff: Column | None) -> DataFrame:
    """checked() rows with _outcome: dead, dropped (before the cutoff, or an id that the batch has already) or kept."""
    old = F.coalesce(F.col(time) < cutoff, F.lit(False)) if cutoff is not None else F.lit(False)
    good = rows.where("_reason IS NULL")
    dead = rows.where("_reason IS NOT NULL").withColumn("_outcome", F.lit("dead"))
    # the first of equal ids by its text; a hot id is reduced before it is shuffled
    first = good.groupBy(F.col(key).alias("_k")).agg(F.min("_raw").alias("_first"), F.count("*").alias("_n"))
    one = good.groupBy(key, "_raw").agg(F.count("*").alias("_same"), *[F.first(c).alias(c) for c in good.columns if c not in (key, "_raw")])
    both = one.join(first, F.col(key).eqNullSafe(F.col("_k")))
    keep = (F.col("_raw") == F.col("_first")) & ~old
    # of equal texts one may stay, the others are dropped
    parts = F.filter(F.array(F.struct(F.when(keep, "kept").otherwise("dropped").alias("o"), F.when(keep, 1).otherwise(F.col("_same")).alias("n")),
                             F.struct(F.lit("dropped").alias("o"), F.when(keep, F.col("_same") - 1).otherwise(0).alias("n"))), lambda p: p["n"] > 0)
    settled = both.withColumn("_p", F.explode(parts)).select(*rows.columns, F.col("_p.o").alias("_outcome"), F.col("_p.n").cast("long").alias("_count"))
    return settled.unionByName(dead.withColumn("_count", F.lit(1).cast("long")))


def written_batch(raw: DataFrame, path: str, part: tuple[str, int], schema: str | StructType, required: tuple[str, ...], key: str = "id", time: str = "ts", kind: str = "type",
                  cutoff: Column | None = None, cuts: dict[str, int] | None = None, column: str = "value") -> dict[tuple[str, str], int]:
    """Writes one batch and returns its counters (type, outcome) -> events. Writing a batch again replaces it.

    Rows and dead letters go out in one pass, to folders of their own; dropped rows are only counted.
    """
    spark = raw.sparkSession
    rows = outcomes(checked(raw, schema, required, cuts, column), key, time, cutoff)
    named = F.coalesce(F.when(F.col(kind).isin(*TYPES), F.col(kind)), F.lit("other"))
    seen = Observation()
    counts = [F.sum(F.when((named == t) & (F.col("_outcome") == o), F.col("_count")).otherwise(0)).alias(f"{t}/{o}") for t in (*TYPES, "other") for o in OUTCOMES]
    source, n = part
    rows.observe(seen, *counts).where("_outcome <> 'dropped'").write.mode("overwrite").partitionBy("_outcome").parquet(f"{path}/rows/part={source}-{n}")
    found = {tuple(k.split("/")): int(v or 0) for k, v in seen.get.items()}
    lines = [(source, n, t, *[found[t, o] for o in OUTCOMES]) for t in (*TYPES, "other") if any(found[t, o] for o in OUTCOMES)]
    spark.createDataFrame(lines, COUNTERS).coalesce(1).write.mode("overwrite").json(f"{path}/counters/{source}-{n}")
    return found


def kept_log(raw: DataFrame, path: str, source: str, schema: str | StructType, required: tuple[str, ...], **how) -> DataStreamWriter:
    """A writer (to be started with a checkpoint) for a stream of JSON texts; a batch that is replayed replaces itself. See written_batch()."""

    def put(batch: DataFrame, n: int) -> None:
        written_batch(batch, path, (source, n), schema, required, **how)

    return raw.writeStream.foreachBatch(put)


def _rows(spark: SparkSession, path: str, schema: str | StructType, outcome: str) -> DataFrame:
    whole = StructType([*_kind(schema).fields, *StructType.fromDDL("_raw string, _reason string, _count long, _outcome string, part string").fields])
    return spark.read.schema(whole).parquet(f"{path}/rows").where(F.col("_outcome") == outcome)


def log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return _rows(spark, path, schema, "kept").drop("_raw", "_reason", "_count", "_outcome", "part")


def dead_letters(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """(text, reason) of the rows that could not be written."""
    return _rows(spark, path, schema, "dead").select(F.col("_raw").alias("text"), F.col("_reason").alias("reason"))


def counters(spark: SparkSession, path: str) -> DataFrame:
    """(type, kept, dropped, dead) over all batches."""
    each = spark.read.schema(COUNTERS).json(f"{path}/counters/*")
    return each.groupBy("type").agg(*[F.sum(o).alias(o) for o in OUTCOMES])


def observed(query) -> list[dict]:
    """Input rows of each micro-batch by the query's own progress, to be held against the counters."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in map(_plain, query.recentProgress)]


def _plain(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)
