"""Roll-ups of the event log kept up to date by a stream, each event counted once.

A micro-batch adds its own sums as one part of the table and then enters the part in a ledger.
Parts that the ledger lacks do not count, parts that it has are not written again, so a batch
that is replayed or that failed half-way changes nothing. A scan of the history is a part like
any other and is done once. From time to time the parts are summed into one that covers them.

All six roll-ups come from one pass and one shuffle: an event becomes its contributions
(rollup, day, keys, measures), which are summed together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.events import ingress

#: Per roll-up the names of its keys (k1 …) and measures (m1 …).
TABLES = {
    "daily": (("type",), ("n",)),
    "status": (("status",), ("n",)),
    "words": (("label", "word", "ingress"), ("n",)),
    "tokens": ((), ("prompt", "completion", "requests")),
    "models": (("model",), ("requests", "errors", "prompt", "completion")),
    "prefix": ((), ("total", "rewritten", "reused")),
}
KEYS, MEASURES = ("k1", "k2", "k3"), ("m1", "m2", "m3", "m4")
SCHEMA = "rollup string, day date, k1 string, k2 string, k3 string, m1 long, m2 long, m3 long, m4 long"
LEDGER = "part string, covers array<string>, mark long"
#: Parts after which they are summed into one; the ledger that the driver reads is no longer than this.
COMPACT_AFTER = 100


def contributions(log: DataFrame, foreign: str | None = None) -> DataFrame:
    """What each event adds: statuses come from RESTORE only (with a row `foreign` where that column is above zero), words from
    MASK only, tokens from RESTORE and PASS with usage, models from all with a model, prefixes where it is known whether the
    body was rewritten."""
    kind, used = F.col("type"), F.col("prompt_tokens").isNotNull()

    def row(name: str, when, keys: list, measures: list):
        filled = [*[F.col(k) if isinstance(k, str) else k for k in keys], *[F.lit(None)] * (3 - len(keys))]
        numbers = [*measures, *[F.lit(0)] * (4 - len(measures))]
        values = [c.cast("string").alias(k) for c, k in zip(filled, KEYS)] + [F.coalesce(m.cast("long"), F.lit(0)).alias(n) for m, n in zip(numbers, MEASURES)]
        return F.when(when, F.struct(F.lit(name).alias("rollup"), *values))

    one, flag = F.lit(1), lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = [
        row("daily", F.lit(True), ["type"], [one]),
        row("status", kind == "RESTORE", ["status"], [one]),
        row("words", kind == "MASK", ["label", "word", ingress(F.col("ingress"))], [one]),
        row("tokens", kind.isin("RESTORE", "PASS") & used, [], [F.col("prompt_tokens"), F.col("completion_tokens"), one]),
        row("models", F.col("model").isNotNull(), ["model"], [flag(used), flag(kind == "ERR"), F.col("prompt_tokens"), F.col("completion_tokens")]),
        row("prefix", F.col("rewritten").isNotNull(), [], [one, flag(F.col("rewritten")), flag(F.col("reused"))]),
    ]
    if foreign:
        rows.append(row("status", (kind == "RESTORE") & (F.col(foreign) > 0), [F.lit("foreign")], [one]))
    each = log.select("day", F.explode(F.array(*rows)).alias("c")).where("c IS NOT NULL")
    return each.select("c.rollup", "day", *[f"c.{x}" for x in KEYS + MEASURES])


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rollup", "day", *KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ledger(spark: SparkSession, path: str) -> list:
    """Entries of the parts that count, or that a part which counts covers."""
    return spark.read.schema(LEDGER).json(f"{path}/ledger/*").collect() if _exists(spark, f"{path}/ledger") else []


def live(entries: list) -> list[str]:
    """Parts that count: in the ledger and covered by no other one."""
    covered = {c for e in entries for c in e.covers or ()}
    return sorted(e.part for e in entries if e.part not in covered)


def _enter(spark: SparkSession, path: str, part: str, covers: list[str], mark: int | None) -> None:
    spark.createDataFrame([(part, covers, mark)], LEDGER).coalesce(1).write.mode("overwrite").json(f"{path}/ledger/entry={part}")


def _parts(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/parts/{p}" for p in parts])


def _known(entries: list, part: str) -> bool:
    return any(part == e.part or part in (e.covers or ()) for e in entries)


def added(log: DataFrame, path: str, part: str, foreign: str | None = None, mark: int | None = None) -> bool:
    """The sums of log as the part of this name; False if the ledger has it already, and nothing is done then."""
    spark = log.sparkSession
    if _known(ledger(spark, path), part):
        return False
    summed(contributions(log, foreign)).write.mode("overwrite").parquet(f"{path}/parts/{part}")
    _enter(spark, path, part, [], mark)
    return True


def backfilled(log: DataFrame, path: str, foreign: str | None = None) -> int:
    """The history counted once: returns the largest id that it covers (-1: none), the same one at every later call.

    Streams that begin afterwards take the rows above it.
    """
    spark = log.sparkSession
    for e in ledger(spark, path):
        if e.mark is not None:
            return e.mark
    mark = log.agg(F.max("id")).first()[0]
    mark = -1 if mark is None else mark
    added(log.where(F.col("id") <= mark), path, "history", foreign, mark)
    return mark


def compacted(spark: SparkSession, path: str) -> str | None:
    """All parts summed into one that covers them; what the one before covered is deleted (readers may still be at the rest)."""
    entries = ledger(spark, path)
    parts = live(entries)
    if len(parts) < 2:
        return None
    covered = {c for e in entries for c in e.covers or ()}
    marks = [e.mark for e in entries if e.mark is not None]
    # the names of micro-batches stay known through their source's last number
    name = f"sum-{uuid.uuid4().hex}"
    summed(_parts(spark, path, parts)).write.mode("overwrite").parquet(f"{path}/parts/{name}")
    _enter(spark, path, name, parts + _lasting(covered), max(marks) if marks else None)
    for e in entries:
        if e.part in covered:
            _delete(spark, f"{path}/parts/{e.part}")
            _delete(spark, f"{path}/ledger/entry={e.part}")
    return name


def _lasting(covered: set[str]) -> list[str]:
    """Of covered parts the last batch of each source: batches come in order, and only the last one can be replayed."""
    last: dict[str, int] = {}
    for c in covered:
        source, _, n = c.rpartition("-")
        if n.isdigit():
            last[source] = max(last.get(source, -1), int(n))
    return [f"{s}-{n}" for s, n in sorted(last.items())] + (["history"] if "history" in covered else [])


def current(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All roll-ups in the common form, or one with its own columns: day, keys, measures."""
    rows = summed(_parts(spark, path, live(ledger(spark, path))))
    if name is None:
        return rows
    keys, measures = TABLES[name]
    return rows.where(F.col("rollup") == name).select("day", *[F.col(k).alias(c) for k, c in zip(KEYS, keys)], *[F.col(m).alias(c) for m, c in zip(MEASURES, measures)])


def kept_current(log: DataFrame, path: str, source: str, foreign: str | None = None, compact_after: int = COMPACT_AFTER) -> DataStreamWriter:
    """A writer (to be started with a checkpoint of its own) that adds each micro-batch of the stream to the roll-ups at path.

    source names the stream and must be its own: parts are called by it and the batch's number,
    so the batch that a restarted stream repeats is known. Events without a day count under a null
    day; late events are added to their day. Two streams may feed one path; compaction is done
    by whichever of them has the batch that makes it due, so only one of them should have it on
    (compact_after=0 turns it off).
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if added(batch, path, f"{source}-{n}", foreign) and compact_after and len(live(ledger(spark, path))) > compact_after:
            compacted(spark, path)

    return log.writeStream.foreachBatch(put)
