"""Operator 5 [native]: proportional stratified interleaving into shards.

Rows of each source are put in a seeded order, rows of all sources are sorted by their
fractional rank in it, and the sorted sequence is cut into shards of equal length. Each
shard then holds every source in proportion, and shard sizes differ by one row at most.

Ranks are made without a window over a whole source or over all rows: a first digit of the
seeded key (and later of the fractional rank) deals rows to about sqrt(rows) small buckets,
a count per bucket gives what lies before it, and a window numbers the rows of one bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 8
SEED = 20240501


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum.

    Law 'rows': shard counts differ by one at most. size is the UTF-8 bytes of the text (null:
    none) plus 1; the CRC of a null text is 0, as that of an empty one. A null source is a source
    of its own, a null doc_id is ordered as an empty string; the text is part of the order, so rows
    that share a doc_id or have none are dealt apart. Rows equal in every column read
    here are interchangeable, so any order among them gives the same result. An empty table
    gives no rows. Other columns of docs are not read.
    """
    digits = max(1, math.ceil(math.log(max(docs.count(), 1), 16) / 2))
    parts = 16**digits
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("(null)")).alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text).cast("string"))).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    ).withColumn("b", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))

    before = Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    sizes = rows.groupBy("stratum", "b").agg(F.count("*").alias("c"))
    sizes = sizes.select(
        "stratum", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(whole).alias("n")
    )
    number = F.row_number().over(Window.partitionBy("stratum", "b").orderBy("key", "doc_id", "text_crc32", "size"))
    ranked = rows.join(sizes, ["stratum", "b"]).withColumn("r", F.col("base") + number - 1)
    ranked = ranked.withColumn("fb", F.expr(f"((2 * r + 1) * {parts}L) div (2 * n)"))

    each = ranked.groupBy("fb").agg(F.count("*").alias("c"))
    line = Window.orderBy("fb")
    each = each.select(
        "fb",
        F.coalesce(F.sum("c").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("fbase"),
        F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    order = [((2 * F.col("r") + 1) / (2 * F.col("n"))), "stratum", "key", "doc_id", "text_crc32", "size"]
    place = F.col("fbase") + F.row_number().over(Window.partitionBy("fb").orderBy(*order)) - 1
    out = ranked.join(each, "fb").withColumn("pos", place)
    out = out.withColumn("shard", F.expr(f"cast((pos * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "stratum",
    )


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents")).drop("stratum")


QUERIES = {"op5_stratified_shards": op5_stratified_shards}
ORACLE_SQL: dict[str, str] = {}
