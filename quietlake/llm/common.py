"""What the operators share: reading tables, shared-folder tables, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; ships this package to the executors if they cannot import it.

    Texts go to Python in batches of bounded bytes and not of rows only, so that workers and Arrow's
    buffers stay small.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Python workers import the package from PYTHONPATH; where that lacks it, send it once as a zip."""
    if ROOT in os.environ.get("PYTHONPATH", "").split(":"):
        return
    sc = spark.sparkContext
    if getattr(sc, "_quietlake_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quietlake-"), "quietlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "quietlake")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    sc._quietlake_shipped = True


def discard(df: DataFrame) -> None:
    """Delete a table of written() that no later step reads."""
    path = getattr(df, "_quietlake_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, however small Spark takes it to be.

    Spark sizes a table of which an explode or a Python step makes many rows as if it made one of
    each, and a text as a few bytes. It would send such tables through the driver to all executors.
    """
    return df.hint("merge")


BATCH_ROWS, BATCH_BYTES = 2000, 8_000_000
#: Characters of text that a Python task handles at a time, besides one whole text.
SLICE_CHARS = 2_000_000


def map_texts(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, text: str = "text"
) -> DataFrame:
    """work on Arrow slices of df of at most SLICE_CHARS bytes of text (or one row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n in _cuts(batch.column(batch.schema.get_field_index(text))):
                yield from work(batch.slice(at, n))
                at += n
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory, Arrow's and numpy's, back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _cuts(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    out, rows, total = [], 0, 0
    for s in sizes:
        if rows and total + s > SLICE_CHARS:
            out.append(rows)
            rows = total = 0
        rows += 1
        total += s
    return [*out, rows] if rows else out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the smallest node of each.

    Alternating large-star and small-star steps: every step keeps connectivity and hangs nodes
    on smaller ones; a logarithmic number of rounds in practice. Edges live in the shared folder
    between rounds, never on the driver. Nodes without an edge to another node are not returned.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = (
            large.join(small, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        old, now = now, written(after, "edges")
        mark = _mark(now)
        discard(old)
        if mark == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._quietlake_path = now._quietlake_path
            return out
        before = mark
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
