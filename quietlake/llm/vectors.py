"""Shared by the two vector searches: valid rows, blocks of bounded size, the merge of partial results."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def valid_vectors(rows: DataFrame, component: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(row, vec_id, vec): vectors of doubles, each component as component() makes it, in the shared folder.

    row is a number of each row's own, fixed by writing the table: vec_ids may repeat. Null vectors,
    and those with null or non-finite components, take no part; nor do rows with a null vec_id or an
    empty vector. Vectors of different lengths have no inner product: those of the commonest
    length (of equally common ones the longer) take part.
    """
    sized = F.size("embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where(F.col("vec_id").isNotNull() & (sized > 0) & fine)
    common = out.groupBy(sized.alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    vec = F.transform("embedding", lambda x: component(x.cast("double")))
    out = out.where(sized == (common["n"] if common else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return written(out.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec"), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


def sample(vectors: DataFrame, most: int, rows: int) -> np.ndarray:
    """At most `most` of the vectors, those with the smallest hashes: the same for any partitioning."""
    h = F.abs(F.xxhash64("vec_id", "vec"))
    part = vectors.where(h / float(2**63) < min(1.0, 1.2 * most / max(rows, 1) + 0.001))
    found = part.select(h.alias("h"), "vec_id", "vec").orderBy("h", "vec_id").limit(most)
    got = found.select("vec").toArrow()
    return matrix(got.column(0), got.num_rows)


def blocks_of(rows: int, block: int) -> int:
    return max(1, math.ceil(rows / block))


def bucket(n: Column | int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(n) if isinstance(n, int) else n).cast("int")


def best(partial: DataFrame, k: int) -> DataFrame:
    """Of (query, query_id, vec_id, row, score) the k best of each query with their rank, ties to the smaller vec_id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def answer(ranked: DataFrame, kind: str) -> DataFrame:
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(kind).alias("score"))
