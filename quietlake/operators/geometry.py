"""Boxes of recognised text: place characters, merge rows, drop duplicates, tile, turn back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(c: Column) -> Column:
    """2 for East Asian wide characters, else 1."""
    return F.when(c.rlike("[\\u1100-\\u115f\\u2e80-\\u303e\\u3041-\\ua4cf\\uac00-\\ud7a3\\uf900-\\ufaff\\ufe30-\\ufe6f\\uff00-\\uff60\\uffe0-\\uffe6]"), 2).otherwise(1)


def width(text: Column) -> Column:
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc + wide(c))


def x_range(text: Column, start: Column, stop: Column, x1: Column, x2: Column) -> Column:
    """struct(x1, x2) of the characters [start, stop) of a line, by widths, padded by half a unit and 4 %."""
    unit = (x2 - x1) / F.greatest(width(text), F.lit(1))
    a = x1 + unit * width(F.substr(text, F.lit(1), start))
    b = x1 + unit * width(F.substr(text, F.lit(1), stop))
    pad = unit * 0.5 + (b - a) * 0.04
    return F.struct(F.greatest(a - pad, x1).alias("x1"), F.least(b + pad, x2).alias("x2"))


def tiles(w: Column, h: Column, size: int = 1600, overlap: int = 120, most: int = 16) -> Column:
    """array<struct<x, y>> of tile corners that cover the image; null if it takes more than `most`."""
    step = size - overlap
    starts = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step) - 1, F.lit(0))), lambda i: F.greatest(F.least(i * step, n - size), F.lit(0)).cast("long"))
    grid = F.flatten(F.transform(starts(h), lambda y: F.transform(starts(w), lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return F.when(F.size(grid) <= most, grid)


def without_duplicates(blocks: DataFrame, image: str = "image_id", near: float = 24.0) -> DataFrame:
    """Of blocks of equal text at most `near` apart in y that overlap by half in x only the best score stays.

    blocks: image_id, id, text, x1, y1, x2, y2, score. A range join within (image, text).
    """
    a, b = blocks.alias("a"), blocks.alias("b")
    overlap = F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1")
    narrow = F.least(F.col("a.x2") - F.col("a.x1"), F.col("b.x2") - F.col("b.x1"))
    better = (F.col("b.score") > F.col("a.score")) | ((F.col("b.score") == F.col("a.score")) & (F.col("b.id") < F.col("a.id")))
    on = (F.col(f"a.{image}") == F.col(f"b.{image}")) & (F.col("a.text") == F.col("b.text")) & (F.abs(F.col("a.y1") - F.col("b.y1")) <= near) & (overlap > narrow * 0.5) & better
    return a.join(b, on, "left_anti")


def rows(blocks: DataFrame, image: str = "image_id", gap: float = 0.5) -> DataFrame:
    """Blocks of one line as one box: the next block belongs to it if it begins before the line's middle."""
    w = Window.partitionBy(image).orderBy("y1", "x1", "id")
    bottom = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (bottom.isNull() | (F.col("y1") > bottom - gap * (F.col("y2") - F.col("y1")))).cast("int")
    line = blocks.withColumn("_new", new).withColumn("line", F.sum("_new").over(w))
    return line.groupBy(image, "line").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("blocks"))


def turned_back(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """struct(x, y) in the upright image (w x h) of a point of the image turned clockwise by 0, 90, 180 or 270."""
    return (
        F.when(degrees == 90, F.struct(y.alias("x"), (h - x).alias("y")))
        .when(degrees == 180, F.struct((w - x).alias("x"), (h - y).alias("y")))
        .when(degrees == 270, F.struct((w - y).alias("x"), x.alias("y")))
        .otherwise(F.struct(x.alias("x"), y.alias("y")))
    )
