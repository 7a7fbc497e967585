"""Elevation rasters as rows of (row, col, h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terrain_rgb(h: Column) -> tuple[Column, Column, Column]:
    """Height as three bytes: tenths of a metre above -10000, halves to even; below zero counts as zero."""
    v = F.bround((F.greatest(h, F.lit(0)) + 10000) * 10).cast("long")
    return F.shiftright(v, 16).bitwiseAND(F.lit(255)), F.shiftright(v, 8).bitwiseAND(F.lit(255)), v.bitwiseAND(F.lit(255))


def bilinear(points: DataFrame, raster: DataFrame, rows: int, cols: int) -> DataFrame:
    """Points (id, y, x in raster coordinates) with height z between their four neighbours; null outside the raster.

    Each point asks for its four cells in one equi-join on the cell; weights sum in one aggregate.
    """
    inside = F.col("y").between(0, rows - 1) & F.col("x").between(0, cols - 1)
    r0, c0 = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - r0, F.col("x") - c0
    corner = lambda dr, dc, w: F.struct(F.least(r0 + dr, F.lit(rows - 1)).alias("row"), F.least(c0 + dc, F.lit(cols - 1)).alias("col"), w.alias("w"))
    asked = points.withColumn("c", F.explode(F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx)))).select("id", inside.alias("inside"), "c.*")
    met = asked.join(raster, ["row", "col"], "left")
    return met.groupBy("id").agg(F.when(F.first("inside"), F.sum(F.col("w") * F.coalesce("h", F.lit(0)))).alias("z"))


def decimated(raster: DataFrame, step: int) -> DataFrame:
    return raster.where((F.col("row") % step == 0) & (F.col("col") % step == 0))
