"""Points grouped around the first of their neighbourhood, as a walk over them in order would, but in parallel."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.tables import written

#: Cells along a block's side, and points of a cell that a block's task looks at in one round.
BLOCK, FIRST = 16, 64


def _around(reach: int = 2) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))


def _founders(radius: float):
    """Founders among a block's own points, as far as they can be told."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        horizon = {}
        for cx, cy, h in zip(rows["cx"], rows["cy"], rows["horizon"]):
            if h == h and h is not None:
                horizon[cx, cy] = h
        founded: dict[tuple, list] = {}
        waiting: dict[tuple, list] = {}
        near = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
        out = []
        for n, x, y, cx, cy, own in zip(rows["n"], rows["x"], rows["y"], rows["cx"], rows["cy"], rows["own"]):
            cells = [(cx + i, cy + j) for i, j in near]
            within = lambda held: any((x - a) * (x - a) + (y - b) * (y - b) <= radius * radius for c in cells for a, b in held.get(c, ()))  # noqa: E731, B023
            if within(founded):
                continue
            if not own or any(horizon.get(c, math.inf) < n for c in cells) or within(waiting):
                waiting.setdefault((cx, cy), []).append((x, y))
                continue
            founded.setdefault((cx, cy), []).append((x, y))
            out.append(n)
        return rows[rows["n"].isin(out)][["by", "n", "x", "y", "cx", "cy"]]

    return run


def clustered(points: DataFrame, by: str, radius: float) -> DataFrame:
    """by, n and founder: the point (by its n) whose group each point is in.

    points: by (texts or whole numbers, null is one of its own), n (whole number, unique in ``by``, the order in which points are taken), x, y; points
    without a place take no part. A point joins the nearest founder before it within ``radius``, the border included,
    or founds a group. Of founders at one distance the one in the lesser column, then row, of cells of ``radius`` counts, then the earlier.

    Founders are those that a walk in the order of n would choose. A point is one if no founder before it is near and no point
    before it is near that isn't decided yet. Blocks of cells decide what they can on their own, given the points
    around them; what hangs on another block waits for a round. Two points of a cell are always near each other, so each cell
    has one founder at most, and a block looks at the first 64 open points of a cell alone: what is later than those waits,
    too, and mostly goes at once with the next founder. So a round's tasks are bounded however many points lie at one place.
    """
    side = radius / math.sqrt(2) * (1 - 1e-12)
    known = points.select(F.col(by).cast("string").alias("by"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    known = known.withColumn("by", F.coalesce(F.concat(F.lit("="), "by"), F.lit("null")))  # a text of its own for null
    known = written(known.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)))
    near = (F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy")) <= radius * radius

    def reaching(founders: DataFrame) -> DataFrame:
        spread = founders.withColumn("d", _around())
        return spread.select("by", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), F.col("n").alias("founder"), F.col("x").alias("fx"), F.col("y").alias("fy"))

    open_, all_founders = known, None
    schema = "by string, n long, x double, y double, cx long, cy long"
    while not open_.isEmpty():
        w = Window.partitionBy("by", "cx", "cy").orderBy("n")
        firsts = open_.withColumn("k", F.row_number().over(w)).where(F.col("k") <= FIRST + 1)
        horizon = firsts.withColumn("horizon", F.max(F.when(F.col("k") == FIRST + 1, F.col("n"))).over(Window.partitionBy("by", "cx", "cy"))).where(F.col("k") <= FIRST).drop("k")
        block = lambda c, d: F.floor((F.col(c) + d) / BLOCK)
        shown = F.array_distinct(F.array(*[F.struct(block("cx", i).alias("bx"), block("cy", j).alias("by_")) for i in (-2, 0, 2) for j in (-2, 0, 2)]))
        rows = horizon.withColumn("b", F.explode(shown)).select("*", "b.bx", "b.by_", ((F.col("b.bx") == block("cx", 0)) & (F.col("b.by_") == block("cy", 0))).alias("own")).drop("b")
        new = written(rows.groupBy("by", "bx", "by_").applyInPandas(_founders(radius), schema))
        all_founders = new if all_founders is None else all_founders.unionByName(new)
        reach = reaching(new)
        gone = open_.join(reach, ["by", "cx", "cy"]).where(near).select("by", "n").distinct()
        open_ = written(open_.join(gone, ["by", "n"], "left_anti"))
    if all_founders is None:
        return points.limit(0).select(by, "n", F.col("n").cast("long").alias("founder"))
    met = known.join(reaching(all_founders), ["by", "cx", "cy"]).where(near & (F.col("founder") <= F.col("n")))
    d2 = (F.col("fx") - F.col("x")) * (F.col("fx") - F.col("x")) + (F.col("fy") - F.col("y")) * (F.col("fy") - F.col("y"))
    best = met.groupBy("by", "n").agg(F.min(F.struct(d2.alias("d2"), F.floor(F.col("fx") / radius).alias("i"), F.floor(F.col("fy") / radius).alias("j"), "founder")).alias("b"))
    return best.select(F.when(F.col("by") != "null", F.substring("by", 2, 1 << 30)).cast(points.schema[by].dataType).alias(by), "n", F.col("b.founder").alias("founder"))
