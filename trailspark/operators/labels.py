"""Which of the labels of one name stay, where a feature is stored in pieces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.spatial import bbox_join
from trailspark.tables import written

_BOX = ["west", "south", "east", "north"]
_SIZE = ["size", "ax", "ay"]


def survivors(labels: DataFrame, distance: float, cell: float) -> DataFrame:
    """labels without those that a larger one of the same name stands for.

    labels: name, size (area of the whole polygon), ax, ay (the label's place) and west, south, east, north (the polygon's box), all in one
    plane; other columns stay. Of two labels the one of more size is larger, then the one farther east, then north; equal ones
    both stay, repeated rows too. A label goes if its box touches a larger one's, or, unless its name begins with a digit (an
    address), if it lies less than ``distance`` from a larger one's place. Labels that go still stand for others. Labels without a name
    stay; a null size or place counts as 0, a null side of a box as the label's place. ``cell`` is about the extent of a common box.

    The result doesn't hang on tiles: all labels of a name are compared. In a cell of which any two places are nearer than
    ``distance`` only the largest label can stay, so a few labels a cell meet the labels around them; of labels with one box
    only the largest meets other boxes.
    """
    filled = labels.where("name is not null").select("name", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _SIZE], *[F.col(c).cast("double").alias(c) for c in _BOX])
    filled = filled.select("name", *_SIZE, *[F.coalesce(c, "ax" if c in ("west", "east") else "ay").alias(c) for c in _BOX])
    known = written(filled.distinct())
    larger = F.struct(*[F.col(f"_{c}") for c in _SIZE]) > F.struct(*_SIZE)

    side = distance / math.sqrt(2) * (1 - 1e-12)
    placed = known.where(~F.col("name").rlike("^[0-9]")).withColumn("_cx", F.floor(F.col("ax") / side)).withColumn("_cy", F.floor(F.col("ay") / side))
    top = placed.groupBy("name", "_cx", "_cy").agg(F.max(F.struct(*_SIZE)).alias("_top"))
    firsts = top.select("name", "_cx", "_cy", "_top.*")  # the place of the label that may stay; its boxes follow by the join below
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    asked = firsts.withColumn("_d", around).withColumn("_cx", F.col("_cx") + F.col("_d.i")).withColumn("_cy", F.col("_cy") + F.col("_d.j")).drop("_d")
    others = placed.select("name", "_cx", "_cy", *[F.col(c).alias(f"_{c}") for c in _SIZE]).distinct()
    beaten = asked.join(others, ["name", "_cx", "_cy"]).where(larger & (F.hypot(F.col("ax") - F.col("_ax"), F.col("ay") - F.col("_ay")) < distance)).select("name", *_SIZE).distinct()
    apart = firsts.drop("_cx", "_cy").join(beaten, ["name", *_SIZE], "left_anti")
    left = written(known.join(apart, ["name", *_SIZE], "left_semi").unionByName(known.where(F.col("name").rlike("^[0-9]"))))

    boxes = known.groupBy("name", *_BOX).agg(F.max(F.struct(*_SIZE)).alias("_m")).select(F.col("name").alias("_name"), *[F.col(c).alias(f"r_{c}") for c in _BOX], *[F.col(f"_m.{c}").alias(f"_{c}") for c in _SIZE])
    candidates = left.groupBy("name", *_BOX).agg(F.max(F.struct(*_SIZE)).alias("_m")).select("name", *[F.col(c).alias(f"l_{c}") for c in _BOX], *[F.col(f"_m.{c}").alias(c) for c in _SIZE])
    met = bbox_join(candidates, boxes, cell, [("name", "_name")]).where(larger)
    touched = met.select("name", *_SIZE, *[F.col(f"l_{c}").alias(c) for c in _BOX]).distinct()
    kept = left.join(left.groupBy("name", *_BOX).agg(F.max(F.struct(*_SIZE)).alias("_m")), ["name", *_BOX]).where(F.struct(*_SIZE) == F.col("_m")).drop("_m")
    kept = written(kept.join(touched, ["name", *_SIZE, *_BOX], "left_anti"))

    sides = {c: F.coalesce(F.col(c).cast("double"), F.coalesce(F.col("ax" if c in ("west", "east") else "ay").cast("double"), F.lit(0.0))) for c in _BOX}
    again = labels.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_k{c}") for c in _SIZE], *[v.alias(f"_k{c}") for c, v in sides.items()])
    keys = ["name", *_SIZE, *_BOX]
    staying = again.join(kept.select(F.col("name").alias("_kname"), *[F.col(c).alias(f"_j{c}") for c in keys[1:]]), (F.col("name") == F.col("_kname")) & _all_equal(keys[1:]), "left_semi")
    return staying.select(*labels.columns).unionByName(labels.where("name is null"))


def _all_equal(columns: list[str]):
    met = F.lit(True)
    for c in columns:
        met = met & (F.col(f"_k{c}") == F.col(f"_j{c}"))
    return met
