"""Operators on ordered rows: runs, and the steps of folds that keep a state (see ``folding.folded`` and ``streaming.folds``).

A step takes a state and consecutive rows of one track, as lists by column, and gives the next state and rows for the output.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import ROUTE_M
from trailspark.operators.folding import Step


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Numbered runs of equal neighbours: by, run (from 1), value, n, first and last of the first order column."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def _unknown(v: float | None) -> bool:
    return v is None or v != v


def climb(value: str, threshold: float = 3.0) -> tuple[tuple, Step]:
    """Start and step for metres climbed: a rise counts once it is ``threshold`` above the last low or counted height.

    State: that height and the total, both null before a height is known.
    """

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        ref, total = state
        for h in rows[value]:
            if _unknown(h):
                continue
            if ref is None or h < ref:
                ref = h
            elif h - ref >= threshold:
                ref, total = h, (total or 0.0) + h - ref
            total = total or 0.0
        return (ref, total), []

    return (None, None), step


def spaced(along: str, position: str, spacing: float) -> tuple[tuple, Step]:
    """Positions kept of rising distances: the first, and each at least ``spacing`` from the one kept before.

    State: the distance kept last, and the last position if it isn't kept (a track's last one is to be kept, too).
    """

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        at, open_ = state
        kept = []
        for d, i in zip(rows[along], rows[position]):
            keep = at is None or d - at >= spacing
            at, open_ = (d, None) if keep else (at, i)
            kept += [(i,)] if keep else []
        return (at, open_), kept

    return (None, None), step


def smoothed(value: str, factor: float) -> tuple[tuple, Step]:
    """Exponential mean; the first known value is taken as it is, unknown ones change nothing. State: the mean."""

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        (now,) = state
        for v in rows[value]:
            if not _unknown(v):
                now = float(v) if now is None else now + factor * (float(v) - now)
        return (now,), []

    return (None,), step


def held(ideal: str, size: float = 0.5, margin: float = 0.15) -> tuple[tuple, Step]:
    """A value that follows ``ideal`` in steps, once it is off by more than half a step and the margin. State: the value."""

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        (now,) = state
        for v in rows[ideal]:
            if not _unknown(v) and (now is None or abs(v - now) >= size / 2 + margin):
                now = math.floor(v / size + 0.5) * size
        return (now,), []

    return (None,), step


def off_route(off: str, accuracy: str, far: float = 50.0, near: float = 25.0, rough: float = 60.0, needed: int = 3) -> tuple[tuple, Step]:
    """How often a track goes off its route: the ``needed``-th far fix in a row, rough ones ignored. State: count, off, times."""

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        count, off_now, times = state
        for metres, acc in zip(rows[off], rows[accuracy]):
            if _unknown(metres):
                continue
            if metres <= near:
                count, off_now = 0, False
            elif metres > far and not _unknown(acc) and acc <= rough:
                count += 1
                times += count >= needed and not off_now
                off_now = off_now or count >= needed
        return (count, off_now, times), []

    return (0, False, 0), step


def mode_after(event: str) -> tuple[tuple, Step]:
    """State of the follow mode: a tap goes off, north, heading, north; a drag pauses; a long press ends. State: mode, paused."""

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        mode, paused = state
        for e in rows[event]:
            if e == "long":
                mode, paused = "off", False
            elif e == "drag":
                paused = mode != "off"
            elif e == "tap":
                mode, paused = mode if paused else "heading" if mode == "north" else "north", False
        return (mode, paused), []

    return ("off", False), step


def thinned(position: str, keep_m: float = 10.0, turn_m: float = 3.0, turn_deg: float = 20.0) -> tuple[tuple, Step]:
    """position, lon and lat of the fixes a recorder keeps: far from the last kept, or less far where the way turns.

    The way's direction is the bearing from the last kept fix, compared with the one at which that fix was reached; the
    first fix has none. State: the last kept fix and its bearing. Fixes without a place change nothing.
    """

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        lon, lat, heading = state
        kept = []
        for i, x, y in zip(rows[position], rows["lon"], rows["lat"]):
            if _unknown(x) or _unknown(y):
                continue
            way = None
            if lon is not None:
                d, way = metres_between(lon, lat, x, y), bearing_of(lon, lat, x, y)
                turned = heading is not None and d >= turn_m and abs((way - heading + 540.0) % 360.0 - 180.0) >= turn_deg
                if d < keep_m and not turned:
                    continue
            lon, lat, heading = float(x), float(y), way
            kept.append((i, lon, lat))
        return (lon, lat, heading), kept

    return (None, None, None), step


def metres_between(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """As ``geo.haversine_m``."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * ROUTE_M * math.asin(min(1.0, math.sqrt(h)))


def bearing_of(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Initial great-circle bearing, -180 to 180."""
    d, a, b = math.radians(lon2 - lon1), math.radians(lat1), math.radians(lat2)
    return math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d)))
