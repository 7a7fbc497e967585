"""Folds over fixes as streams: a state of a few numbers for each track, carried from batch to batch.

A batch's rows of one track are put in order and folded on from the state; batches must come in order, as a recorder
sends them, and a late row counts where it arrives. A task holds one track's rows of one batch, which the source's
limit on files of a trigger bounds; a track's history isn't kept. Fixes without a known value change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailspark.operators import sequence
from trailspark.tables import shared_folder, written


def folded(stream: DataFrame, by: str, order: str, start: tuple, step: Callable, state: str, out: str) -> DataFrame:
    """Append-mode stream of what ``step(state, rows in order)`` gives beside the next state; ``by`` is its first column."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        now, given = step(held.get if held.exists else start, rows)
        held.update(now)
        given.insert(0, by, key[0])
        yield given

    return stream.groupBy(by).applyInPandasWithState(one, f"{by} {stream.schema[by].dataType.simpleString()}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def off_route(stream: DataFrame, by: str = "track", order: str = "n", far: float = 50.0, near: float = 25.0, rough: float = 60.0, needed: int = 3) -> DataFrame:
    """by, upto (last order value), off and times (how often the track went off so far) for each batch of fixes with off and accuracy."""

    start, fold = sequence.off_route("off", "accuracy", far, near, rough, needed)

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (count, off, times), _ = fold(state, _lists(rows))
        return (count, off, times), pd.DataFrame({"upto": [int(rows[order].iloc[-1])], "off": [off], "times": [times]})

    return folded(stream, by, order, start, step, "count int, off boolean, times int", "upto long, off boolean, times int")


def speed(stream: DataFrame, by: str = "track", order: str = "n", value: str = "ele", factor: float = 0.4) -> DataFrame:
    """by, upto and speed, the exponential mean so far, for each batch; null until a value is known."""

    start, fold = sequence.smoothed(value, factor)

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (now,), _ = fold(state, _lists(rows))
        return (now,), pd.DataFrame({"upto": [int(rows[order].iloc[-1])], "speed": pd.Series([now], dtype="float64")})

    return folded(stream, by, order, start, step, "speed double", "upto long, speed double")


def thinned(stream: DataFrame, by: str = "track", order: str = "n", keep_m: float = 10.0, turn_m: float = 3.0, turn_deg: float = 20.0) -> DataFrame:
    """by, at (order value), lon and lat of the fixes a recorder keeps: far from the last kept, or less far after a turn."""

    start, fold = sequence.thinned(order, keep_m, turn_m, turn_deg)

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        now, kept = fold(state, _lists(rows))
        return now, pd.DataFrame(kept, columns=["at", "lon", "lat"]).astype({"at": "int64", "lon": "float64", "lat": "float64"})

    return folded(stream.where("lon is not null and lat is not null"), by, order, start, step, "lon double, lat double, heading double", "at long, lon double, lat double")


def _lists(rows: pd.DataFrame) -> dict[str, list]:
    return {c: rows[c].tolist() for c in rows.columns}


def replay(rows: DataFrame, time: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a fold's sink holds after the earlier and the later half of a table came in, each in a run of its own.

    The second run starts from the first one's checkpoint, as after a lost driver. Rows without a time come first.
    """
    spark, rows = rows.sparkSession, written(rows)
    source, sink, marks = (shared_folder(spark) for _ in range(3))
    cut = rows.select(F.percentile_approx(time, 0.5).alias("cut")).first()["cut"]
    early = F.coalesce(F.col(time) <= F.lit(cut), F.lit(True))
    for part in (rows.where(early), rows.where(~early)):
        part.write.mode("append").parquet(source)
        given = fold(spark.readStream.schema(rows.schema).parquet(source))
        given.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(given.schema).parquet(sink)
