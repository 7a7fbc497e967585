"""Folds over ordered rows that keep a small state, without a whole track in one row or one task.

Rows are range-partitioned by track and order, so a long track runs over many partitions. Each partition is folded on
its own, and only the states at its borders, one row a partition, go to the driver, which hands each on to the partition that
continues the track. Rows come out in a last pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from trailspark.tables import written

#: Consecutive rows of one track as lists by column, and a state of JSON values, to the next state and rows for the output.
Step = Callable[[tuple, dict[str, list]], tuple[tuple, list[tuple]]]


def _pieces(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Any, dict[str, list]]]:
    """Runs of rows with equal partition and track: partition, track, columns."""
    for batch in batches:
        columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
        parts, keys = columns.pop("_part"), columns[by]
        begin = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or keys[k] != keys[begin] or parts[k] != parts[begin]:
                yield parts[begin], keys[begin], {n: c[begin:k] for n, c in columns.items()}
                begin = k


def folded(rows: DataFrame, by: str, order: list[str], start: tuple, step: Step, out: str, finish: Callable[[tuple], list[tuple]] | None = None) -> DataFrame:
    """by and the columns ``out`` of what ``step`` gives while it goes through each track's rows in order.

    ``finish`` gives further rows from a track's last state. Tracks may be null, which is one track; columns of ``rows``
    other than those that ``step`` reads should be left out. Rows of equal order come in any order, so ``order`` should
    tell all apart; integers, texts and times are safe to order by. The state is kept as JSON: numbers, texts, truth
    values and null in a flat tuple.

    Passes over the rows: one to write them in order, one that folds each partition, one for each further partition that
    one and the same track fills alone (they wait for each other), and one for the output. A track that is shorter than
    a partition costs none of the further ones.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    sorted_ = written(rows.repartitionByRange(n, F.col(by).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id()))

    def parts(chosen: list[int] | None) -> DataFrame:
        df = sorted_ if chosen is None else sorted_.where(F.col("_part").isin(chosen))
        return df.repartition(n, "_part").sortWithinPartitions("_part", F.col(by).asc_nulls_first(), *order)

    def borders(given: dict[int, tuple]) -> dict[int, dict]:
        """Of each partition: first and last track, whether they are the same run, the state behind it."""
        known = {p: json.dumps(s) for p, s in given.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, first, key, state, single = None, None, None, start, True
            done = []
            for at, now, piece in _pieces(batches, by):
                if at != part:
                    if part is not None:
                        done.append((part, json.dumps([first, key], default=str), single, json.dumps(state)))
                    part, first, key, single = at, now, now, True
                    state = tuple(json.loads(known[at])) if at in known else start
                elif now != key:
                    key, state, single = now, start, False
                state, _ = step(state, piece)
            if part is not None:
                done.append((part, json.dumps([first, key], default=str), single, json.dumps(state)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, (pa.int32(), pa.string(), pa.bool_(), pa.string()))], names=["part", "ends", "single", "state"])

        met = parts(list(given) or None).mapInArrow(run, "part int, ends string, single boolean, state string").collect()  # a row a partition
        return {r["part"]: {"first": json.loads(r["ends"])[0], "last": json.loads(r["ends"])[1], "single": r["single"], "state": tuple(json.loads(r["state"]))} for r in met}

    at = borders({})
    used = sorted(at)
    goes_on = {b for a, b in zip(used, used[1:]) if at[a]["last"] == at[b]["first"]}
    incoming: dict[int, tuple] = {}
    before = dict(zip(used[1:], used))
    final = {p for p in used if p not in goes_on or not at[p]["single"]}  # their last state doesn't hang on what comes in
    while len(final) < len(used):
        ready = {p: at[before[p]]["state"] for p in used if p not in final and before[p] in final}
        for p, found in borders(ready).items():
            at[p]["state"] = found["state"]
        final |= set(ready)
    for p in goes_on:
        incoming[p] = at[before[p]]["state"]
    held = {p: json.dumps(s) for p, s in incoming.items()}
    open_ends = {before[p] for p in goes_on}
    schema = StructType([sorted_.schema[by], *_parse_datatype_string(out).fields])
    types = list(to_arrow_schema(schema))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, state, ready = None, None, start, []

        def ended(closing: bool) -> list[tuple]:
            if part is None or finish is None or (closing and part in open_ends):
                return []
            return [(key, *r) for r in finish(state)]

        for p, now, piece in _pieces(batches, by):
            if p != part:
                ready += ended(True)
                part, key = p, now
                state = tuple(json.loads(held[p])) if p in held else start
            elif now != key:
                ready += ended(False)
                key, state = now, start
            state, given = step(state, piece)
            ready += [(key, *r) for r in given]
            if len(ready) > 10_000:
                yield _batch(ready, types)
                ready = []
        ready += ended(True)
        yield _batch(ready, types)

    return parts(None).select(*names, "_part").mapInArrow(emit, schema)


def _batch(rows: list[tuple], types: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], names=[f.name for f in types])
