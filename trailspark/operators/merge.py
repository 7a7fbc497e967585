"""Edited collections: last writer wins, deletions, restores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times further ahead than this are held there.
AHEAD_MS = 5 * 60 * 1000


def changed(df: DataFrame) -> DataFrame:
    """Adds ``changed``: when a row was last written."""
    return df.withColumn("changed", F.coalesce("updated", "added"))


def deletions(local: DataFrame, remote: DataFrame, now_ms: int) -> DataFrame:
    """The latest deletion of each id on either side, none beyond now and five minutes."""
    return local.unionByName(remote).groupBy("id").agg(F.least(F.max("at"), F.lit(now_ms + AHEAD_MS)).alias("at"))


def last_writer(local: DataFrame, remote: DataFrame, deleted: DataFrame, now_ms: int) -> DataFrame:
    """id, side and changed of the rows that stay: the later change wins, equal ones stay local, and a deletion at or after it removes.

    Times are compared as they are; the winner's is then held at now and five minutes.
    """
    a = changed(local).select("id", F.col("changed").alias("l"))
    b = changed(remote).select("id", F.col("changed").alias("r"))
    both = a.join(b, "id", "full_outer").select("id", F.when(F.col("l").isNull() | (F.col("r") > F.col("l")), "remote").otherwise("local").alias("side"), F.least(F.greatest("l", "r"), F.lit(now_ms + AHEAD_MS)).alias("changed"))
    return both.join(deleted, "id", "left").where("at is null or at < changed").select("id", "side", "changed")


def restorable(incoming: DataFrame, here: DataFrame, deleted: DataFrame) -> DataFrame:
    """Incoming rows that are new here or newer, and not deleted at or after their change."""
    i = changed(incoming).select("id", "changed")
    known = changed(here).select("id", F.col("changed").alias("mine"))
    return i.join(known, "id", "left").join(deleted, "id", "left").where("(mine is null or changed > mine) and (at is null or at < changed)").select("id", "changed")


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Current rows, those of new in the place of rows with their key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def delete(current: DataFrame, gone: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The rows without those of ``ids`` (id), and the deletions with these, at now in the place of earlier ones.

    Undoing an addition is the same: the added rows go and leave deletions.
    """
    ids = ids.select("id").where("id is not null").distinct()
    return current.join(ids, "id", "left_anti"), gone.join(ids, "id", "left_anti").unionByName(ids.withColumn("at", F.lit(now_ms).cast(gone.schema["at"].dataType)))


def put_back(current: DataFrame, gone: DataFrame, rows: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The rows with ``rows`` in their place, changed now, and the deletions without theirs: the undoing of a deletion."""
    stamped = rows.withColumn("updated", F.lit(now_ms).cast(current.schema["updated"].dataType))
    return upsert(current, stamped), gone.join(rows.select("id"), "id", "left_anti")


def restore(current: DataFrame, gone: DataFrame, backup: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """What of a backup is new here or newer and wasn't deleted since comes back, changed now; nothing is deleted."""
    return put_back(current, gone, backup.join(restorable(backup, current, gone).select("id"), "id", "left_semi"), now_ms)
