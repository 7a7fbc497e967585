"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark import tables
from trailspark.tables import shared_folder, written

__all__ = ["bounded_share", "free_name", "in_share", "remainder", "shared_folder", "table", "written"]


#: Rows of whole texts that go to a Python worker at once; the default of 10,000 would hold tens of MB several times over.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; lowers the session's Arrow batches to BATCH_ROWS where nothing else is set."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return tables.table(spark, sf_dir, name)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's text modulo n; -1 for a null id, so that it is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(-1).cast("long"))


def free_name(name: str, df: DataFrame) -> str:
    """name, or one with further underscores that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_share(total: int, bound: int) -> int:
    """Share, in 2^20ths, of ``total`` rows that gives about ``bound`` of them."""
    return 1 << 20 if total <= bound else max(1, (bound << 20) // total)


def in_share(key: Column | str, share: Column | int, seed: int = 17) -> Column:
    """Whether a row's key falls into a share given in 2^20ths; depends on the key alone, not on partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < share
