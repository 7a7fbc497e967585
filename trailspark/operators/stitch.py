"""Lines joined where they meet end to end, as ordered chains, by list ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.tables import written


def stitched(lines: DataFrame, group: list[str]) -> DataFrame:
    """line, chain (its least line), place in the chain (from 0) and reversed: whether the chain runs along the line backwards.

    lines: line (long, unique, not below nought), the columns of ``group``, within which lines are joined, and head and
    tail, the places of its ends. Ends at an unknown place, and lines without a group column's value, join nothing.

    Where two ends of a group meet, their lines join; where more meet, they join two by two in the order of lines (heads
    before tails), and one may be left. A line that ends where it begins, with no end before it there, closes on itself. A chain runs as its least
    line does; a ring begins with it.

    Each line is passed in one of two directions, and each such passage knows the next. Passages double their reach every
    round, with the least passage on the way, until they see the chain's end; what never does is a ring, which is then cut
    before its least line. Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    known = lines.select("line", *group, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("at")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("at")))).alias("e"))
    ends = known.select("line", *group, "e.side", "e.at").where(" and ".join(f"`{c}` is not null" for c in [*group, "at"]))
    w = Window.partitionBy(*group, "at").orderBy("line", "side")
    end, k = F.struct("line", "side"), F.row_number().over(w)
    met = ends.withColumn("_o", F.when(k % 2 == 1, F.lead(end).over(w)).otherwise(F.lag(end).over(w))).where("_o is not null")
    # passage 2 * line runs from head to tail, 2 * line + 1 back; the one that leaves by a side goes on from the other end's side
    nexts = met.select((F.col("line") * 2 + 1 - F.col("side")).alias("p"), (F.col("_o.line") * 2 + F.col("_o.side")).alias("next"))
    passages = lines.select(F.explode(F.array(F.col("line") * 2, F.col("line") * 2 + 1)).alias("p"))
    now = passages.join(nexts, "p", "left")
    done, rings = _ranked(now)
    if not rings.isEmpty():
        cut = rings.join(now, "p").select("p", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"))
        opened, _ = _ranked(cut)
        done = done.unionByName(opened)
    chains = done.groupBy("last").agg(F.min("p").alias("chain"), F.max("left").alias("length")).where("chain % 2 = 0")
    found = done.join(chains, "last")
    return found.select(F.floor(F.col("p") / 2).alias("line"), F.floor(F.col("chain") / 2).alias("chain"), (F.col("length") - F.col("left")).alias("place"), (F.col("p") % 2 == 1).alias("reversed"))


def _ranked(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """p with its chain's last passage and how many are left to it; and p of rings with the least passage there."""
    now = written(passages.select("p", F.coalesce("next", "p").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left"), F.col("next").isNull().alias("ended"), F.least("p", F.coalesce("next", "p")).alias("least")))
    before = None
    while True:
        mark = now.where("not ended").agg(F.count("*"), F.sum(F.col("least").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == before:
            break
        before = tuple(mark)
        reach = now.select(F.col("p").alias("last"), F.col("last").alias("_last"), F.col("left").alias("_left"), F.col("ended").alias("_ended"), F.col("least").alias("_least"))
        on = now.where("not ended").join(reach, "last").select("p", F.col("_last").alias("last"), (F.col("left") + F.col("_left")).alias("left"), F.col("_ended").alias("ended"), F.least("least", "_least").alias("least"))
        now = written(now.where("ended").unionByName(on))
    return now.where("ended").select("p", "last", "left"), now.where("not ended").select("p", "least")
