"""Road graphs as node and edge tables: components, reachability and shortest paths by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.tables import written

#: Edges that are contracted at once.
_CHUNK = 1_000_000


def connected(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for the nodes of edges (src, dst of type long).

    Alternates two steps, each an aggregate with partial sums and a join back: larger neighbours move to a node's
    least neighbour, then smaller ones do. Rounds grow with the logarithm of the nodes; each is written to the
    shared folder, so a lost executor costs one round.
    """
    now = written(edges.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        now = written(down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst of type long) with the same components but short ways: near nodes are tied to the least of theirs.

    Edges are dealt by ranges of src, so where numbers follow places a task ties a whole piece of the net together and
    ``connected`` takes rounds by the pieces. Self-loops go.
    """

    def tied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= _CHUNK:
                yield _stars(held)
                held = []
        if held:
            yield _stars(held)

    return edges.where("src != dst").select("src", "dst").repartitionByRange("src").mapInPandas(tied, "src long, dst long")


def _stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Each node but the least of each component of these edges, with that."""
    ends = np.concatenate([p[c].to_numpy(np.int64) for c in ("src", "dst") for p in parts])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    tied = label != np.arange(len(nodes))
    return pd.DataFrame({"src": nodes[tied], "dst": nodes[label[tied]]})


def shortest(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """Least cost of each reached node from the sources (node, cost); edges have src, dst and a cost that isn't negative.

    Each round relaxes the edges of nodes that got cheaper in the round before; it ends when none did, or after
    ``rounds`` edges.
    """
    best = written(sources.groupBy("node").agg(F.min("cost").alias("cost")))
    front, done = best, 0
    while rounds is None or done < rounds:
        offers = front.join(edges.withColumnRenamed("cost", "_step"), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("_step")).alias("offer"))
        met = written(best.join(offers, "node", "full_outer").select("node", F.least("cost", "offer").alias("cost"), (F.col("cost").isNull() | (F.col("offer") < F.col("cost"))).alias("changed")))
        front, best, done = met.where("changed").select("node", "cost"), met.select("node", "cost"), done + 1
        if front.isEmpty():
            break
    return best


def junction_degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, either way."""
    either = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    return either.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
