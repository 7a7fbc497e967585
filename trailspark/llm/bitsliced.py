"""Exact top-k inner products over a bit-sliced index (operator 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import written


def nonadjacent(w: int) -> list[tuple[int, int]]:
    """Signed digits (position, +1 or -1) of w, no two of them adjacent."""
    out, p = [], 0
    while w:
        if w & 1:
            d = 2 - (w & 3)
            out.append((p, d))
            w -= d
        w >>= 1
        p += 1
    return out


def added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps, listed by the power of two that they count for, as the sum's own slices (lowest first).

    Full adders turn three bitmaps of one power into one of it and one of the next, many at a time.
    """
    out, p = [], 0
    while any(k >= p for k in columns):
        maps = columns.pop(p, [])
        while len(maps) > 1:
            block = np.array(maps)
            n = len(block) // 3
            if n:
                a, b, c = block[: 3 * n].reshape(n, 3, -1).transpose(1, 0, 2)
                x = a ^ b
                columns.setdefault(p + 1, []).extend((a & b) | (x & c))
                maps = [*(x ^ c), *block[3 * n :]]
            else:
                a, b = block
                columns.setdefault(p + 1, []).append(a & b)
                maps = [a ^ b]
        out.append(maps[0] if maps else None)
        p += 1
    return out


class SlicedBlock:
    """Rows of small integers as one bitmap per attribute and bit. ``dropped`` low bits wait for the exact step."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values = values
        self.low = values.min(axis=0)
        shifted = values - self.low
        self.dropped = max(0, int(shifted.max(initial=0)).bit_length() - bits)
        top = shifted >> self.dropped
        self.most = top.max(axis=0)
        self.rows, self.words = len(values), -(-len(values) // 64)
        self.all = np.full(self.words, ~np.uint64(0))
        if self.rows % 64:
            self.all[-1] = np.uint64((1 << (self.rows % 64)) - 1)
        self.slices = [[self._packed(top[:, d] >> b & 1) for b in range(int(self.most[d]).bit_length())] for d in range(values.shape[1])]

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, dtype=np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def candidates(self, query: np.ndarray, k: int, bits: int) -> np.ndarray:
        """Rows that may be among the k highest inner products with query: a superset, usually a small one.

        The sum of the weighted slices bounds each score from both sides. The k best rows by slices are found from
        the highest slice downward; each other row whose upper bound reaches their lower one stays.
        """
        if self.rows <= 4 * k:
            return np.arange(self.rows)
        drop = max(0, int(np.abs(query).max(initial=0)).bit_length() - bits)
        weight = (query + (1 << drop >> 1)) >> drop
        columns: dict[int, list[np.ndarray]] = {}
        ones = 0
        for d, w in enumerate(weight.tolist()):
            for p, sign in nonadjacent(w):
                for b, s in enumerate(self.slices[d]):
                    columns.setdefault(p + b, []).append(s if sign > 0 else ~s)
        slices = [s for s in added(columns)]
        while slices and slices[-1] is None:
            slices.pop()
        rest = query - (weight << drop)
        spread = float(np.abs(query).astype(float).sum() * ((1 << self.dropped) - 1) + (np.abs(rest).astype(float) * self.most).sum() * (1 << self.dropped))
        slack = int(spread / float(1 << (drop + self.dropped))) + 2
        chosen, open_, value = np.zeros(self.words, np.uint64), self.all.copy(), 0
        for p in range(len(slices) - 1, -1, -1):
            hit = open_ & slices[p] if slices[p] is not None else np.zeros_like(open_)
            if int(np.bitwise_count(chosen | hit).sum()) >= k:
                open_, value = hit, value | 1 << p
            else:
                chosen |= hit
                open_ &= ~hit
        return self._at_least(slices, max(0, value - slack))

    def _at_least(self, slices: list, bound: int) -> np.ndarray:
        over, equal = np.zeros(self.words, np.uint64), self.all.copy()
        for p in range(len(slices) - 1, -1, -1):
            s = slices[p] if slices[p] is not None else np.zeros_like(equal)
            if bound >> p & 1:
                equal &= s
            else:
                over |= equal & s
                equal &= ~s
        return np.flatnonzero(np.unpackbits((over | equal).view(np.uint8), bitorder="little")[: self.rows])


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component as long; null for vectors that are null or hold null or non-finite components.

    A component that is so large that a product of two such vectors might not fit 64 bits is an error.
    """
    vector = embedding.cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    limit = F.sqrt(F.lit(2.0**62) / F.size(vector)) / 256 - 1
    inside = F.forall(vector, lambda x: F.abs(x) < limit)
    return F.when(fine & (F.size(vector) > 0), F.when(inside, F.transform(vector, lambda x: F.floor(x * 256).cast("long"))).otherwise(F.raise_error(F.lit("a component is too large for scores of 64 bits"))))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block_rows: int = 16_384, block_queries: int = 512, bits: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest integer inner products; ties to smaller vec_id.

    vectors: vec_id and embedding; queries: a condition on vec_id. A query's own vec_id is no candidate. Vectors
    that ``quantised`` refuses, empty ones and null ids take no part. Every row is a candidate, so a vec_id that comes
    with several rows may come several times in an answer; each distinct vector of a query's vec_id is a query of its
    own. Shorter vectors count as filled up with zeros. Blocks of rows meet blocks of queries, both of bounded size
    and dealt by a hash; each pair of blocks gives k rows a query at most.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("v is not null and size(v) > 0 and vec_id is not null")
    known = written(given.withColumn("number", F.xxhash64("vec_id", "v", F.monotonically_increasing_id())))
    query = written(known.where(queries).select("vec_id", "v").distinct().withColumn("query", F.xxhash64("vec_id", "v")))
    blocks, groups = max(1, -(-known.count() // block_rows)), max(1, -(-query.count() // block_queries))
    rows = known.select(F.pmod("number", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "vec_id", "v")
    asked = query.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod("query", F.lit(groups)).cast("int").alias("group"), "query", "vec_id", "v")

    def compare(key: tuple, candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(candidates) and len(asked):
            width = max(max(map(len, candidates["v"])), max(map(len, asked["v"])))
            wide = lambda vs: np.array([np.pad(v, (0, width - len(v))) for v in vs], dtype=np.int64)
            ids = candidates["vec_id"].to_numpy()
            block = SlicedBlock(wide(candidates["v"]), bits)
            for query, query_id, q in zip(asked["query"], asked["vec_id"], wide(asked["v"])):
                some = block.candidates(q, k + int((ids == query_id).sum()), bits)
                some = some[ids[some] != query_id]
                scores = block.values[some] @ q
                if len(some) > k:  # boundary rows, with all that tie
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    some, scores = some[keep], scores[keep]
                best = np.lexsort((ids[some], -scores))[:k]
                out += [(query, query_id, ids[some[i]], scores[i]) for i in best]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"]).astype("int64")

    met = rows.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(compare, "query long, query_id long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
