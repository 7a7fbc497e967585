"""Exact n-gram Jaccard self-join by prefixes and prefix trees, with components of linked documents (operator 10)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import written
from trailspark.llm.shingles import mixed, shingle_sets
from trailspark.operators import graph

#: Shingle counts are kept in 2^SKETCH_BITS bytes that stop at 255; they only order the shingles, so any size is right.
SKETCH_BITS = 24
_BLOCK = 1 << 16
#: Prefix shingles that two linked sets share at least (fewer for sets of fewer shingles).
SHARED = 4
#: Grams of the members that one task compares with one hub.
_GROUP_GRAMS = 1_000_000
#: Sets in a block; a task compares two blocks.
_BLOCK_SETS = 400
#: Rows of a few numbers that a side of a join may have at most to be broadcast.
_SMALL = 100_000


def _set_id(grams: np.ndarray) -> int:
    """Identity of a set: a signed 64-bit fingerprint of its sorted shingles."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _slots(grams: np.ndarray) -> np.ndarray:
    return (mixed(grams) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (doc_id, n, set_id), and rows that hold counts of shingles (block, at, n_at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for batch in batches:
            sizes, ids = [], []
            for grams in shingle_sets([t or b"" for t in batch.column(1).to_pylist()], k):
                sizes.append(len(grams))
                ids.append(_set_id(grams) if len(grams) else None)
                at = _slots(grams)
                counts[at] = np.minimum(counts[at], 254) + 1
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
        rows = []
        for block in range(len(counts) // _BLOCK):
            some = counts[block * _BLOCK : (block + 1) * _BLOCK]
            if len(at := np.flatnonzero(some)):
                rows.append((block, zlib.compress(at.astype(np.uint16).tobytes(), 1), zlib.compress(some[at].tobytes(), 1)))
        if rows:
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary())))], names=names)

    names = ["doc_id", "n", "set_id", "block", "at", "n_at"]
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return given.mapInArrow(run, "doc_id long, n long, set_id long, block int, at binary, n_at binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur; 2^SKETCH_BITS bytes, whatever the corpus."""

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, dtype=np.uint16)
        for at, n in zip(batch["at"], batch["n_at"]):
            at = np.frombuffer(zlib.decompress(at), dtype=np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(zlib.decompress(n), dtype=np.uint8), 255)
        return pd.DataFrame({"block": batch["block"].iloc[:1], "total": [total.astype(np.uint8).tobytes()]})

    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in rows.where("block is not null").select("block", "at", "n_at").groupBy("block").applyInPandas(one, "block int, total binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["total"], dtype=np.uint8)
    return out


def prefix(grams: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles in the global order, rare ones first: two sets that link share SHARED of them.

    Sets with den * |x & y| >= num * |x | y| have ceil(t n) shingles in common at least, for either size n. So a
    link leaves room for n - ceil(t n) misses, and with SHARED shingles more in the prefix as many must hit.
    Equal ranks at the end are all kept.
    """
    n = len(grams)
    p = n - -(-num * n // den) + least_shared(n, num, den)
    rank = (counts[_slots(grams)].astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24))
    if p >= n:
        return grams
    return grams[rank <= np.partition(rank, p - 1)[p - 1]]


def least_shared(n: int, num: int, den: int) -> int:
    return min(SHARED, -(-num * n // den))


def _enough(common: str, a: str, b: str, num: int, den: int) -> Column:
    """Whether as many prefix shingles are shared as two linked sets of these sizes must share."""
    return F.col(common) >= F.least(F.lit(SHARED), F.ceil(F.least(a, b) * num / den))


def _entries(docs: DataFrame, counts: Broadcast, k: int, num: int, den: int, only: np.ndarray | None = None) -> DataFrame:
    """(token, set_id, n, score) of each set's prefix shingles, once a task and set.

    With a bitmap ``only``, of those in it, and of sets with as many there as a link needs; score is their share
    of the prefix in thousandths, highest for the text that copies were made from.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has met
        for batch in batches:
            tokens, owners, sizes, scores = [], [], [], []
            for grams in shingle_sets([t or b"" for t in batch.column(0).to_pylist()], k):
                if not len(grams) or (own := _set_id(grams)) in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(own)
                first = prefix(grams, counts.value, num, den)
                score = 1000
                if bitmap.value is not None:
                    there = first[_in_bitmap(first, bitmap.value)]
                    if len(there) < least_shared(len(grams), num, den):
                        continue
                    first, score = there, 1000 * len(there) // len(first)
                tokens.append(first)
                owners.append(np.full(len(first), own, dtype=np.int64))
                sizes.append(np.full(len(first), len(grams), dtype=np.int32))
                scores.append(np.full(len(first), score, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(scores))], names=["token", "set_id", "n", "score"])

    return docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "token long, set_id long, n int, score int")


def _shared(entries: DataFrame, num: int, den: int) -> DataFrame:
    """The tokens that sets of sizes that can link may share: more than one set has them, and not just two of unlike sizes.

    A set goes by the logarithm of its size, in the upper ten bits, and 54 bits of its identity.
    """
    level = F.floor(F.log(F.col("n").cast("double")) * 32).cast("long")
    own = F.shiftleft(level, 54).bitwiseOR(F.shiftrightunsigned("set_id", 10))
    seen = entries.select("token", own.alias("own")).groupBy("token").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("c"))
    apart = F.shiftright("high", 54) - F.shiftright("low", 54)
    return seen.where((F.col("low") != F.col("high")) & ((F.col("c") > 2) | (apart <= math.floor(32 * math.log(den / num)) + 1))).select("token")


#: Bits of the bitmaps that keep what can't match out of shuffles; a full one would only keep less out.
_BITS = 1 << 25


def _in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = mixed(values) >> np.uint64(39)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of a column of longs, _BITS / 8 bytes."""
    (name,) = values.columns

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.zeros(_BITS // 8, dtype=np.uint8)
        for batch in batches:
            slot = mixed(batch[name].to_numpy(dtype=np.int64).view(np.uint64)) >> np.uint64(39)
            np.bitwise_or.at(at, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(1, (slot & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        parts = at.reshape(-1, _BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"block": some, "bits": [zlib.compress(parts[i].tobytes(), 1) for i in some]})

    def either(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in batch["bits"]])
        return pd.DataFrame({"block": batch["block"].iloc[:1], "bits": [total.tobytes()]})

    bitmap = np.zeros(_BITS // 8, dtype=np.uint8)
    for r in values.mapInPandas(marked, "block int, bits binary").groupBy("block").applyInPandas(either, "block int, bits binary").collect():
        bitmap[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bitmap


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows, else shuffled like any other; df is a written table."""
    return F.broadcast(df) if df.count() <= _SMALL else df


def _with_grams(docs: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    """The rows of dealt (set_id and more) with the set's shingles; some rows come twice."""
    wanted = dealt.select("set_id").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, found = [], []
            for grams in shingle_sets([t or b"" for t in batch.column(0).to_pylist()], k):
                if not len(grams) or (own := _set_id(grams)) in seen:
                    continue
                if _in_bitmap(np.array([own], dtype=np.int64).view(np.uint64), shared.value)[0]:
                    if len(seen) < 2_000_000:
                        seen.add(own)
                    ids.append(own)
                    found.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["set_id", "grams"])

    emitted = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "set_id long, grams binary")
    return emitted.join(_small(dealt), "set_id")


class PrefixTree:
    """Sets of ordered shingles as a trie: in sorted order, each shares its path with the one before up to ``common``."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()) if len(sets) > 1 else [*range(len(sets))]
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(x) for x in self.sets], dtype=np.int64)
        self.common = np.zeros(len(sets), dtype=np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.common[i] = int(differ[0]) if len(differ) else n

    def linked(self, probe: np.ndarray, num: int, den: int, wanted: np.ndarray | None = None) -> list[int]:
        """Places in the tree's order of the (wanted) sets with den * |x & probe| >= num * |x | probe|.

        Overlaps along a path are shared with the next set below the same node. A subtree is left as soon as the
        overlap so far and what remains on either side can't reach what its set needs.
        """
        m = len(probe)
        needs = -(-num * (self.sizes + m) // (num + den))
        fit = np.minimum(self.sizes, m) >= needs
        found, path = [], np.zeros(1, dtype=np.int64)  # overlap after each step of the current path
        dead, last = -1, None  # depth at which the last subtree was pruned; the set visited before
        for i in np.flatnonzero(fit if wanted is None else fit & wanted).tolist():
            x, n, need = self.sets[i], int(self.sizes[i]), int(needs[i])
            depth = 0 if last is None else min(len(path) - 1, int(self.common[last + 1 : i + 1].min()))
            last = i
            if 0 <= dead <= depth and path[dead] + min(n - dead, m - path[dead]) < need:
                path = path[: depth + 1]
                continue
            dead = -1
            at = np.searchsorted(probe, x[depth:])
            hit = probe[np.minimum(at, m - 1)] == x[depth:]
            path = np.concatenate([path[: depth + 1], path[depth] + np.cumsum(hit)])
            reach = path + np.minimum(n - np.arange(n + 1), m - path)
            if len(short := np.flatnonzero(reach < need)):
                dead = int(short[0])
            elif path[-1] >= need:
                found.append(i)
        return found


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (hub, member, n) of set ids that link. Members of one hub form tries of bounded size."""
    pairs = written(pairs)
    parts = pairs.groupBy("hub").agg((F.floor(F.sum("n") / _GROUP_GRAMS) + 1).alias("parts"))
    tasks = 1 + (pairs.agg(F.sum("n")).first()[0] or 0) // _GROUP_GRAMS
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts"))).withColumn("task", F.pmod(F.xxhash64("hub", "part"), F.lit(tasks)))
    members = dealt.select(F.col("member").alias("set_id"), "hub", "task", F.lit(False).alias("is_hub"))
    roles = written(members.unionByName(dealt.select(F.col("hub").alias("set_id"), "hub", "task", F.lit(True).alias("is_hub")).distinct()))
    held = _with_grams(docs, roles, k)

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates(["set_id", "hub", "is_hub"])
        hubs, rest = batch[batch["is_hub"]], batch[~batch["is_hub"]]
        own, a, b = dict(zip(hubs["set_id"], hubs["grams"])), [], []
        for name, some in rest.groupby("hub", sort=False).indices.items():
            ids, raw = rest["set_id"].to_numpy()[some], rest["grams"].to_numpy()[some]
            tree = PrefixTree([np.frombuffer(g, dtype=np.uint64) for g in raw])
            found = tree.linked(np.frombuffer(own[name], dtype=np.uint64), num, den)
            a += [name] * len(found)
            b += [ids[tree.order[i]] for i in found]
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return held.groupBy("task").applyInPandas(compare, "a long, b long")


def _fitting(homes: DataFrame, num: int, den: int) -> DataFrame:
    """The sets of homes (set_id, n, home) for which another set of the home has a size that allows a link.

    Sizes go by levels a little wider than the ratio that a link allows, so these are in the same or the next one.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / (1.001 * max(math.log(den / num), 0.01)))
    levelled = homes.withColumn("level", level)
    each = levelled.groupBy("home", "level").agg(F.count("*").alias("c"))
    near = each.select("home", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)).alias("level"), "c")
    near = near.groupBy("home", "level").agg(F.sum("c").alias("c")).where("c > 1").select("home", "level")
    return levelled.join(near, ["home", "level"]).select("set_id", "n", "home")


def _within(homes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that tie together the sets of each home (set_id, n, home) as far as they link.

    A home's sets are dealt into blocks of bounded size, and each pair of blocks meets in one task: one block as a
    trie, the other's sets as probes. What is tied together there isn't compared again.
    """
    homes = written(_fitting(homes, num, den))
    sizes = homes.groupBy("home").agg(F.count("*").alias("c"), F.sum("n").alias("all")).where("c > 1")
    sizes = sizes.select("home", F.greatest(F.ceil(F.col("c") / _BLOCK_SETS), F.ceil(F.col("all") / _GROUP_GRAMS)).cast("int").alias("blocks"))
    own = homes.join(sizes, "home").withColumn("at", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("set_id", "n", "home", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).alias("probe"))
    dealt = written(dealt)
    total = dealt.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    tasks = 1 + total["c"] // (4 * _BLOCK_SETS) + (total["n"] or 0) // _GROUP_GRAMS
    held = _with_grams(docs, dealt, k).withColumn("task", F.pmod(F.xxhash64("home", "i", "j"), F.lit(tasks)))

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        batch = batch.drop_duplicates(["set_id", "home", "i", "j"])
        for (_, i, j), some in batch.groupby(["home", "i", "j"], sort=False).indices.items():
            part = batch.iloc[some]
            rows, probes = (part, part) if i == j else (part[~part["probe"]], part[part["probe"]])
            if not len(rows) or not len(probes):
                continue
            tree = PrefixTree([np.frombuffer(g, dtype=np.uint64) for g in rows["grams"]])
            ids = rows["set_id"].to_numpy()[tree.order]
            of = ids.copy()  # what each set is tied to so far
            places = np.arange(len(of))
            mine = of if i == j else probes["set_id"].to_numpy().copy()
            for p, raw in enumerate(tree.sets if i == j else probes["grams"]):
                open_ = of != mine[p]
                if i == j:
                    open_ &= places > p
                if not open_.any():
                    continue
                for q in tree.linked(np.frombuffer(raw, dtype=np.uint64), num, den, open_):
                    if of[q] != mine[p]:
                        a.append(ids[p] if i == j else probes["set_id"].iloc[p])
                        b.append(ids[q])
                        old, new = of[q], mine[p]
                        of[of == old] = new
                        mine[mine == old] = new
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return held.groupBy("task").applyInPandas(compare, "a long, b long")


def _homes(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(set_id, n, home) of the sets that share as many prefix shingles with others as a link needs.

    A token's hub is the one of its sets whose prefix is shared most; a set's home is the hub that it has most tokens
    in common with.
    """
    hubs = entries.groupBy("token").agg(F.max(F.struct("score", "set_id")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("token", F.col("hub.set_id").alias("hub"))
    tied = entries.join(hubs, "token").groupBy("set_id", "hub").agg(F.count("*").alias("common"), F.first("n").alias("n"))
    homes = tied.groupBy("set_id").agg(F.first("n").alias("n"), F.max(F.struct("common", "hub")).alias("home"), F.sum("common").alias("common"))
    return homes.where(F.col("common") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * num / den))).select("set_id", "n", F.col("home.hub").alias("home"))


def similar(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sizes allow a link."""
    return den * F.least(a, b) >= num * F.greatest(a, b)


def connected(links: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for the nodes of links (a, b)."""
    return graph.connected(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Every row of sets with the label of its component."""
    return sets.join(connected(links).withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def _open(entries: DataFrame, labelled: DataFrame, num: int, den: int) -> DataFrame:
    """The tokens, with their sets, that sets of more than one component share; only sets with as many of them as a link needs."""
    w = Window.partitionBy("token")
    named = entries.drop("n", "score").join(_small(labelled), "set_id")
    left = named.withColumn("low", F.min("label").over(w)).withColumn("high", F.max("label").over(w)).where("low != high").drop("low", "high")
    return written(_able(left, num, den))


def _able(left: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of sets that have as many tokens in left as two linked sets must share."""
    return left.withColumn("c", F.count("*").over(Window.partitionBy("set_id"))).where(_enough("c", "n", "n", num, den)).drop("c")


def _across(left: DataFrame, num: int, den: int) -> DataFrame:
    """The tokens that sets of more than one home share, with their most frequent home; only sets with enough of them."""
    most = left.groupBy("token", "home").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "home")).alias("m"), F.count("*").alias("homes")).where("homes > 1").select("token", F.col("m.home").alias("most"))
    return written(_able(left.join(most, "token"), num, den))


def _nearest_labels(left: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, member, n): one pair of sets for components that share tokens, where sizes allow a link.

    In each token the component with most sets meets every other one, each by its least set, so rows are linear in the
    token's. Of a pair of components, the sets that meet most often are compared, if that is as often as a link needs. A
    large group of copies whose sets have several homes is tied together here, before all its sets would be paired.
    """
    each = left.groupBy("token", "label").agg(F.count("*").alias("c"), F.min(F.struct("set_id", "n")).alias("x"))
    top = each.groupBy("token").agg(F.max(F.struct("c", "label", "x")).alias("m"))
    met = each.join(top, "token").where("label != m.label").select("label", F.col("m.label").alias("other"), "x", F.col("m.x").alias("y"))
    met = met.where(similar("x.n", "y.n", num, den)).groupBy("label", "other", "x", "y").agg(F.count("*").alias("common"))
    best = met.groupBy(F.least("label", "other").alias("p"), F.greatest("label", "other").alias("q")).agg(F.max(F.struct("common", "x", "y")).alias("b"))
    best = best.where(_enough("b.common", "b.x.n", "b.y.n", num, den))
    return best.select(F.col("b.y.set_id").alias("hub"), F.col("b.x.set_id").alias("member"), F.greatest("b.x.n", "b.y.n").alias("n"))


def _rare(left: DataFrame, num: int, den: int) -> DataFrame:
    """Each set's tokens without its most frequent ones, one less than a link must share.

    Of the tokens that two linked sets share, the least frequent has as many as were left out, or more, before it in
    both sets, so it stays in both.
    """
    often = left.withColumn("often", F.count("*").over(Window.partitionBy("token")))
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("often"), "token"))
    return often.withColumn("place", place).where(_enough("place", "n", "n", num, den)).drop("often", "place")


def _pairs(left: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, member, n): the sets of different homes and components that share as many tokens as a link needs."""
    rare = written(_rare(left, num, den))
    a, b = rare.where("home != most").alias("a"), rare.alias("b")  # a token's most frequent home needs no pairs with itself
    pairs = a.join(b, "token").where("a.label != b.label and a.home != b.home and (b.home = b.most or a.set_id < b.set_id)").where(similar("a.n", "b.n", num, den))
    pairs = pairs.select(F.least("a.set_id", "b.set_id").alias("hub"), F.greatest("a.set_id", "b.set_id").alias("member")).distinct()
    tokens = written(left.groupBy("set_id").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")))
    for role in ("hub", "member"):
        pairs = pairs.join(tokens.select(F.col("set_id").alias(role), F.col("n").alias(f"{role}_n"), F.col("tokens").alias(f"{role}_tokens")), role)
    pairs = pairs.withColumn("common", F.size(F.array_intersect("hub_tokens", "member_tokens")))
    return pairs.where(_enough("common", "hub_n", "member_n", num, den)).select("hub", "member", F.greatest("hub_n", "member_n").alias("n"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text; other columns are ignored).

    Two documents link when den * |x & y| >= num * |x | y| of their sets of k-word shingles; component_id is the
    smallest doc_id that links reach. Documents with equal sets are one set from the first pass on. The sets that
    share a rare shingle have a hub, the one of them whose prefix is shared most; each set's home is the hub it has
    most prefix shingles in common with. Sets of one home meet in blocks, as tries; then components that share prefix
    shingles meet by one pair of sets each, and last, all sets of different homes and components are paired where they
    share as many prefix shingles as a link needs. So no link between components is lost. Documents without words have an empty set and stand alone.
    Repeated rows are kept, each with its component.
    """
    rows = written(_sets(docs, k))
    info = rows.where("block is null").select("doc_id", "n", "set_id")
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(rows))
    common = _shared(_entries(docs, counts, k, num, den), num, den)
    entries = written(_entries(docs, counts, k, num, den, _bitmap(common)).distinct())
    counts.unpersist()  # comes again where a lost executor's rows need it

    homes = written(_homes(entries, num, den))
    links = written(_within(homes, docs, k, num, den))

    left = _open(entries, written(_labelled(homes, links)), num, den)
    links = written(links.unionByName(_verified(_nearest_labels(left, num, den), docs, k, num, den)))
    left = _open(entries, written(_labelled(homes, links)), num, den)
    left = _across(_across(left, num, den).drop("most"), num, den)  # sets that went leave tokens to one home
    last = _verified(_pairs(left, num, den), docs, k, num, den)
    labels = connected(written(links.unionByName(last)))

    sets = info.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    sets = sets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    sets = written(sets)
    least = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = sets.join(least, "label").select("set_id", "component_id")
    return info.join(classes, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
