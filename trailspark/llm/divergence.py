"""How far each source departs from the others and from its language, term by term (operator 11)."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailspark.llm.common import written

#: Shares are counted in parts of this.
UNIT = 1_000_000_000
#: A-Z to a-z, bytes that stand in no term to blanks. Bytes from 0x80 on are those of letters and signs beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 22


def share(count: np.ndarray | int, n: int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (n + v)), exact up to 9 * 10^15 words: three steps of three decimal digits."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 1, n + v)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, n + v)
        whole = whole * 1000 + more
    return 1 + whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most UNIT + 1, so the square fits 64 bits."""
    return (p - q) * (p - q) // q


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """lang, source, text to lang, source, term, occurrences and documents; a row with a null term for each group.

    At most about ``most`` rows are held, then all are handed on; Spark adds them up.
    """
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (times, within) in held.items():
            for column, value in ((langs, lang), (sources, source)):
                column.append(pa.repeat(pa.scalar(value, pa.string()), len(times) + 1))
            terms += [None, *times]
            n += [0, *times.values()]
            docs += [0, *map(within.__getitem__, times)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(langs), pa.concat_arrays(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            times, within = held.setdefault((lang, source), (Counter(), Counter()))
            before, raw = len(times), text.as_py().encode().translate(_FOLD)
            seen, begin = set(), 0
            while begin < len(raw):  # the list of all words of a long text would be many times its size
                end = raw.find(b" ", begin + _PIECE) if len(raw) - begin > _PIECE else -1
                end = len(raw) if end < 0 else end
                words = raw[begin:end].split()
                times.update(words)
                seen.update(words)
                begin = end
            within.update(seen)
            size += len(times) - before
            if size > most:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def _packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending positions as differences, and counts."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n.astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", k), dtype=np.int64), np.frombuffer(raw, "<i8", k, 4 * k)


def _vectors(batches: Iterator[pa.RecordBatch], ranks: int) -> Iterator[pa.RecordBatch]:
    """Rows of a group's terms in one shard to its compressed vector and, by a heap, the terms that depart most."""
    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        offsets = column["terms"].offsets.to_numpy()
        at, n, total, names = (column["terms"].values.field(c) for c in ("at", "n", "total", "term"))
        at, n, total = (x.to_numpy() for x in (at, n, total))
        names = names.cast(pa.binary())
        vectors, tops = [], []
        for k, (size, kept, lang_size) in enumerate(zip(*(column[c].to_pylist() for c in ("size", "kept", "lang_size")))):
            own = slice(offsets[k], offsets[k + 1])
            order = np.argsort(at[own])
            vectors.append(_packed(at[own][order], n[own][order]))
            best = []
            if len(order):
                p, q = share(n[own], size, kept), share(total[own], lang_size, kept)
                over = np.flatnonzero(p > q)
                value = gap(p[over], q[over])
                if len(over) > ranks:  # what lies below the last rank's value can't be among the best
                    over = over[value >= np.partition(value, -ranks)[-ranks]]
                    value = gap(p[over], q[over])
                best = heapq.nsmallest(ranks, zip((-value).tolist(), names.take(pa.array(over + offsets[k])).to_pylist()))
            tops.append([{"item": t.decode(), "value": -v} for v, t in best])
        kept = [column[c] for c in ("lang", "source", "shard", "slot", "size", "kept")]
        top_type = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*kept, pa.array(vectors, pa.binary()), pa.array(tops, top_type)], names=["lang", "source", "shard", "slot", "size", "kept", "vector", "tops"])


class _Group:
    """A group's shares of a shard's terms; ``none`` is the share of a term that it lacks."""

    def __init__(self, row) -> None:
        self.source, self.kept = row.source, row.kept
        at, n = _unpacked(row.vector)
        self.p, self.none = np.zeros(0, np.int64), 0
        if self.kept:
            self.none = int(share(0, row.size_, row.kept))
            self.p = np.full(at[-1] + 1 if len(at) else 0, self.none)
            self.p[at] = share(n, row.size_, row.kept)

    def reach(self, terms: int) -> np.ndarray:
        """The shares of the first terms of the shard."""
        if len(self.p) < terms:
            self.p = np.concatenate([self.p, np.full(terms - len(self.p), self.none)])
        return self.p[:terms]


def _meeting(a: _Group, b: _Group, first_shard: bool) -> tuple[int, int]:
    """The sums of f over a shard's terms, of a against b and of b against a.

    Terms behind the last that either has add the same each; their sum over the whole vocabulary is booked in the first
    shard, and the terms before correct it.
    """
    if not a.kept:
        return 0, 0
    terms = max(len(a.p), len(b.p))
    p, q = a.reach(terms), b.reach(terms)
    square = ((p - q) * (p - q)).view(np.uint64)
    times = (a.kept if first_shard else 0) - terms
    return int((square // q.view(np.uint64)).sum()) + times * int(gap(a.none, b.none)), int((square // p.view(np.uint64)).sum()) + times * int(gap(b.none, a.none))


_PAIRS = "lang string, source string, item string, value long"


def _met(lang: str, shard: int, pairs: Iterator[tuple[_Group, _Group]]) -> pd.DataFrame:
    out = []
    for a, b in pairs:
        ab, ba = _meeting(a, b, shard == 0)
        out += [(lang, a.source, b.source, ab), (lang, b.source, a.source, ba)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"], dtype=object)


def _groups(rows: pd.DataFrame) -> list[_Group]:
    return [_Group(r) for r in rows.rename(columns={"size": "size_"}).itertuples(index=False)]


def _own(rows: pd.DataFrame) -> pd.DataFrame:
    groups = _groups(rows)
    return _met(rows["lang"].iloc[0], rows["shard"].iloc[0], ((a, b) for k, a in enumerate(groups) for b in groups[k + 1 :]))


def _visit(hosts: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    if hosts.empty or visitors.empty:
        return _met("", 0, iter(()))
    home, away = _groups(hosts), _groups(visitors)
    return _met(hosts["lang"].iloc[0], hosts["shard"].iloc[0], ((a, b) for a in home for b in away))


def opponent(slot: Column, slots: int, turn: int) -> Column:
    """Whom a slot meets in a round-robin tournament of an even number of slots, in turn 0 to slots - 2."""
    odd = slots - 1
    other = F.pmod(F.lit(turn) - slot, F.lit(odd))
    alone = turn * (slots // 2) % odd  # the one that would meet itself meets the last slot
    return F.when(slot == odd, F.lit(alone)).when(other == slot, F.lit(odd)).otherwise(other).cast("int")


def _sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def audit(docs: DataFrame, ranks: int = 200, least_docs: int = 3, shard_terms: int = 8192, slot_groups: int = 8, turns_at_once: int = 8) -> DataFrame:
    """lang, source, part, item, value and rank: what sets each source of a language apart.

    docs: text, lang and source, null as empty; other columns are ignored. Each row is a document of its own, repeated
    ones too; an empty table gives no rows; texts of any length are read in pieces. A term is a run of letters a-z
    (A-Z lower-cased) and characters beyond ASCII. Part ``pair`` compares each source with each other source of its
    language over all terms that ``least_docs`` documents of the language have, part ``term`` lists up to ``ranks``
    terms in which a source exceeds its language. Of equal values the lesser item comes first.

    Vectors are cut into shards of about ``shard_terms`` terms, so the most frequent language and the largest source
    spread over many tasks. Within a shard, slots of about ``slot_groups`` sources stay where they are, as a cached
    table partitioned by slot, while compressed vectors of other slots come to them turn by turn; each meeting gives
    both directions. Only sums are shuffled after that. A lost executor's slots are read again from a written table.
    """
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = texts.mapInArrow(lambda batches: _counted(batches, 400_000), "lang string, source string, term string, n long, docs long")
    counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term is not null")
    vocab = terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocab = written(vocab.drop("docs"))
    langs = vocab.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sources = counts.select("lang", "source").distinct()
    shards = -(-(langs.agg(F.max("kept")).first()[0] or 1) // shard_terms)
    slots = 2 * max(1, -(-(sources.groupBy("lang").count().agg(F.max("count")).first()[0] or 1) // (2 * slot_groups)))

    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    placed = vocab.withColumn("shard", shard).withColumn("at", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
    entries = terms.select("lang", "source", "term", "n").join(placed, ["lang", "term"])
    empty = sources.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))  # a group is in every shard
    columns = ["lang", "source", "shard", "at", "n", "total", "term"]
    entry = F.when(F.col("at").isNotNull(), F.struct("at", "n", "total", "term"))
    rows = entries.select(columns).unionByName(empty, allowMissingColumns=True).groupBy("lang", "source", "shard")
    rows = written(rows.agg(F.collect_list(entry).alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("part")))
    sizes = rows.groupBy("lang", "source").agg(F.sum("part").alias("size"))
    rows = rows.drop("part").join(_sized(sizes), ["lang", "source"]).join(_sized(langs), "lang", "left").fillna(0, ["kept", "lang_size"])
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("source"), F.lit(slots)).cast("int"))
    schema = "lang string, source string, shard int, slot int, size long, kept long, vector binary, tops array<struct<item: string, value: long>>"
    resident = written(rows.mapInArrow(lambda batches: _vectors(batches, ranks), schema))

    key = ["lang", "shard", "slot"]
    at_home = resident.drop("tops").repartition(*key).persist()
    met = [at_home.groupBy(key).applyInPandas(_own, _PAIRS)]
    done: list[DataFrame] = []
    for turn in range(slots - 1):
        other = opponent(F.col("slot"), slots, turn)
        host = (F.col("slot") < other) == F.lit(turn % 2 == 0)
        visitors = at_home.where(~host).withColumn("slot", other)
        met.append(at_home.where(host).groupBy(key).cogroup(visitors.groupBy(key)).applyInPandas(_visit, _PAIRS))
        if len(met) >= turns_at_once:
            done.append(_summed(met))
            met = []
    if met:
        done.append(_summed(met))
    at_home.unpersist()
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.unionByName(more)

    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    tops = resident.select("lang", "source", F.lit("term").alias("part"), F.inline("tops"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    tops = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(tops)


def _summed(met: list[DataFrame]) -> DataFrame:
    """The sums over all shards of some turns' meetings, written."""
    union = met[0]
    for more in met[1:]:
        union = union.unionByName(more)
    return written(union.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


#: DuckDB SQL of ``audit`` over the table ``documents``.
SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc, coalesce(text, '') as text from documents
), w as (
  select lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
), vocab as materialized (
  select lang, term, count(*)::bigint as total from w group by all having count(distinct doc) >= 3
), langs as (
  select lang, count(*)::bigint as v, sum(total)::hugeint as n from vocab group by all
), g as materialized (
  select lang, source, term, count(*)::bigint as c from w join vocab using (lang, term) group by all
), groups as materialized (
  select x.lang, x.source, coalesce(sum(c), 0)::hugeint as n from (select distinct lang, source from d) x left join g using (lang, source) group by all
), f as materialized (
  select gr.lang, gr.source, vo.term, coalesce(g.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(g.c, 0) + 1)) // (gr.n + l.v) as p,
    1 + (1000000000::hugeint * (vo.total + 1)) // (l.n + l.v) as q
  from groups gr join vocab vo using (lang) join langs l using (lang) left join g on g.lang = gr.lang and g.source = gr.source and g.term = vo.term
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join f x on x.lang = a.lang and x.source = a.source left join f y on y.lang = b.lang and y.source = b.source and y.term = x.term
  where x.term is null or y.term is not null group by all
), terms as (
  select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from f where c > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
  union all select lang, source, 'term', item, value, (row_number() over (partition by lang, source order by value desc, item))::int from terms
)
select * from ranked where part = 'pair' or rank <= 200
"""
