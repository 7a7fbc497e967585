"""Product codes of integer vectors by rounds of exact reassignment (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


@dataclass(frozen=True)
class Codebooks:
    """entries: integers of shape (parts, entries, components of a part); scale: factor before the floor."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Of all components in order, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components and all are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _integers(column: pa.ListArray, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors that have ``width`` components, and which those are."""
    fits = np.diff(column.offsets.to_numpy()) == width
    chosen = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    floors = np.floor(scale * chosen.reshape(-1, width))
    # a distance is at most (2 m)^2 * width; sums over parts and the terms of its expansion stay below 2^63
    if floors.size and np.abs(floors).max() >= (2.0**60 / width) ** 0.5:
        raise ValueError("components are too large for exact 64-bit distances")
    return floors.astype(np.int64), fits


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance, by |c|^2 - 2 x.c + |x|^2."""
    score = (book * book).sum(1) - 2 * (x @ book.T)
    best = score.argmin(1)
    return best, score[np.arange(len(x)), best] + (x * x).sum(1)


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """One pass: each task's sums and counts by part, entry and component, merged by a grouped shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast((books.entries, books.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, scale = shared.value
        parts, k, width = entries.shape
        total, n = np.zeros(entries.shape, np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x, _ = _integers(batch.column(0), parts * width, scale)
            for part in range(parts):
                own = x[:, part * width : (part + 1) * width]
                best, _ = _nearest(own, entries[part])
                chosen = (best == np.arange(k)[:, None]).astype(np.int64)
                total[part] += chosen @ own
                n[part] += chosen.sum(1)
            if n.max(initial=0) > 1 << 30:  # long before a task's own sums could leave 64 bits
                yield _rows(total, n)
                total[:], n[:] = 0, 0
        yield _rows(total, n)

    merged = vectors.select("v").mapInArrow(run, "part int, entry int, at int, total long, n long")
    return merged.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _rows(total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    part, entry = np.nonzero(n)
    width = total.shape[2]
    columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], width)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUMS.types)], schema=_SUMS)


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of the vectors' equal consecutive parts; None if no vector can be used.

    vectors: vec_id and embedding, other columns are ignored. Null, empty or partly null or non-finite embeddings
    take no part. Codebooks start as the parts of the rows with the smallest vec_ids (null ids come last, equal ids by
    their components), so repeated rows may start equal entries; of equal entries the first gets all. The first of
    these rows sets the number of components, which must be a multiple of ``parts``; vectors of other lengths take
    no part. Each round reads the table once, so an expensive one should be written first. Components from about
    2^30 / sqrt(length) after scaling are refused.
    """
    known = vectors.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v")))
    first = known.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["v"])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    seeds, _ = _integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), length, scale)
    books = Codebooks(np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).swapaxes(0, 1)), scale)
    for _ in range(rounds):
        new = books.entries.copy()
        for r in _sums(known, books).collect():  # parts * entries * components rows, whatever the table's size
            new[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        books = Codebooks(new, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: Sequence[str] = ()) -> DataFrame:
    """vec_id, the columns named in ``keep``, the code (two hex digits a part) and the summed squared distance.

    Embeddings that can't be used give no row; those of another length than the codebooks' have a null code and error.
    """
    columns = ["vec_id", *keep]
    known = vectors.where(usable(F.col("embedding"))).select(*[F.col(f"`{c}`") for c in columns], F.col("embedding").alias("v"))
    shared = vectors.sparkSession.sparkContext.broadcast((books.entries, books.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, scale = shared.value
        parts, _, width = entries.shape
        for batch in batches:
            x, fits = _integers(batch.column(batch.num_columns - 1), parts * width, scale)
            found = [_nearest(x[:, p * width : (p + 1) * width], entries[p]) for p in range(parts)]
            codes, error = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            raw = np.stack([b for b, _ in found], 1).astype(np.uint8).tobytes().hex()
            codes[fits] = [raw[a : a + 2 * parts] for a in range(0, len(raw), 2 * parts)]
            error[fits] = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(error, pa.int64(), mask=~fits)], names=[*columns, "code", "error"])

    schema = known.select(*[f"`{c}`" for c in columns]).schema.add("code", "string").add("error", "long")
    return known.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, group: str, most_broadcast: int = 200_000) -> DataFrame:
    """coded with ``{group}_error``, the error summed over the rows with an equal group; nulls are together.

    Sums are formed in each task before they are shuffled. They are broadcast up to ``most_broadcast`` groups; beyond
    that a join by group follows, whose hot groups adaptive execution splits.
    """
    sums = coded.groupBy(F.col(group).alias("_group")).agg(F.sum("error").alias(f"{group}_error"))
    sums = F.broadcast(sums) if sums.count() <= most_broadcast else sums
    return coded.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for codes and errors of the table ``embeddings``, whose vectors have one length."""
    steps = [
        f"""k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * x::double) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as materialized (
  select vec_id, label, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) as v from k, range({parts}) t(part)
), b0 as materialized (
  select part, entry, v from (select part, v, dense_rank() over (order by vec_id) - 1 as entry from p where vec_id is not null) where entry < {entries}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
  select vec_id, any_value(label) as label, p.part, any_value(p.v) as v,
    min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint, 'e': entry}}) as best
  from p join b{r} b on p.part = b.part group by vec_id, p.part
)""")
        if r < rounds:
            steps.append(f"""u{r} as materialized (
  select part, entry, list((s - ((s % n) + n) % n) // n order by pos) as v
  from (select part, best.e as entry, pos, sum(v[pos])::bigint as s, count(*)::bigint as n
    from (select part, best, v, unnest(generate_series(1, len(v))) as pos from a{r}) group by all) group by part, entry
), b{r + 1} as materialized (
  select part, entry, coalesce(u.v, b.v) as v from b{r} b left join u{r} u using (part, entry)
)""")
    return f"""
with {", ".join(steps)}, c as (
  select vec_id, any_value(label) as label, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a{rounds} group by vec_id
), h as (
  select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds}
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c, h
"""
