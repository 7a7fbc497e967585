"""Language identification by prediction by partial matching over bytes (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import free_name, written

#: Bytes of context at most; a code of order + 1 bytes fits 32 bits.
ORDER = 3
#: Stands before each text, so that its first bytes have a context too.
_LEAD = b"\n" * ORDER
#: Texts with copies, by two numbers each, that may be broadcast.
_SMALL = 500_000


@dataclass(frozen=True)
class Model:
    """Frozen code lengths. ``row`` gives, for each context of three symbols, the row of the longest context
    that some language's tree holds; ``bits[row * symbols + symbol]`` has the code length in every language."""

    languages: tuple[str, ...]
    symbol: np.ndarray
    symbols: int
    row: np.ndarray
    bits: np.ndarray


def _grams(text: bytes, order: int) -> np.ndarray:
    """Codes of order + 1 bytes that end at each byte of a text."""
    at = np.frombuffer(_LEAD + text, dtype=np.uint8).astype(np.int64)
    code = at[ORDER:].copy()
    for k in range(1, order + 1):
        code |= at[ORDER - k : len(at) - k] << (8 * k)
    return code


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, copies, size, code and n: how often each context of ``size`` bytes and the byte after it stand in a task's texts.

    Only contexts of ORDER bytes are counted, as every byte has one; shorter ones add up from these.
    """
    held: dict[tuple, list] = {}
    kept = 0

    def taken() -> Iterator[pd.DataFrame]:
        for (lang, copies), parts in held.items():
            code, n = _added(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
            for order in range(ORDER, -1, -1):
                code, n = _added(code & np.int64((1 << 8 * (order + 1)) - 1), n)
                yield pd.DataFrame({"lang": lang, "copies": copies, "size": order, "code": code, "n": n})
        held.clear()

    for batch in batches:
        batch = batch if "copies" in batch else batch.assign(copies=1)
        for key, texts in batch.groupby(["lang", "copies"])["text"]:
            code, n = np.unique(np.concatenate([_grams(x.encode(), ORDER) for x in texts]).astype(np.uint32), return_counts=True)
            held.setdefault(key, []).append((code.astype(np.int64), n.astype(np.int64)))
            kept += len(code)
        if kept > 8_000_000:
            yield from taken()
            kept = 0
    yield from taken()


def _added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    return code[order][first], np.add.reduceat(n[order], first)


def fit(labelled: DataFrame, max_contexts: int = 3000, min_count: int = 3) -> Model | None:
    """Count byte contexts of all labelled documents and freeze their code lengths.

    Every distinct whole text of a language counts once: the counts of a text with copies are taken together and divided
    by their number, so texts aren't moved for it unless very many have copies. Contexts seen fewer than ``min_count`` times
    in a language, and those beyond its ``max_contexts`` most frequent ones, are left to their shorter suffix, unless another
    language keeps them; only kept ones come to the driver. None if nothing is labelled.
    """
    known = labelled.where("text is not null and lang is not null and text != ''").select("text", "lang", F.xxhash64("text").alias("same"))
    again = written(known.groupBy("lang", "same").agg(F.count("*").alias("copies")).where("copies > 1"))
    again = F.broadcast(again) if again.count() <= _SMALL else again
    texts = known.join(again, ["lang", "same"], "left").select("lang", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    counts = texts.mapInPandas(_counted, "lang string, copies long, size int, code long, n long").groupBy("lang", "copies", "size", "code").agg(F.sum("n").alias("n"))
    counts = written(counts.groupBy("lang", "size", "code").agg(F.sum(F.expr("n div copies")).alias("n")).withColumn("context", F.shiftright("code", 8)))
    totals = counts.where("size > 0").groupBy("lang", "size", "context").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "size", "context"))  # byte contexts of a language, however many texts
    kept = totals.withColumn("place", place).where(F.col("place") <= max_contexts).select("size", "context").distinct()
    found = counts.join(F.broadcast(kept), ["size", "context"], "left_semi").unionByName(counts.where("size = 0")).select("lang", "size", "code", "n").toPandas()
    return None if found.empty else frozen(found, max_contexts, min_count)


def frozen(counts: pd.DataFrame, max_contexts: int, min_count: int) -> Model:
    """Code lengths from counts of (lang, size, code): code holds a context of ``size`` bytes and the byte after it.

    A context with n occurrences and q distinct next bytes gives a byte seen c times the probability c / (n + q),
    and escapes to its suffix with q / (n + q); below the empty context all 256 bytes are alike.
    """
    languages = tuple(sorted(counts["lang"].unique()))
    seen = np.unique(counts["code"][counts["size"] == 0].to_numpy())
    symbol = np.full(256, len(seen), dtype=np.int64)
    symbol[seen] = np.arange(len(seen))
    symbols = len(seen) + 1

    totals = counts.assign(context=counts["code"] // 256).groupby(["lang", "size", "context"], as_index=False)["n"].sum()
    totals = totals[(totals["size"] > 0) & (totals["n"] >= min_count)].sort_values(["n", "size", "context"], ascending=[False, True, True])
    kept: dict[tuple[int, int], int] = {(0, 0): 0}
    for size, context in totals.groupby("lang").head(max_contexts)[["size", "context"]].itertuples(index=False):
        kept[int(size), int(context)] = 0
    order = sorted(kept)  # shorter contexts first
    kept = {key: k for k, key in enumerate(order)}

    prob = np.empty((len(order), symbols, len(languages)), np.float32)
    counts = counts.assign(context=counts["code"] // 256)
    place = counts["size"].to_numpy(np.int64) << 32 | counts["context"].to_numpy(np.int64)
    counts = counts[np.isin(place, [size << 32 | context for size, context in order])].sort_values(["size", "context", "lang"])
    keys = list(zip(counts["size"].tolist(), counts["context"].tolist(), counts["lang"]))
    first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    byte, times = (counts["code"] & 255).to_numpy(), counts["n"].to_numpy()
    by = {keys[i]: (byte[i:j], times[i:j]) for i, j in zip(first, [*first[1:], len(keys)])}
    for k, (size, context) in enumerate(order):
        below = np.full((symbols, len(languages)), 1 / 256) if size == 0 else prob[_suffix_row(kept, size - 1, context)]
        prob[k] = below
        for j, lang in enumerate(languages):
            if (got := by.get((size, context, lang))) is not None:
                n, q = got[1].sum(), len(got[1])
                prob[k, :, j] = below[:, j] * q / (n + q)
                prob[k, symbol[got[0]], j] += got[1] / (n + q)
    row = np.zeros(symbols**ORDER, dtype=np.int32)
    for size in range(1, ORDER + 1):
        for (s, context), k in kept.items():
            if s == size:
                digits = [int(symbol[context >> (8 * i) & 255]) for i in range(size)]  # the nearest byte first
                at = sum(d * symbols**i for i, d in enumerate(digits))
                row[at :: symbols**size] = k
    return Model(languages, symbol, symbols, row, np.negative(np.log2(prob, out=prob), out=prob).reshape(-1, len(languages)))


def _suffix_row(kept: dict[tuple[int, int], int], size: int, context: int) -> int:
    while (size, context & ((1 << (8 * size)) - 1)) not in kept:
        size -= 1
    return kept[size, context & ((1 << (8 * size)) - 1)]


def code_lengths(model: Model, texts: list[bytes], step: int = 1 << 18) -> np.ndarray:
    """Bits of each whole text in each language: (texts, languages)."""
    out = np.zeros((len(texts), len(model.languages)))
    group: list[int] = []
    size = 0
    for k, text in enumerate([*texts, None]):
        if group and (text is None or size + len(text) > step):
            _add_lengths(model, [texts[i] for i in group], out[group[0] : group[-1] + 1], step)
            group, size = [], 0
        if text is not None:
            group.append(k)
            size += len(text) + ORDER
    return out


def _add_lengths(model: Model, texts: list[bytes], out: np.ndarray, step: int) -> None:
    m, lead = model.symbols, len(_LEAD)
    at = model.symbol[np.frombuffer(b"".join([_LEAD + x for x in texts]), dtype=np.uint8)]
    starts = np.cumsum([0] + [len(x) + lead for x in texts[:-1]])
    for a in range(lead, len(at), step):  # one step but for a text that is longer
        b = min(len(at), a + step)
        bits = model.bits[model.row[(at[a - 3 : b - 3] * m + at[a - 2 : b - 2]) * m + at[a - 1 : b - 1]] * np.int64(m) + at[a:b]]
        for s in starts:  # the lead of a text isn't part of it
            bits[max(0, s - a) : max(0, s + lead - a)] = 0
        first = int(np.searchsorted(starts, a, side="right")) - 1
        inside = starts[(starts > a) & (starts < b)] - a
        sums = np.add.reduceat(bits, np.append(0, inside), axis=0, dtype=np.float64)
        out[first : first + len(sums)] += sums


SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every column of docs, and lang_pred, score and bits_per_byte of the whole text.

    The language with the shortest code wins, ties going to the first in order; score is its posterior
    probability with all languages equally likely before. A text that is null or has no letter is ``und`` with
    score 0, as is every text without a model. bits_per_byte is the best code length (null for ``und``).
    Columns of these three names in docs are replaced.
    """
    new = ("lang_pred", "score", "bits_per_byte")
    rest = [c for c in docs.columns if c.lower() not in new]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by max_contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, n = shared.value, batch.num_rows
            texts, letters = batch.column(batch.num_columns - 2), np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            lang = np.full(n, "und", dtype=object)
            score, per_byte = np.zeros(n), np.full(n, np.nan)
            chosen = np.flatnonzero(letters) if model else np.array([], dtype=int)
            for k in range(0, len(chosen), 256):
                some = chosen[k : k + 256]
                raw = texts.take(pa.array(some)).to_pylist()
                bits = code_lengths(model, raw)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(some)), best]
                lang[some] = np.array(model.languages, dtype=object)[best]
                score[some] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                per_byte[some] = least / [len(x) for x in raw]
            made = [pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte, mask=np.isnan(per_byte))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], names=[*rest, *new])

    text = F.col("text").cast("string")
    given = docs.select(*[f"`{c}`" for c in rest], text.cast("binary").alias(free_name("_text", docs)), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias(free_name("_letters", docs)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in rest]).schema)
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double, bits_per_byte double")
