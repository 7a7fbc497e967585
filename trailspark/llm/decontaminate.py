"""Benchmark decontamination by latent semantic retrieval and common-subsequence checks (operator 3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import bounded_share, free_name, in_share, written
from trailspark.llm.shingles import all_word_hashes, word_hashes

#: Words of a benchmark passage at most, and from one window's start to the next.
WINDOW, STRIDE = 48, 16
#: Terms in more than this share of the documents get no weight in the latent space; the first of these bounds holds
#: with which every item keeps this part of its squared weight. The subsequence check uses all terms.
STOP, KEPT = (0.125, 0.25, 0.5, 1), 0.9
#: Windows of a document that are compared at once.
_CHUNK = 2048
#: Rows of words that are counted together: their matrix stays small.
_ROWS = 32
#: Documents whose passages a task adds up at least, but for the first tasks; each sends terms x dimensions.
_TASK_DOCS, _FEW_TASKS = 8_000, 12


@dataclass(frozen=True)
class Rules:
    """Limits of a match. A window is a candidate for a benchmark passage at this ``cosine`` in the latent space
    and ``least`` of the passage's squared norm in it, or at this ``share`` of it whatever the cosine. A window and an item match when their longest common
    subsequence holds ``sure`` of the item's words, or ``likely`` of them and ``answer`` of its last words."""

    cosine: float = 0.5
    least: float = 0.25
    share: float = 0.5
    sure: float = 0.8
    likely: float = 0.55
    answer: float = 0.5


class Vocabulary:
    """Ids of known terms, which are fingerprints of words without marks at their ends; -1 for other words.

    ``codes`` are sorted. Words are looked up by their last bits; terms that share these are searched for.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.mask = np.uint64((1 << max(10, (16 * len(codes)).bit_length())) - 1)
        slot = codes & self.mask
        self.first = np.full(int(self.mask) + 1, -1, np.int32)
        self.first[slot] = np.arange(len(codes))
        slots, n = np.unique(slot, return_counts=True)
        self.first[slots[n > 1]] = -2

    def ids(self, code: np.ndarray) -> np.ndarray:
        at = self.first[code & self.mask]
        shared = np.flatnonzero(at == -2)
        at[shared] = np.minimum(np.searchsorted(self.codes, code[shared]), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, np.int32(-1))


def terms(texts: list[bytes | None]) -> list[np.ndarray]:
    """Fingerprints of each text's words without marks at their ends."""
    return all_word_hashes([t or b"" for t in texts], strip=True)


def common_subsequence(item: list, words: list) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the range of ``words`` in which it grows; bit-parallel."""
    at: dict = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    mask, row, length, first, last = (1 << len(item)) - 1, (1 << len(item)) - 1, 0, 0, 0
    for k, w in enumerate(words):
        if hit := row & at.get(w, 0):
            row = ((row + hit) | (row - hit)) & mask
            if (now := len(item) - row.bit_count()) > length:
                first, last, length = (k if not length else first), k + 1, now
    return length, first, last


@dataclass(frozen=True)
class Passages:
    """Benchmark passages that are sought in windows of one width: unit vectors, norms, and the items they are from."""

    unit: np.ndarray
    norm: np.ndarray
    owner: np.ndarray


@dataclass(frozen=True)
class Index:
    """The benchmark in its latent space. ``weights``: the latent vector of a term, times its idf; ``heavy``: which terms
    have one, with False for unknown words at the end; ``passages``: by how many strides a window holds; ``items``: the
    term ids of each item, ``words`` all of them in one row and ``first`` where each item's begin there."""

    codes: np.ndarray
    heavy: np.ndarray
    weights: np.ndarray
    passages: dict[int, Passages]
    items: list[list[int]]
    words: np.ndarray
    first: np.ndarray


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").cast("binary"))


def _counted(docs: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(code, n): in how many documents each of the values occurs that ``of`` makes of its terms, and all documents under a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = size = 0

        def taken() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

        for batch in batches:
            for code in terms(batch.column(0).to_pylist()):
                held.append(np.unique(of(code)))
                total, size = total + 1, size + len(held[-1])
                if size > 2_000_000:
                    yield taken()
                    size = 0
        yield taken()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["code", "n"])

    return _texts(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _bags(ids: np.ndarray, row: np.ndarray, terms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of up to _ROWS rows with words: the first row, the distinct ids, and how often each row has them.

    ids: the words of all rows, below ``terms``; row: each word's row, ascending.
    """
    if not len(ids):
        return
    place = np.empty(terms, np.int64)
    cuts = np.searchsorted(row, np.arange(row[0], row[-1] + _ROWS + 1, _ROWS)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            some, at = ids[a:b], np.arange(b - a)
            place[some] = at
            used = some[place[some] == at]
            place[used] = np.arange(len(used))
            held = row[a:b] - row[a]
            size = int(held[-1]) + 1
            yield int(row[a]), used, np.bincount(held * len(used) + place[some], minlength=size * len(used)).reshape(size, -1).astype(np.float32)


def _gram_times(rows: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """A'(A q) for the matrix A of how often each of some passages has a term; ids below nought are left out."""
    size = np.array([len(x) for x in rows])
    flat, out = np.concatenate(rows), np.zeros_like(q)
    known = np.flatnonzero(flat >= 0)
    for _, used, counts in _bags(flat[known], np.repeat(np.arange(len(rows)), size)[known], len(q)):
        out[used] += counts.T @ (counts @ q[used])
    return out


def _over_passages(docs: DataFrame, codes: np.ndarray, heavy: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) over the passages of all documents, of their heavy terms, which each task adds up before anything moves."""
    shared = docs.sparkSession.sparkContext.broadcast((codes, heavy, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, heavy, q = shared.value
        words, total = Vocabulary(codes), np.zeros(q.shape)
        place = np.append(np.where(heavy, np.arange(len(codes)), -1), -1)

        for batch in batches:
            rows: list[np.ndarray] = []
            size = 0
            for code in terms(batch.column(0).to_pylist()):
                ids = place[words.ids(code)]
                rows += [ids[a : a + WINDOW] for a in range(0, len(ids), WINDOW)]
                size += len(ids)
                if size > 500_000:
                    total += _gram_times(rows, q)
                    rows, size = [], 0
            if rows:
                total += _gram_times(rows, q)
        blocks = [(k, total[k : k + 32].astype(np.float32).tobytes()) for k in range(0, len(total), 32)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["k", "part"])

    def summed(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": batch["k"].iloc[:1], "part": [np.sum([np.frombuffer(p, np.float32) for p in batch["part"]], axis=0, dtype=np.float64).tobytes()]})

    out = np.zeros(q.shape)
    for r in _texts(docs).mapInArrow(run, "k int, part binary").groupBy("k").applyInPandas(summed, "k int, part binary").collect():
        out[r["k"] : r["k"] + 32] = np.frombuffer(r["part"]).reshape(-1, q.shape[1])
    shared.destroy()
    return out


def index(docs: DataFrame, items: list[bytes], dimensions: int = 128, max_sample: int | None = None, max_terms: int = 8192) -> Index | None:
    """Randomised singular value decomposition of the TF-IDF matrix of passages, and the items in its space.

    Its columns are the items' terms and the ``max_terms`` terms that most of all documents have; document frequencies come from all documents too, in one
    count. Its rows are the passages of all documents (``max_sample``: of about so many, chosen by a hash, for trials) and of the benchmark, which
    weigh as much as all of these in total, so that each keeps a direction. One pass over the documents multiplies the Gram matrix with a random
    start; what that spans holds the directions, and the product itself gives their order (Nystroem's approximation).
    What a task sends is terms x dimensions, both bounded.
    """
    words = terms(items)
    own = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    if not len(own):
        return None
    counted = written(_counted(docs, lambda code: code.view(np.int64)))
    common = counted.where("code is not null").orderBy(F.desc("n"), "code").limit(max_terms)
    codes = np.union1d(own, np.array([r["code"] for r in common.collect()], np.int64).view(np.uint64))

    vocabulary = Vocabulary(codes)
    asked = docs.sparkSession.createDataFrame(pd.DataFrame({"code": codes.view(np.int64)}), "code long")
    total = counted.where("code is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # no task, no row
    frequency = np.zeros(len(codes))
    for r in counted.join(F.broadcast(asked), "code").collect():
        frequency[vocabulary.ids(np.array([r["code"]], np.int64).view(np.uint64))[0]] = r["n"]
    idf = np.log((total + len(items) + 1.0) / (frequency + 1.0)).astype(np.float32)

    split = [vocabulary.ids(t) for t in words]
    for bound in STOP:
        heavy = frequency <= bound * total
        if bound == 1 or all((idf[x[heavy[x]]] ** 2).sum() >= KEPT * (idf[x] ** 2).sum() for x in split):
            break
    idf = np.where(heavy, idf, np.float32(0))
    rows = [(i, x[a : a + WINDOW]) for i, x in enumerate(split) for a in range(0, len(x), WINDOW)]
    rows = [(i, x) for i, x in rows if 3 * len(x) >= WINDOW or len(split[i]) < WINDOW]  # no short ends of long items
    near = [x[heavy[x]] if heavy[x].any() else x for _, x in rows]
    energy = float(sum((idf[x] ** 2).sum() for x in near))
    rest = float(((idf**2) * frequency).sum())
    passages_of = docs
    if max_sample is not None:
        share = bounded_share(total, max_sample)
        passages_of, rest = docs.where(in_share(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), share)), rest * share / (1 << 20)
    start = np.random.default_rng(7).standard_normal((len(codes), min(dimensions + 16, len(codes)))).astype(np.float32)
    weighted = start * idf[:, None]
    product = _over_passages(passages_of.coalesce(max(_FEW_TASKS, -(-total // _TASK_DOCS))), codes, heavy, weighted)
    product = (product + _gram_times(near, weighted) * max(1.0, rest / max(energy, 1e-9))) * idf[:, None]
    q, r = np.linalg.qr(product)
    small = start.T @ product
    value, vector = np.linalg.eigh(r @ np.linalg.pinv((small + small.T) / 2, 1e-6, hermitian=True) @ r.T)
    basis = q @ vector[:, np.argsort(-value)[:dimensions]]
    weights = np.ascontiguousarray(idf[:, None] * basis, np.float32)
    passages = {}
    strides = np.array([-(-(STRIDE - 1 + len(x)) // STRIDE) for _, x in rows])  # a window that holds it wherever it begins
    for k in np.unique(strides).tolist():
        some = np.flatnonzero(strides == k)
        latent = np.array([weights[near[j]].sum(axis=0) for j in some])
        norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        passages[k] = Passages(latent / norm[:, None], norm, np.array([rows[j][0] for j in some]))
    first = np.cumsum([0] + [len(x) for x in split[:-1]])
    return Index(codes, np.append(heavy, False), weights, passages, [x.tolist() for x in split], np.concatenate(split), first)


def _near(ids: np.ndarray, ix: Index, rules: Rules) -> tuple[np.ndarray, ...]:
    """item, cosine, first word and end of the windows near one of its passages in the latent space, as columns.

    Products are by unit of a passage's norm, so that one comparison with the least share leaves few of them for the rest.
    """
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    known = np.flatnonzero(ix.heavy[ids])
    blocks, most = -(-len(ids) // STRIDE), max(ix.passages)
    least = np.float32(min(rules.least, rules.share) * 0.9999)
    scaled = {k: np.ascontiguousarray((p.unit / p.norm[:, None]).T) for k, p in ix.passages.items()}
    for a in range(0, blocks, _CHUNK) if len(known) else ():
        b = min(blocks, a + _CHUNK + most)
        some = known[np.searchsorted(known, a * STRIDE) : np.searchsorted(known, b * STRIDE)]
        if not len(some):
            continue
        upto = np.zeros((b - a + 1, ix.weights.shape[1]), np.float32)
        for row, used, counts in _bags(ids[some], some // STRIDE - a, len(ix.codes)):
            upto[row + 1 : row + 1 + len(counts)] = counts @ ix.weights[used]
        np.cumsum(upto, axis=0, out=upto)
        for k, p in ix.passages.items():
            start = np.arange(0, max(1, min(_CHUNK, blocks - k + 1 - a)))
            windows = upto[np.minimum(start + k, b - a)] - upto[start]
            part = (windows @ scaled[k]).ravel()
            hits = np.flatnonzero(part >= least)
            w, j = np.divmod(hits, len(p.norm))
            size = np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-9)[w]
            norm = p.norm[j]
            product = part[hits] * norm
            sure = product >= np.minimum(np.maximum(rules.cosine * size, rules.least * norm), rules.share * norm)
            w, j = w[sure], j[sure]
            found.append((p.owner[j], product[sure].astype(np.float64) / size[sure], (a + w) * STRIDE, np.minimum(len(ids), (a + w + k) * STRIDE)))
    return tuple(np.concatenate(c) for c in zip(*found))


def candidates(ids: np.ndarray, ix: Index, rules: Rules) -> dict[int, list[tuple[float, int, int]]]:
    """For each item, the (cosine, first word, end) of the windows near one of its passages in the latent space."""
    found: dict[int, list[tuple[float, int, int]]] = {}
    for item, *window in zip(*(c.tolist() for c in _near(ids, ix, rules))):
        found.setdefault(item, []).append(tuple(window))
    return found


def all_candidates(texts: list[np.ndarray], ix: Index, rules: Rules, at_once: int = 1 << 16) -> Iterator[dict[int, list[tuple[float, int, int]]]]:
    """candidates of each of several texts. Short ones are laid out in one row of words, each from a stride's beginning
    on and with a window's width between them, so that no window holds words of two."""
    gap = max(ix.passages) * STRIDE
    begin = 0
    while begin < len(texts):
        end, offset = begin, [0]
        while end < len(texts) and (end == begin or offset[-1] + len(texts[end]) <= at_once):
            offset.append(offset[-1] + -(-len(texts[end]) // STRIDE) * STRIDE + gap)
            end += 1
        row = np.full(offset[-1], -1, np.int32)
        for a, ids in zip(offset, texts[begin:end]):
            row[a : a + len(ids)] = ids
        found: list[dict] = [{} for _ in range(begin, end)]
        item, cosine, a, b = _near(row, ix, rules)
        place = np.searchsorted(offset, a, side="right") - 1
        at, size = np.array(offset)[place], np.array([len(x) for x in texts[begin:end]])[place] if len(place) else place
        inside = a - at < size
        columns = (place, item, cosine, a - at, np.minimum(b - at, size))
        for k, i, *window in zip(*(c[inside].tolist() for c in columns)):
            found[k].setdefault(i, []).append(tuple(window))
        yield from found
        begin = end


def matches(ids: np.ndarray, ix: Index, rules: Rules, near: dict[int, list[tuple[float, int, int]]]) -> list[tuple]:
    """(item, cosine, share of common subsequence, share of last words, first and last word) of one document's candidates."""
    best: dict[int, tuple] = {}
    if near:
        whole = np.zeros(len(ix.codes) + 1, bool)
        whole[ids] = True
        held = np.add.reduceat(whole[ix.words], ix.first, dtype=np.int64).tolist()  # no item is without words
    for item, found in near.items():
        words = ix.items[item]
        least = min(rules.sure, rules.likely) * len(words)
        if held[item] < least:
            continue  # no window has more of its words than the text
        tail = words[-max(3, len(words) // 5) :]
        for cosine, a, b in sorted(found, reverse=True):
            lo, hi = max(0, a - len(words) // 2), min(len(ids), b + len(words) // 2)
            window = ids[lo:hi].tolist()
            present = set(window)
            if sum(map(present.__contains__, words)) < least:
                continue  # the common subsequence is no longer than that
            length, first, last = common_subsequence(words, window)
            share = length / len(words)
            there = set(window[first:last])
            answer = sum(map(there.__contains__, tail)) / len(tail)
            if (share >= rules.sure or share >= rules.likely and answer >= rules.answer) and (item not in best or share > best[item][1]):
                best[item] = (cosine, share, answer, lo + first, lo + last)
                if share == 1:
                    break
    return [(item, *best[item]) for item in sorted(best)]


MATCH = "array<struct<item_id: bigint, cosine: double, lcs_share: double, answer_share: double, first_word: int, last_word: int>>"


def find(docs: DataFrame, benchmark: DataFrame, dimensions: int = 128, block: int = 1000, rules: Rules = Rules()) -> DataFrame:
    """Every row and column of docs, and ``matches``: the benchmark items (item_id, text) that its text holds.

    Every distinct text of the benchmark that has words is sought; it is reported under its item_id, which may be
    null. Texts are taken ``block`` at a time, which bounds what is broadcast; a larger benchmark takes more passes
    over docs, which is read as it is, unshuffled. A null or empty text has no matches; repeated rows of docs are
    kept. A column ``matches`` in docs is replaced.
    """
    given = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-given.count() // block))
    rest = [c for c in docs.columns if c.lower() != "matches"]
    out = docs.select(*[f"`{c}`" for c in rest]).withColumn("matches", F.expr(f"cast(array() as {MATCH})"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("matches").schema)
    for k in range(blocks):
        items = sorted([(r["item_id"], r["text"].encode()) for r in given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()], key=lambda x: (x[0] is None, x))
        items = [(i, t) for i, t in items if len(word_hashes(t, strip=True))]
        if (ix := index(docs, [t for _, t in items], dimensions)) is not None:
            out = _marked(out, docs.sparkSession.sparkContext.broadcast((ix, [i for i, _ in items])), rest, fields, rules)
    return out


def _marked(out: DataFrame, shared, rest: list[str], fields: str, rules: Rules) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, names_of = shared.value
        words = Vocabulary(ix.codes)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        names = [f.name for f in kind.value_type]

        for batch in batches:
            ids = [words.ids(code) for code in terms(batch.column(batch.num_columns - 1).to_pylist())]
            got = [matches(x, ix, rules, near) for x, near in zip(ids, all_candidates(ids, ix, rules))]
            new = [(o or []) + [dict(zip(names, (names_of[item], *more))) for item, *more in m] for o, m in zip(batch.column(batch.num_columns - 2).to_pylist(), got)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(new, kind)], names=[*rest, "matches"])

    given = out.select(*[f"`{c}`" for c in rest], "matches", F.col("text").cast("string").cast("binary").alias(free_name("_text", out)))
    return given.mapInArrow(run, f"{fields}, matches {MATCH}")
