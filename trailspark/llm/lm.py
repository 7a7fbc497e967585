"""Document likelihood over a lattice of subword segmentations (operator 6)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import written
from trailspark.llm.shingles import words_of

#: Mass that each known word gives up to the segmentations.
DISCOUNT = 0.75
_SPACE = "▁"


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The vocabulary's pieces as byte strings in Latin-1, with a blank for the word mark, and their scores.

    Pieces that can't stand in a lower-cased word (a word mark inside, white space, control pieces) are left out;
    the 256 byte pieces make every word segmentable.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = chr(int(piece[3:5], 16)) if model.is_byte(i) else piece.replace(_SPACE, " ").encode().decode("latin-1")
        if raw and " " not in raw[1:] and not any("A" <= c <= "Z" or "\t" <= c <= "\r" for c in raw):
            best[raw] = max(best.get(raw, -math.inf), model.get_score(i))
    for b in range(256):
        best.setdefault(chr(b), min(best.values(), default=0.0))
    return sorted(best.items())


class Lattice:
    """All segmentations of a word into pieces; logs are base 10."""

    def __init__(self, logs: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, log in logs.items():
            self.automaton.add_word(piece, (len(piece), log * math.log(10)))
        self.automaton.make_automaton()

    def marginal(self, word: bytes) -> float:
        """log10 of the summed probability of every segmentation of " word"; forward recursion in log space."""
        text = " " + word.decode("latin-1")
        forward = [0.0] + [-math.inf] * len(text)
        exp, log1p = math.exp, math.log1p
        for end, (size, log) in self.automaton.iter(text):
            start = forward[end + 1 - size]
            if start == -math.inf:
                continue
            new, old = start + log, forward[end + 1]
            forward[end + 1] = new if old == -math.inf else new + log1p(exp(old - new)) if new > old else old + log1p(exp(new - old))
        return forward[-1] / math.log(10)

    def best(self, word: bytes) -> list[str]:
        """The likeliest segmentation of " word"."""
        text = " " + word.decode("latin-1")
        forward: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
        for end, (size, log) in self.automaton.iter(text):
            if (new := forward[end + 1 - size][0] + log) > forward[end + 1][0]:
                forward[end + 1] = (new, size)
        out, at = [], len(text)
        while at:
            size = forward[at][1]
            out.append(text[at - size : at])
            at -= size
        return out[::-1]


def _initial(pieces: list[tuple[str, float]]) -> dict[str, float]:
    """log10 weights from the vocabulary's scores: where they are merge ranks (not logs), a rank r weighs 1 / (r + 100)."""
    scores = np.array([s for _, s in pieces])
    weight = 1 / (100 - scores) if scores.min(initial=0) < -300 else np.exp(scores)
    return dict(zip([p for p, _ in pieces], np.log10(weight / weight.sum()).tolist()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned: Counter = Counter()
    other: Counter = Counter()

    def taken() -> pa.RecordBatch:
        for w in learned:
            other[w] += 0
        words = list(other)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learned[w] for w in words], pa.int64()), pa.array([other[w] + learned[w] for w in words], pa.int64())], names=["word", "c", "uses"])
        learned.clear()
        other.clear()
        return out

    for batch in batches:
        for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (learned if train else other).update(words_of(text or b""))
            if len(learned) + len(other) > 700_000:
                yield taken()
    yield taken()


def word_model(docs: DataFrame, train: str, vocabulary: str) -> tuple[DataFrame, dict]:
    """(word, c, uses, log_p) of every distinct word of docs, and the totals of the training tokens.

    c counts a word in the documents where column ``train`` is true. The vocabulary's pieces get the frequencies
    that the best segmentations of the distinct training words give them, on top of their own scores. A known
    word is one more segmentation of itself: P(w) = max(c - DISCOUNT, 0) / N + reserve * sum over segmentations.
    """
    text = F.col("text").cast("string").cast("binary")
    types = docs.select(text.alias("text"), train).mapInArrow(_counted, "word binary, c long, uses long")
    types = written(types.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses")))
    known = types.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = docs.where(train).count()
    totals = {"N": (known["n"] or 0) + ends, "V": (known["v"] or 0) + (ends > 0), "ends": ends}
    pieces = pieces_of(vocabulary)
    initial = _initial(pieces)

    def segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, used = Lattice(initial), Counter()
        for batch in batches:
            for word in batch["word"]:
                used.update(lattice.best(word))
        yield pd.DataFrame({"piece": [p.encode("latin-1") for p in used], "n": np.array(list(used.values()), dtype=np.int64)})

    counts = types.where("c > 0").select("word").mapInPandas(segmented, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    weight = {p: 10**s * len(pieces) * 0.1 for p, s in initial.items()}  # the vocabulary's own scores, as if seen a tenth as often as there are pieces
    for r in counts.collect():  # one row for each piece at most
        weight[r["piece"].decode("latin-1")] += r["n"]
    whole = sum(weight.values())
    logs = {p: math.log10(w / whole) for p, w in weight.items()}
    n = max(totals["N"], 1)
    reserve = DISCOUNT * known["v"] / n if known["v"] else 1.0  # the end token gives nothing up
    totals["reserve"] = reserve

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(logs)
        for batch in batches:
            out = []
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spelt = lattice.marginal(word) + math.log10(reserve)
                if c:
                    direct = math.log10((c - DISCOUNT) / n)
                    spelt = max(spelt, direct) + math.log10(1 + 10 ** -abs(spelt - direct))
                out.append(spelt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["word", "c", "uses", "log_p"])

    return written(types.mapInArrow(weighed, "word binary, c long, uses long, log_p double")), totals


def score(docs: DataFrame, train: str, vocabulary: str, head: int = 300_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text and the
    boolean column ``train``).

    The ``head`` most frequent words at most, however large the corpus, go to the tasks by broadcast; all other
    words of a document meet their figures in a shuffled join, once for each document and word. A null text
    counts as empty and has the end token alone. Repeated rows are scored once each.
    """
    spark = docs.sparkSession
    model, totals = word_model(docs, train, vocabulary)
    least, some = 1 << 62, 0
    for uses, n in model.groupBy("uses").count().orderBy(F.desc("uses")).limit(head).toLocalIterator():
        if some + n > head:
            break
        least, some = uses, some + n
    common = {bytes(w): (c, p) for w, c, p in model.where(F.col("uses") >= least).select("word", "c", "log_p").collect()}
    shared = spark.sparkContext.broadcast(common)
    n, bottom = totals["N"], math.log10(totals["N"] + 0.1 * (totals["V"] + 1))
    ends = totals["ends"]
    end_base = math.log10(ends + 0.1) - bottom
    end_p = math.log10(ends / n) if ends else math.log10(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: (c > 0, math.log10(c + 0.1) - bottom, p) for w, (c, p) in shared.value.items()}
        task, row = TaskContext.get().partitionId() << 40, 0
        names = ["row", "doc_id", "word", "n", "n_tokens", "n_known", "base", "p"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, known, base, p, size = task + row, int(ends > 0), end_base, end_p, 1
                row += 1
                for word, k in Counter(words_of(text or b"")).items():
                    size += k
                    if (got := table.get(word)) is None:
                        out.append((own, None, word, k, None, None, None, None))
                    else:
                        known, base, p = known + k * got[0], base + k * got[1], p + k * got[2]
                out.append((own, doc_id, b" " + own.to_bytes(8, "little"), None, size, known, base, p))  # matches no word
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "row long, doc_id long, word binary, n long, n_tokens long, n_known long, base double, p double")
    rare = model.where(F.col("uses") < least).select("word", "c", "log_p")
    met = parts.join(rare, "word", "left").select(
        "row", "doc_id", "n_tokens",
        F.coalesce("n_known", F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.coalesce("base", F.col("n") * (F.log10(F.col("c") + 0.1) - bottom)).alias("base"),
        F.coalesce("p", F.col("n") * F.col("log_p")).alias("p"),
    )
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("p").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
