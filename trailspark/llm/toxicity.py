"""Toxicity from weak supervision (operator 2).

Many lexicon and pattern voters are read off a bounded sample of labelled documents. A generative label model
with class-conditional firing rates and correlations turns the votes of all training documents into posterior
labels, and a linear classifier on word and pattern features learns those.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import bounded_share, in_share, written

_WORD = re.compile(r"[^\W\d_]+")
#: How much a known label counts against the label model's own posterior.
ANCHOR = 0.9
#: A pattern is a word's first letters, that many of them.
STEMS = (4, 5, 6)


#: Standard errors that a feature's log odds are from nought at least; what chance brings stays below.
SURE = 3.5
#: A feature that makes up this share of a document's words also counts as dense; its name then ends with "^".
DENSE = 0.01


def marks(word: str) -> list[str]:
    """The features of a word: itself, and its stems with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def features_of(text: str) -> set[str]:
    """All features of a text, plain and dense."""
    seen: Counter = Counter()
    total = 0
    for word, n in words(text).items():
        total += n
        for m in marks(word):
            seen[m] += n
    return {*seen, *(m + "^" for m, n in seen.items() if n >= DENSE * total)}


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that have a feature."""
    seen = (Counter(), Counter())

    def taken() -> pd.DataFrame:
        out = pd.DataFrame({"feature": list(seen[0].keys() | seen[1].keys())}, dtype=object)
        for k, name in enumerate(("clean", "toxic")):
            out[name] = np.array([seen[k][f] for f in out["feature"]], dtype=np.int64)
            seen[k].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            seen[toxic].update(features_of(text))
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield taken()
    yield taken()


@dataclass(frozen=True)
class Matcher:
    """Finds the features of ``index`` in texts; remembers which of them a word can have for the life of the task."""

    index: dict[str, int]

    def of(self, text: str, cache: dict[str, tuple[str, ...]]) -> list[int]:
        index, seen, total = self.index, Counter(), 0
        for word, n in words(text).items():
            total += n
            got = cache.get(word)
            if got is None:
                if len(cache) > 500_000:
                    cache.clear()
                got = cache[word] = tuple(m for m in marks(word) if m in index or m + "^" in index)
            for m in got:
                seen[m] += n
        found = [index[m] for m in seen if m in index]
        found += [index[m + "^"] for m, n in seen.items() if n >= DENSE * total and m + "^" in index]
        return sorted(found)


@dataclass(frozen=True)
class LabelModel:
    """Votes x of a document give the log odds w.x + b. toxic and clean hold how often each voter fires in a class."""

    toxic: np.ndarray
    clean: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray
    bias: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weight + self.bias, -30, 30)))


def label_model(toxic: np.ndarray, clean: np.ndarray, correlation: np.ndarray, prior: float) -> LabelModel:
    """A voter that fires adds its log odds, shared among those that fire with it; one that doesn't abstains.

    The share is one over the sum of its squared correlations, itself included: k copies of a voter weigh as one.
    """
    odds = np.log(np.maximum(toxic, 1e-6)) - np.log(np.maximum(clean, 1e-6))
    weight = odds / (1 + (np.maximum(correlation * (1 - np.eye(len(toxic))), 0) ** 2).sum(axis=1)) if len(toxic) else odds
    return LabelModel(toxic, clean, correlation, weight, float(np.log(prior / (1 - prior))))


def estimate(votes: DataFrame, toxic: np.ndarray, clean: np.ndarray, prior: float, rounds: int) -> LabelModel:
    """Expectation-maximisation over all rows of votes (the voters that fired, and the label or -1).

    A known label counts ANCHOR of a document, the model's own posterior the rest.
    """
    k = len(toxic)
    model = label_model(toxic, clean, np.eye(k), prior)
    for _ in range(rounds if k else 0):
        now = model

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s1, s0, both1, both0, n = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, k)), np.zeros(2)
            for batch in batches:
                for a in range(0, len(batch), 4096):
                    x = np.zeros((len(some := batch["votes"].iloc[a : a + 4096]), k))
                    for i, fired in enumerate(some):
                        x[i, fired] = 1
                    p, known = now.posterior(x), batch["label"].to_numpy()[a : a + 4096]
                    p = np.where(known >= 0, ANCHOR * known + (1 - ANCHOR) * p, p)
                    n += p.sum(), (1 - p).sum()
                    s1, s0 = s1 + p @ x, s0 + (1 - p) @ x
                    both1, both0 = both1 + (x * p[:, None]).T @ x, both0 + (x * (1 - p)[:, None]).T @ x
            yield pd.DataFrame({"sums": [np.concatenate([n, s1, s0, both1.ravel(), both0.ravel()])]})

        total = np.sum([r["sums"] for r in votes.mapInPandas(sums, "sums array<double>").collect()], axis=0)
        n, s1, s0 = total[:2] + 1, total[2 : 2 + k], total[2 + k : 2 + 2 * k]
        both1, both0 = total[2 + 2 * k :].reshape(2, k, k)
        toxic, clean = (s1 + 0.5) / n[0], (s0 + 0.05) / n[1]
        covariance = (both1 - n[0] * np.outer(toxic, toxic) + both0 - n[1] * np.outer(clean, clean)) / n.sum()
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        model = label_model(toxic, clean, np.clip(covariance / np.outer(spread, spread), -1, 1), float(np.clip(n[0] / n.sum(), 0.001, 0.9)))
    return model


def logistic(rows: list[np.ndarray], target: np.ndarray, features: int, rounds: int = 300, l2: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by full gradients with momentum; targets are probabilities."""
    w, b, v, vb = np.zeros(features), 0.0, np.zeros(features), 0.0
    if not rows:
        return w, b
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    f = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    share = np.where(target > 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, weights=w[f], minlength=len(rows)), -30, 30)))
        g = (p - target) * share
        v = 0.9 * v - 2.0 * (np.bincount(f, weights=g[at], minlength=features) + l2 * w)
        vb = 0.9 * vb - 2.0 * g.sum()
        w, b = w + v, b + vb
    return w, b


@dataclass(frozen=True)
class Classifier:
    matcher: Matcher
    weight: np.ndarray
    bias: float
    voters: tuple[str, ...] = ()
    labels: LabelModel | None = None


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_voters: int = 96, max_features: int = 4096, max_trained: int = 12_000, rounds: int = 4) -> Classifier:
    """A classifier from documents (doc_id, text) and labels (doc_id, toxic 0 or 1), both to be learned from.

    max_labelled bounds the labelled documents that voters and features are read off, max_trained the documents
    that the linear classifier learns from; both are chosen by a hash of the id, half from either class where it
    has as many. The label model's statistics cover every document. Without labels of both classes, every score is
    the same.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Classifier(Matcher({}), np.zeros(0), -4.0)
    share = F.when(F.col("toxic") == 1, bounded_share(totals[1], max_labelled // 2)).otherwise(bounded_share(totals[0], max_labelled // 2))
    sample = written(texts.join(F.broadcast(marked.where(in_share("doc_id", share))), "doc_id"))  # about max_labelled rows, whatever the corpus
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    tallies = sample.select("text", "toxic").mapInPandas(_tallied, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = tallies.where(F.col("toxic") + F.col("clean") >= 4).withColumn("odds", odds).where(F.abs("odds") >= SURE * spread)
    gain = (F.col("toxic") / max(n1, 1) - F.col("clean") / max(n0, 1)) * F.abs("odds")
    best = strong.withColumn("gain", F.abs(gain)).orderBy(F.desc("gain"), "feature").limit(max_features).toPandas()
    chosen = best[(best["odds"] > 2) & (best["toxic"] >= 4)].head(max_voters)
    voters, features = tuple(chosen["feature"]), tuple(best["feature"])

    finder, k = Matcher({f: i for i, f in enumerate(voters)}), len(voters)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "votes": [finder.of(t, cache) for t in batch["text"]]})

    voted = texts.where("doc_id is not null").mapInPandas(vote, "doc_id long, votes array<int>")
    votes = written(voted.join(marked, "doc_id", "left").select("doc_id", "votes", F.coalesce("toxic", F.lit(-1)).alias("label")))
    toxic = (chosen["toxic"].to_numpy() + 0.5) / (n1 + 1)
    clean = (chosen["clean"].to_numpy() + 0.05) / (n0 + 1)
    model = estimate(votes, toxic, clean, totals[1] / (totals[0] + totals[1]), rounds)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), k))
            for i, fired in enumerate(batch["votes"]):
                x[i, fired] = 1
            known, p = batch["label"].to_numpy(), model.posterior(x)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "p": np.where(known >= 0, ANCHOR * known + (1 - ANCHOR) * p, p)})

    posterior = written(votes.mapInPandas(judged, "doc_id long, p double").dropDuplicates(["doc_id"]))
    counts = posterior.agg(F.sum((F.col("p") > 0.5).cast("long")).alias("t"), F.count("*").alias("n")).first()
    likely = counts["t"] or 0
    share = F.when(F.col("p") > 0.5, bounded_share(likely, max_trained // 2)).otherwise(bounded_share(counts["n"] - likely, max_trained // 2))
    known, index = Matcher({f: i for i, f in enumerate(features)}), len(features)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            yield pd.DataFrame({"found": [known.of(t, cache) for t in batch["text"]], "p": batch["p"]})

    chosen_docs = F.broadcast(posterior.where(in_share("doc_id", share, 23)))  # about max_trained rows, whatever the corpus
    rows = texts.join(chosen_docs, "doc_id").select("text", "p").mapInPandas(featured, "found array<int>, p double").toPandas()
    weight, bias = logistic([np.asarray(r, dtype=np.int64) for r in rows["found"]], rows["p"].to_numpy(dtype=float), index)
    return Classifier(known, weight, bias, voters, model)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of every row of docs, from its whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded by max_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            c = shared.value
            odds = np.array([c.bias + c.weight[c.matcher.of(t or "", cache)].sum() for t in batch.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
