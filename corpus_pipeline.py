"""Cleaning pipeline of a text corpus: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and keeps the columns of ``documents`` but for the last, whose rows are
pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import decontaminate, jaccard, langid, linededup, packing
from trailspark.llm.common import free_name, table, written

#: Bits a byte beyond which no learned language explains a text; prose stays below 4.
MOST_BITS_PER_BYTE = 6.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that ``lang`` names; the rest goes (``und``, or no better than noise)."""
    judged = langid.predict(docs, langid.fit(docs))
    kept = judged.where(f"lang_pred != 'und' and bits_per_byte <= {MOST_BITS_PER_BYTE}")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of two or more lines that stand in an earlier place; n_chars follows the text."""
    cut = linededup.dedup_passages(docs)
    return cut.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at 0.8, with the smallest id; a null id comes last.

    Rows are told apart by id and text together, so unlike texts stay under a null or repeated id and a copy goes
    whatever its id is. Texts without words link to nothing: of these only rows with equal id and text become one.
    """
    key = free_name("_key", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    classes = jaccard.join(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100).select(F.col("doc_id").alias(key), "component_id")
    ids = keyed.select(key, "doc_id").join(classes.distinct(), key)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")).select(f"first.{key}")
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where("size(matches) = 0").drop("matches")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near duplicates", remove_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("packing", pack),
]

#: The stages' models are not expressible in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
