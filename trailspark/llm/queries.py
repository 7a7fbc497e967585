"""One query per operator of this subpackage, over whole tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import bitsliced, bpe, decontaminate, divergence, jaccard, langid, linededup, lm, packing, rangecoder, toxicity, urlfilter, vectorcodes
from trailspark.llm.common import remainder, shared_folder, table, written


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: the five highest integer inner products of every fiftieth vector with all others."""
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, q.v as q, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from (select distinct vec_id, v from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id
), ranked as (select *, row_number() over (partition by query_id, q order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: every document's toxicity, learned from the labels of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    learned = toxicity.fit(docs.where(remainder("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, learned)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: the documents that hold benchmark items, one row for each document and item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


#: Operator 4's rules, and the globs that decide where none fits.
URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)
BLOCK_GLOBS = ("*.spam-*", "*-pills.*", "*.*casino*\x00*", "*/admin/*", "*.exe")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: every page's host, path, deciding rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES, BLOCK_GLOBS).drop("url")


OP4_SQL = """
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages
), h as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from p
), rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from h join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select h.page_id, host, path, rule, coalesce(verdict, case when '.' || host || '|' || path like '%.spam-%' or '.' || host || '|' || path like '%-pills.%'
  or '.' || host || '|' || path like '%.%casino%|%' or '.' || host || '|' || path like '%/admin/%' or '.' || host || '|' || path like '%.exe' then 'block' else 'allow' end) as verdict
from h left join fit using (page_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: every document's language, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: every document's log10 probability, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) != 0).alias("train"))
    scored = lm.score(docs, "train", public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", remainder("doc_id", 10) == 0)


def op7_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: every document's ids, written in range-coded segments and read again."""
    path = shared_folder(spark)
    rangecoder.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return rangecoder.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: every document without the multi-line chunks that stand in an earlier place."""
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over whole passages: every document without any run of two or more lines that stands in an earlier place."""
    return linededup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: every document's tokens in windows of 2048; digests of the ids that the pieces hold."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: documents linked at a Jaccard similarity of 85 in 100 on their 4-word shingles, as components."""
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: each source against the other sources of its language and, term by term, against the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: every document's ids and the text that they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: every vector's product code and its squared distance, with the sum over its label."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vectorcodes.fit(vectors)
    if books is None:
        return vectors.limit(0).selectExpr("vec_id", "'' code", "0L error", "0L label_error", "'' codebooks_sha256")
    coded = vectorcodes.with_group_error(written(vectorcodes.encode(vectors, books, keep=["label"])), "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_range_coder": op7_range_coder,
    "op8_line_dedup": op8_line_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_audit": op11_source_audit,
    "op12_tree_bpe": op12_tree_bpe,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op4_url_filter": OP4_SQL,
    "op8_line_dedup": linededup.SQL.format(docs="documents"),
    "op8_passage_dedup": linededup.PASSAGE_SQL.format(docs="documents"),
    "op11_source_audit": divergence.SQL,
    "op13_vector_codes": vectorcodes.sql(),
}
