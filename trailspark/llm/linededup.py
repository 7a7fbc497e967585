"""Removal of globally repeated multi-line chunks (operator 8), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import free_name, written

#: Weight of the line before in the rolling hash.
FACTOR = 131


def _lines(text: str) -> str:
    return f"split(coalesce({text}, ''), '\\n', -1)"


def _chunks(docs: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    """Chunks of at least min_lines lines: document key, first and last line (from 1), hash of the chunk.

    The rolling hash of a line covers it and the line before; where it is divisible, a chunk ends. So an inserted
    or deleted line moves no boundary but those next to it.
    """
    hashes = docs.select(
        "_doc", "_text_hash",
        F.explode(F.array(F.expr(f"transform({_lines('text')}, x -> struct(cast(conv(substr(md5(x), 1, 8), 16, 10) as bigint) as h, xxhash64(x) as x))"))).alias("l"),
    )
    ends = hashes.select("*", F.explode(F.array(F.expr(f"filter(sequence(1, size(l)), i -> i = size(l) or (({FACTOR} * if(i > 1, element_at(l, greatest(i - 1, 1)).h, 0) + element_at(l, i).h) % {divisor} = 0))"))).alias("e"))
    each = ends.select("_doc", "_text_hash", F.expr("l.x").alias("x"), F.explode(F.expr("transform(e, (b, k) -> struct(if(k > 0, e[greatest(k - 1, 0)] + 1, 1) as a, b as b))")).alias("c"))
    long = each.where(f"c.b - c.a + 1 >= {min_lines}")
    return long.select("_doc", "_text_hash", F.expr("c.a").alias("a"), F.expr("c.b").alias("b"), F.expr("xxhash64(slice(x, c.a, c.b - c.a + 1))").alias("h"))


def _windows(docs: DataFrame, min_lines: int) -> DataFrame:
    """The min_lines lines from every line on: document key, first and last line (from 1), hash of the lines."""
    hashes = docs.select("_doc", "_text_hash", F.explode(F.array(F.expr(f"transform({_lines('text')}, x -> xxhash64(x))"))).alias("x")).where(f"size(x) >= {min_lines}")
    each = hashes.select("_doc", "_text_hash", F.explode(F.expr(f"transform(sequence(1, size(x) - {min_lines - 1}), i -> struct(i as a, xxhash64(slice(x, i, {min_lines})) as h))")).alias("w"))
    return each.select("_doc", "_text_hash", "w.a", F.expr(f"w.a + {min_lines - 1}").alias("b"), "w.h")


def _keyed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with _doc and _text_hash, which tell texts apart, and the columns that are handed on: name while at work, own name."""
    columns: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() not in ("n_lines", "n_removed"):
            columns[free_name(f"{c}_", docs) if c.lower() in ("_doc", "_text_hash", "_gone", "_l", "_k") else c] = c
    return docs.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()]).withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_text_hash", F.xxhash64("text")), columns


def _repeats(keyed: DataFrame, chunks: DataFrame, order: list[str]) -> DataFrame:
    """Those of chunks (_doc, _text_hash, a, b, h) whose bytes come first, in this order, at a place that they don't overlap."""
    firsts = chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("f")).where("n > 1").select("h", "f")
    met = written(chunks.join(firsts, "h"))

    here = met.select("_doc", "_text_hash", F.struct("a", "b", "h", F.lit(False).alias("first")).alias("c"))
    there = met.select("h", "f").distinct().select(F.col("f._doc").alias("_doc"), F.col("f._text_hash").alias("_text_hash"), F.struct(F.col("f.a").alias("a"), F.col("f.b").alias("b"), "h", F.lit(True).alias("first")).alias("c"))
    asked = here.unionByName(there).groupBy("_doc", "_text_hash").agg(F.collect_set("c").alias("cs"))
    texts = keyed.select("_doc", "_text_hash", "text").join(asked, ["_doc", "_text_hash"]).select("_doc", "_text_hash", "cs", F.explode(F.array(F.expr(_lines("text")))).alias("l"))
    shown = texts.select("_doc", "_text_hash", "l", F.explode("cs").alias("c")).select("_doc", "_text_hash", "c.*", F.expr("array_join(slice(l, c.a, c.b - c.a + 1), '\\n')").alias("t")).distinct()
    shown = written(shown)
    rest = shown.where("not first").alias("r").join(shown.where("first").alias("f"), F.expr("r.h = f.h and r.t = f.t and not (r._doc = f._doc and r._text_hash = f._text_hash and r.a <= f.b)"))
    return rest.select("r._doc", "r._text_hash", "r.a", "r.b")


def _cut(keyed: DataFrame, gone: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns without the lines that _gone lists by first and last, with n_lines and n_removed."""
    cut = keyed.join(gone, ["_doc", "_text_hash"], "left")
    with_lines = cut.select(*[f"`{c}`" for c in columns], "_gone", F.explode(F.array(F.expr(_lines("text")))).alias("_l"))
    n_lines = F.expr("if(text is null, 0, size(_l))")
    kept = with_lines.withColumn("_k", F.expr("if(_gone is null, _l, filter(_l, (x, i) -> not exists(_gone, g -> i + 1 between g.a and g.b)))"))
    out = [F.expr("if(text is null, null, if(_gone is null, text, array_join(_k, '\\n')))").alias("text") if c == "text" else F.col(f"`{name}`").alias(c) for name, c in columns.items()]
    return kept.select(*out, n_lines.alias("n_lines"), F.expr("if(_gone is null, 0, size(_l) - size(_k))").alias("n_removed"))


def dedup(docs: DataFrame, divisor: int = 3, min_lines: int = 2) -> DataFrame:
    """Every row and column of docs with repeated chunks cut out of text, and n_lines and n_removed (lines).

    Lines are what "\\n" separates. A chunk of min_lines or more lines that stands elsewhere with the same bytes is
    kept where it comes first, by doc_id and then by position, and removed everywhere else. Chunks that meet by
    hash are compared byte by byte. Rows with equal doc_id and text are treated alike; a null doc_id comes last; a
    null text stays null with 0 lines; a text may become empty. Columns n_lines and n_removed in docs are replaced.

    Only hashes are shuffled to find repeats; texts move once for the comparison, from documents that have some,
    and once to be cut. Counts per hash have partial sums, and joins on a hot hash can be split.
    """
    keyed, columns = _keyed(docs)
    chunks = written(_chunks(keyed.where("instr(text, '\\n') > 0"), divisor, min_lines))
    gone = _repeats(keyed, chunks, ["_doc", "a", "b", "_text_hash"]).groupBy("_doc", "_text_hash").agg(F.collect_set(F.struct("a", "b")).alias("_gone"))
    return _cut(keyed, gone, columns)


def dedup_passages(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """Every row and column of docs without the lines of repeated passages, and n_lines and n_removed (lines).

    A passage is any run of min_lines or more lines, wherever it starts and ends. It is kept where it comes first, by
    doc_id and then by position; a place that overlaps the first one in the same text isn't a repeat. A run repeats
    exactly where each window of min_lines lines in it does, so windows from every line find all runs at their full
    length, and what chunks find is among it. Of runs that overlap, each line stays at least once, but not always
    beside the same neighbours. Otherwise as in dedup; of rows with one doc_id but different texts, one text as a
    whole comes before the other.
    """
    keyed, columns = _keyed(docs)
    windows = written(_windows(keyed.where("instr(text, '\\n') > 0"), min_lines))
    starts = _repeats(keyed, windows, ["_doc", "_text_hash", "a", "b"]).groupBy("_doc", "_text_hash").agg(F.array_sort(F.collect_set("a")).alias("s"))
    runs = starts.select(
        "_doc", "_text_hash",
        F.expr(f"filter(s, (x, k) -> k = 0 or coalesce(x > get(s, k - 1) + {min_lines}, true))").alias("a"),
        F.expr(f"transform(filter(s, (x, k) -> coalesce(get(s, k + 1) > x + {min_lines}, true)), x -> x + {min_lines - 1})").alias("b"),
    )
    return _cut(keyed, runs.select("_doc", "_text_hash", F.arrays_zip("a", "b").alias("_gone")), columns)


#: The same in DuckDB SQL: chunks are grouped by their text itself. {docs} names a table with doc_id and text.
SQL = """
with lines as (
  select doc_id, text, i, string_split(coalesce(text, ''), chr(10))[i] as x
  from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from {docs})
), hashed as (select *, ('0x' || substr(md5(x), 1, 8))::bigint as h from lines
), ended as (
  select *, i = max(i) over (partition by doc_id) or (131 * coalesce(lag(h) over (partition by doc_id order by i), 0) + h) % 3 = 0 as e from hashed
), numbered as (
  select *, coalesce(sum(e::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as c from ended
), chunks as (select doc_id, c, count(*) as n, min(i) as a, string_agg(x, chr(10) order by i) as t from numbered group by doc_id, c
), firsts as (
  select doc_id, c, n >= 2 and row_number() over (partition by t, n >= 2 order by doc_id, a) > 1 as gone from chunks
), kept as (
  select l.doc_id, any_value(l.text) as old, count(*) as all_lines, count(*) filter (where gone) as n_removed, string_agg(x, chr(10) order by i) filter (where not gone) as new
  from numbered l join firsts f on l.doc_id = f.doc_id and l.c = f.c group by l.doc_id
)
select doc_id, case when old is null then null else coalesce(new, '') end as text,
  (case when old is null then 0 else all_lines end)::int as n_lines, n_removed::int as n_removed
from kept
"""

#: dedup_passages with min_lines = 2 in DuckDB SQL.
PASSAGE_SQL = """
with lines as (
  select doc_id, text, i, string_split(coalesce(text, ''), chr(10))[i] as x
  from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from {docs})
), windows as (select *, x || chr(10) || lead(x) over (partition by doc_id order by i) as t from lines
), placed as (
  select doc_id, i, first_value(doc_id) over w as first_doc, first_value(i) over w as first_i from windows where t is not null window w as (partition by t order by doc_id, i)
), repeats as (select doc_id, i from placed where not (doc_id = first_doc and i <= first_i + 1)
), marked as (
  select l.*, (doc_id, i) in (select (doc_id, i) from repeats union all select (doc_id, i + 1) from repeats) as gone from lines l
), kept as (
  select doc_id, any_value(text) as old, count(*) as all_lines, count(*) filter (where gone) as n_removed, string_agg(x, chr(10) order by i) filter (where not gone) as new
  from marked group by doc_id
)
select doc_id, case when old is null then null else coalesce(new, '') end as text,
  (case when old is null then 0 else all_lines end)::int as n_lines, n_removed::int as n_removed
from kept
"""
