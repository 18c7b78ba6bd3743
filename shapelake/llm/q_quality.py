"""op9: line-first cleaning of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapelake.llm import line_quality as lq


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lq.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lost_words",
    )


def _sql() -> str:
    r = lq.LineRules()
    found = lambda s, x: f"((length({s}) - length(replace({s}, '{x}', ''))) / {len(x)}.0)"
    separators = " + ".join(found("l", x) for x in lq.SEPARATORS)
    furniture = " or ".join(f"contains(lower(l), '{x}')" for x in lq.BOILERPLATE)
    return rf"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{lq.WORD}') w from documents
), p as (
  select doc_id, unnest(range(len(w) - 2)) i, w from d where len(w) >= 3
), g as (
  select doc_id, i, count(*) over (partition by doc_id, w[i+1], w[i+2], w[i+3]) n from p
), s as (
  select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from g where n > 1
), rep as (
  select doc_id, sum(least(3, coalesce(nxt - i, 3))) n_repeat_words from s group by 1
), x as (
  select doc_id, unnest(string_split(t, chr(10))) l from d
), y as (
  select doc_id, l, {found("l", " ")} + 1 p, len(regexp_extract_all(l, '{lq.WORD}')) n from x
), z as (
  select *, n > 0 and ({found("l", "!")} > {r.max_shout_share} * p
    or len(regexp_extract_all(l, '{lq.SYMBOL}')) > {r.max_symbol_share} * p
    or {separators} > {r.max_separator_share} * p
    or (p >= {r.min_unmarked_pieces} and not regexp_matches(l, '{lq.SENTENCE_MARK}'))
    or {furniture}) bad from y
), a as (
  select doc_id, count(*) filter (n > 0) - count(distinct l) filter (n > 0) n_dup_lines,
    coalesce(sum(n) filter (bad), 0) n_lost_words from z group by 1
), b as (
  select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(len(regexp_extract_all(t, '{lq.SYMBOL}')) as bigint) n_symbols, cast(a.n_dup_lines as bigint) n_dup_lines,
    cast(coalesce(rep.n_repeat_words, 0) as bigint) n_repeat_words, cast(a.n_lost_words as bigint) n_lost_words
  from d join a using (doc_id) left join rep using (doc_id)
)
select *, n_words < {r.min_words} or n_repeat_words > {r.max_repeat_share} * n_words base_failed,
  not (n_words < {r.min_words} or n_repeat_words > {r.max_repeat_share} * n_words)
    and n_lost_words <= {r.max_lost_share} * n_words kept
from b"""


QUERIES = {"op9_line_quality": op9_line_quality}
ORACLE_SQL = {"op9_line_quality": _sql()}
