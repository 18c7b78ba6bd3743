"""op4: each conversation of even number as chosen, the next one as rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.preference import preference_pairs


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = turns.where("conv_id % 2 = 0").select(
        F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id")
    )
    out = preference_pairs(turns, pairs.distinct())
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        *[F.length(c).cast("long").alias(f"{c}_chars") for c in ("prompt", "chosen", "rejected")],
        *[F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")],
        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"),
    )


SQL = r"""
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) n
  from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)
), len as (select conv_id, count(*) k from t group by 1
), pr as (select a.conv_id c, b.conv_id r, a.k ck, b.k rk from len a join len b on b.conv_id = a.conv_id + 1 where a.conv_id % 2 = 0
), diff as (
  select pr.c, min(x.n) n from pr join t x on x.conv_id = pr.c join t y on y.conv_id = pr.r and y.n = x.n
  where x.role is distinct from y.role or x.text is distinct from y.text group by 1
), pre as (select pr.*, coalesce(diff.n - 1, least(ck, rk)) p from pr left join diff using (c)
), rows as (
  select pre.c, pre.r, p, case when t.conv_id = pre.c then 'c' else 'r' end side, t.n, role,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) s,
    length(coalesce(text, '')) + 8 tail
  from pre join t on t.conv_id in (pre.c, pre.r)
), spot as (
  select *, sum(length(s)) over (partition by c, side, n > p order by n) ends from rows
), txt as (
  select c, r, p,
    coalesce(string_agg(s, '' order by n) filter (side = 'c' and n <= p), '') prompt,
    coalesce(string_agg(s, '' order by n) filter (side = 'c' and n > p), '') chosen,
    coalesce(string_agg(s, '' order by n) filter (side = 'r' and n > p), '') rejected,
    coalesce(string_agg((ends - tail)::bigint || ':' || ends::bigint, ',' order by n) filter (side = 'c' and n > p and role = 'assistant'), '') chosen_mask,
    coalesce(string_agg((ends - tail)::bigint || ':' || ends::bigint, ',' order by n) filter (side = 'r' and n > p and role = 'assistant'), '') rejected_mask
  from spot group by all
)
select c pair_id, c chosen_id, r rejected_id, cast(p as bigint) n_prompt_turns, cast(length(prompt) as bigint) prompt_chars,
  cast(length(chosen) as bigint) chosen_chars, cast(length(rejected) as bigint) rejected_chars, md5(prompt) prompt_md5,
  md5(chosen) chosen_md5, md5(rejected) rejected_md5, chosen_mask, rejected_mask
from txt"""

QUERIES = {"op4_preference": op4_preference}
ORACLE_SQL = {"op4_preference": SQL}
