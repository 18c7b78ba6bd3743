"""op12: hard negatives of every fiftieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.hard_negatives import mine, usable


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id move on by one; components become whole 256ths."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.where(usable(F.col("embedding"), F.col("label"), F.col("vec_id")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return mine(rows.select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)


SQL = """
with e as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), a as (select vec_id anchor_id, label, v from e where vec_id % 50 = 0
), s as (
  select anchor_id, e.vec_id, e.label = a.label same, cast(list_inner_product(e.v, a.v) as bigint) score
  from a join e on e.vec_id <> a.anchor_id
), p as (
  select anchor_id, vec_id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) rank,
  vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {"op12_hard_negatives": SQL}
