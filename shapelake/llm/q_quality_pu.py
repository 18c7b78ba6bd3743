"""op11: quality of every document, learnt from positives and unlabelled texts of four folds out of five."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.quality_pu import learn, scored

#: A score from which on a document counts as good.
LEAST_SCORE = 0.3


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op11_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = scored(docs, learn(docs, labels, fold() != 0))
    held_out = F.coalesce(fold() == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


QUERIES = {"op11_positive_unlabelled": op11_positive_unlabelled}
ORACLE_SQL: dict[str, str] = {}
