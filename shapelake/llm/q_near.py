"""op6: near-duplicate documents on 2-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapelake.llm.chosen_path import JoinParameters, near_duplicates


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, JoinParameters(shingle=2))


QUERIES = {"op6_chosen_path": op6_chosen_path}
ORACLE_SQL: dict[str, str] = {}
