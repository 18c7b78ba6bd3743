"""op2: passages that several documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.substrings import repeated_spans


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that shares a passage: its spans, and how much of them another document keeps."""
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gathered = spans.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"),
        F.sum(F.col("end") - F.col("start")).cast("long").alias("repeated_chars"),
        F.sum("removable").cast("long").alias("removable_chars"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"),
    )
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return gathered.select("doc_id", "n_spans", "repeated_chars", "removable_chars", joined.alias("spans"))


QUERIES = {"op2_gear_chunks": op2_gear_chunks}
ORACLE_SQL: dict[str, str] = {}
