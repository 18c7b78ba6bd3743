"""op7: all documents packed into sequences of at most 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shapelake.llm.packing import pack


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_cost_packing": op7_cost_packing}
ORACLE_SQL: dict[str, str] = {}
