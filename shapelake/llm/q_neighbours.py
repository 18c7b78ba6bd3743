"""op1: the five nearest embeddings of every fiftieth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.collision_counting import nearest_neighbours


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_collision_counting": op1_collision_counting}
ORACLE_SQL: dict[str, str] = {}
