"""Clicks of a session to operations of a fixed number of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def click_order():
    return Window.partitionBy("session_id").orderBy("click_seq")


def assemble(clicks: DataFrame, size: int) -> DataFrame:
    """Every ``size`` clicks of a session form one operation: session_id, op_seq, x1, y1, x2, ...; a rest is left out."""
    n = F.row_number().over(click_order()) - 1
    df = clicks.select("session_id", "x", "y", F.floor(n / size).alias("op_seq"), (n % size + 1).alias("step"))
    at = lambda c, k: F.max(F.when(F.col("step") == k, F.col(c))).alias(f"{c}{k}")
    ops = df.groupBy("session_id", "op_seq").agg(F.count("*").alias("_n"), *[at(c, k) for k in range(1, size + 1) for c in ("x", "y")])
    return ops.where(F.col("_n") == size).drop("_n")
