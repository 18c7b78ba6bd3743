"""Joins of pixel tables: none of them may put a table of pixels into the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapelake.operators import masks, pixels
from shapelake.plans.rounds import written

KEY = ["image_id", "x", "y"]


def _pixels(spark, images):
    at = spark.range(images * 1024).select(F.floor(F.col("id") / 1024).alias("image_id"), (F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") / 32 % 32).cast("int").alias("y"))
    return at.withColumns({c: (F.col("x") * 7 % 11).cast("int") for c in "rgb"})


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_written_table_of_many_rows_is_not_broadcast(spark):
    # 400 images take 0.1 MB as a file and 50 MB as a broadcast.
    many, few = (written(_pixels(spark, n).select(*KEY)) for n in (400, 4))
    other = _pixels(spark, 410)
    assert "BroadcastExchange" not in _plan(other.join(many, KEY, "left_anti").groupBy().count())
    assert "BroadcastExchange" in _plan(other.join(few, KEY, "left_anti").groupBy().count())
    assert other.join(many, KEY, "left_anti").count() == 10 * 1024


def test_rows_made_by_an_explode_are_not_broadcast(spark):
    raster = written(_pixels(spark, 20))
    small = pixels.downsample(raster, 300)
    assert "BroadcastExchange" not in _plan(small.groupBy().count())
    assert small.count() == 20 * 17 * 17
    dense = masks.dense(raster.where("r < 5").select(*KEY), pixels.dimensions(raster))
    assert "BroadcastExchange" not in _plan(dense.groupBy().count())
    assert dense.count() == 20 * 1024


def test_keys_made_of_several_columns_count_in_full(spark):
    # As many pixels of components take 3 MB when each column counts 8 bytes, and some 30 MB as a broadcast.
    own = written(_pixels(spark, 100).select(F.struct("image_id", "x", "y").alias("image_id"), "x", "y"))
    other = _pixels(spark, 110).select(F.struct("image_id", "x", "y").alias("image_id"), "x", "y")
    assert "BroadcastExchange" not in _plan(other.join(own, KEY, "left_anti").groupBy().count())
    assert other.join(own, KEY, "left_anti").count() == 10 * 1024
