"""Blurring over tiles, dealt to tasks of a bounded number of pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shapelake.operators import pixels

W, H = 300, 270


def test_blur_deals_pixels_to_tasks_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(pixels, "AT_ONCE", 4096)
    v = (F.col("x") * 31 + F.col("y") * 17 + F.col("x") * F.col("y") % 7) % 256
    raster = spark.range(W * H).select(F.lit(3).cast("long").alias("image_id"), (F.col("id") % W).cast("int").alias("x"), F.floor(F.col("id") / W).cast("int").alias("y"))
    raster = raster.withColumns({"r": v.cast("int"), "g": (v / 2).cast("int"), "b": F.when(F.col("x") != 50, 255 - v).cast("int")}).where("not (x = 280 and y = 20)")
    blurred = pixels.box_blur(raster, 2)
    assert blurred.rdd.getNumPartitions() >= W * H // 4096
    at = np.full((3, H, W), np.nan)
    for row in raster.collect():
        at[:, row.y, row.x] = [np.nan if c is None else c for c in (row.r, row.g, row.b)]
    for _ in range(2):
        last, at = at, np.zeros_like(at)
        at[:, 1:-1, 1:-1] = np.floor(sum(last[:, 1 + a : H - 1 + a, 1 + b : W - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9)
    got = np.full((3, H, W), -1.0)
    for row in blurred.collect():
        got[:, row.y, row.x] = [np.nan if c is None else c for c in (row.r, row.g, row.b)]
    assert (got[:, 20, 280] == -1).all()
    at[:, 20, 280] = -1
    assert np.array_equal(got, at, equal_nan=True)
