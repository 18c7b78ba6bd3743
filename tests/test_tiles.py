"""Filters over tiles: equal to plain versions across the edges of tiles, without windows over whole rasters."""

from __future__ import annotations

import numpy as np
import pytest

from shapelake.operators import masks
from tests.test_cleaning import dilate, erode

W, H = 300, 270


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(5)
    found = {i: rng.random((H, W)) < share for i, share in ((1, 0.5), (2, 0.93))}
    rows = [(i, int(x), int(y)) for i, m in found.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return found, spark.createDataFrame(rows, "image_id long, x int, y int"), spark.createDataFrame([(i, W, H) for i in found], "image_id long, w int, h int")


def _found(df):
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, set()).add((r.x, r.y))
    return out


def _set(m):
    return {(int(x), int(y)) for y, x in zip(*np.nonzero(m), strict=True)}


def test_erosion_and_dilation_across_tiles(spark, given):
    found, mask, dims = given
    for f, plain, radius in ((masks.erode, erode, 1), (masks.dilate, dilate, 2)):
        assert _found(f(mask, dims, radius)) == {i: plain(_set(m), W, H, radius) for i, m in found.items()}


def test_corridor_and_topology_across_tiles(spark, given):
    found, mask, dims = given
    wide, smooth = _found(masks.enforce_corridor(mask, dims, 3)), _found(masks.smooth_topology(mask, dims, 1))
    for i, m in found.items():
        thin = m & masks._grown(~m, 1)
        assert wide.get(i, set()) == _set(m & ~np.any([masks._shifted(thin, *d) for d in masks.FOUR], axis=0))
        inner = np.zeros_like(m)
        inner[1:-1, 1:-1] = True
        assert smooth[i] == _set(masks._smoothed(m, inner))
