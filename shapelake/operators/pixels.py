"""Raster tables in long form: image_id, x, y, r, g, b (channels 0 to 255)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.plans.rounds import sorted_join, written
from shapelake.plans.tiles import KEY, TILE, TILE_KEY, Square, repeated, tiled

CHANNELS = ("r", "g", "b")
#: Pixels that a task sorts at once.
AT_ONCE = 1 << 20


def dimensions(pixels: DataFrame) -> DataFrame:
    """image_id, w, h of full rasters."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))


def adjust(pixels: DataFrame, contrast: float = 0.0, brightness: float = 0.0, saturation: float = 0.0) -> DataFrame:
    """Blends towards luminance, adds brightness, scales around one half, clamps and truncates; inputs from -1 to 1."""
    r, gr, b = (F.col(c) / 255.0 for c in CHANNELS)
    lum = 0.299 * r + 0.587 * gr + 0.114 * b

    def channel(v: Column) -> Column:
        v = lum + (v - lum) * (1.0 + saturation) + brightness
        v = (v - 0.5) * (1.0 + contrast) + 0.5
        return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")

    return pixels.withColumns({c: channel(v) for c, v in zip(CHANNELS, (r, gr, b), strict=True)})


def downsample(pixels: DataFrame, target: int) -> DataFrame:
    """Nearest neighbour to about so many pixels an image; images that are not larger stay as they are."""
    d = dimensions(pixels).withColumn("n", F.col("w").cast("long") * F.col("h"))
    scale = F.sqrt(F.lit(float(target)) / F.col("n"))
    new = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))
    shrinks = (F.lit(target) > 0) & (F.lit(target) < F.col("n"))
    d = d.withColumns({"nw": F.when(shrinks, new("w")).otherwise(F.col("w")), "nh": F.when(shrinks, new("h")).otherwise(F.col("h"))})
    src = lambda i, n, o: F.least(F.floor(F.col(i).cast("double") / F.col(n) * F.col(o)), F.col(o) - 1).cast("int")
    grid = d.withColumn("dx", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)))
    grid = grid.withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    grid = grid.select("image_id", "dx", "dy", src("dx", "nw", "w").alias("x"), src("dy", "nh", "h").alias("y"))
    return sorted_join(grid).join(pixels, ["image_id", "x", "y"]).select("image_id", F.col("dx").alias("x"), F.col("dy").alias("y"), *CHANNELS)


def corner_patch(side: Column) -> Column:
    return F.greatest(F.lit(4), F.least(F.lit(20), F.floor(side / 10))).cast("int")


def corner_colors(pixels: DataFrame) -> DataFrame:
    """Mean colour of four inset corner patches: image_id, corner (0 to 3, row by row), r, g, b."""
    df = pixels.join(dimensions(pixels), "image_id").withColumn("side", F.least("w", "h"))
    df = df.withColumns({"patch": corner_patch(F.col("side")), "inset": F.least(F.lit(5), F.floor(F.col("side") / 20)).cast("int")})
    low = lambda c: F.col(c).between(F.col("inset"), F.col("inset") + F.col("patch") - 1)
    high = lambda c, n: F.col(c).between(F.col(n) - F.col("patch") - F.col("inset"), F.col(n) - 1 - F.col("inset"))
    rules = [low("x") & low("y"), high("x", "w") & low("y"), low("x") & high("y", "h"), high("x", "w") & high("y", "h")]
    found = F.filter(F.array(*[F.when(r, F.lit(i)) for i, r in enumerate(rules)]), lambda v: v.isNotNull())
    df = df.withColumn("corner", F.explode(found))
    return df.groupBy("image_id", "corner").agg(*[F.avg(c).alias(c) for c in CHANNELS])


def adaptive_threshold(corners: DataFrame) -> DataFrame:
    """image_id, threshold: from 35 for even corners to 60."""
    every = Window.partitionBy("image_id")
    df = corners.withColumns({f"m{c}": F.sum(c).over(every) / 4 for c in CHANNELS})
    d = g.perceptual_distance("r", "g", "b", "mr", "mg", "mb")
    return df.groupBy("image_id").agg(F.greatest(F.lit(35.0), F.least(F.lit(60.0), 35 + 0.8 * F.max(d))).alias("threshold"))


def seed_color(pixels: DataFrame, seeds: DataFrame, background: DataFrame | None = None, radius: int = 2) -> DataFrame:
    """image_id, sx, sy, sr, sg, sb: integer mean around each seed without background, or the seed's own pixel."""
    free = pixels if background is None else pixels.join(sorted_join(background), ["image_id", "x", "y"], "left_anti")
    offsets = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    square = seeds.withColumn("dx", offsets).withColumn("dy", offsets)
    square = square.select("image_id", "sx", "sy", (F.col("sx") + F.col("dx")).alias("x"), (F.col("sy") + F.col("dy")).alias("y"))
    mean = sorted_join(square).join(free, ["image_id", "x", "y"]).groupBy("image_id", "sx", "sy").agg(
        *[F.floor(F.sum(c) / F.count("*")).cast("int").alias(f"s{c}") for c in CHANNELS]
    )
    own = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *CHANNELS)
    df = seeds.join(own, ["image_id", "sx", "sy"]).join(mean, ["image_id", "sx", "sy"], "left")
    return df.select("image_id", "sx", "sy", *[F.coalesce(f"s{c}", F.col(c).cast("int")).alias(f"s{c}") for c in CHANNELS])


def _neighbourhood(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Adds c_dx_dy for the eight neighbours; null outside. Two windows with one partitioning each."""
    across = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    df = pixels.withColumns({f"{c}_{n}": f(c).over(across) for c in columns for n, f in (("m", F.lag), ("p", F.lead))})
    rows = {f"{c}": c for c in columns} | {f"{c}_{n}": f"{c}_{n}" for c in columns for n in "mp"}
    return df.withColumns({f"{k}_{n}": f(v).over(down) for k, v in rows.items() for n, f in (("u", F.lag), ("d", F.lead))})


def box_blur(pixels: DataFrame, passes: int = 1) -> DataFrame:
    """3 by 3 means in whole numbers; border pixels become 0, and those beside a missing pixel null.

    All passes are one over tiles with a rim as wide as their number. Tiles are
    dealt so that a task sorts about ``AT_ONCE`` pixels, however many there are.
    """
    if passes < 1:
        return pixels
    dims = written(dimensions(pixels))
    area = dims.agg(F.sum(F.col("w").cast("long") * F.col("h"))).first()[0] or 0
    kind = {f.name: f.dataType.simpleString() for f in pixels.schema}

    def run(tile: pa.Table, size: pa.Table) -> pa.Table:
        if not tile.num_rows or not size.num_rows:  # a tile beyond the image's edge, or one without pixels
            return pa.schema([*[tile.schema.field(c) for c in KEY], *[(c, pa.int32()) for c in CHANNELS]]).empty_table()
        tx, ty, w, h = (size[c][0].as_py() for c in ("tx", "ty", "w", "h"))
        square = Square(tx, ty, passes, TILE, w, h)
        known = square.put(square.empty(), tile)
        px, py = np.arange(square.x0, square.x0 + known.shape[1]), np.arange(square.y0, square.y0 + known.shape[0])[:, None]
        border = (px == 0) | (py == 0) | (px == w - 1) | (py == h - 1)
        x, y = square.places(square.own_only(known))
        out = {"image_id": repeated(tile["image_id"].combine_chunks(), len(x)), "x": pa.array(x, tile["x"].type), "y": pa.array(y, tile["y"].type)}
        at = y - square.y0, x - square.x0
        for c in CHANNELS:
            given = tile[c].combine_chunks()
            v = square.put(square.empty(float), tile, given.fill_null(0).to_numpy(zero_copy_only=False))
            there = square.put(square.empty(), tile, given.is_valid().to_numpy(zero_copy_only=False))
            for _ in range(passes):
                v, there = np.where(border, 0.0, np.floor(_around(v) / 9)), border | (_around(there.astype(float)) == 9)
            out[c] = pa.array(v[at].astype(np.int32), pa.int32(), mask=~there[at])
        return pa.table(out)

    tasks = max(pixels.sparkSession.sparkContext.defaultParallelism, -(-area // AT_ONCE))
    tiles = tiled(pixels.select(*KEY, *CHANNELS), passes).repartition(tasks, *TILE_KEY)
    across = [F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / TILE))) for n in ("w", "h")]
    sizes = dims.withColumn("tx", across[0]).withColumn("ty", across[1]).repartition(tasks, *TILE_KEY)
    schema = ", ".join(f"{c} {kind[c]}" for c in KEY) + "".join(f", {c} int" for c in CHANNELS)
    return tiles.groupBy(*TILE_KEY).cogroup(sizes.groupBy(*TILE_KEY)).applyInArrow(run, schema)


def _around(v: np.ndarray) -> np.ndarray:
    """Sums of 3 by 3 values; what lies beyond the edge counts 0."""
    p = np.pad(v, 1)
    p = p[:-2] + p[1:-1] + p[2:]
    return p[:, :-2] + p[:, 1:-1] + p[:, 2:]


def sobel_gradient(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, gradient: squared Sobel response of 2 R + 4 G + 3 B, 0 on the border."""
    df = pixels.select("image_id", "x", "y", (2 * F.col("r") + 4 * F.col("g") + 3 * F.col("b")).cast("long").alias("v"))
    df = _neighbourhood(df, ["v"])
    c = F.col
    gx = c("v_p_u") - c("v_m_u") + 2 * (c("v_p") - c("v_m")) + c("v_p_d") - c("v_m_d")
    gy = c("v_m_d") - c("v_m_u") + 2 * (c("v_d") - c("v_u")) + c("v_p_d") - c("v_p_u")
    return df.select("image_id", "x", "y", F.coalesce(gx * gx + gy * gy, F.lit(0)).alias("gradient"))


def image_to_pixel(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Canvas points (image_id, x, y) to pixels inside their image, by offset and scale."""
    df = points.join(transforms, "image_id")
    df = df.withColumns({c: ((F.col(c) - F.col(f"offset_{c}")) / F.col("scale")).cast("int") for c in "xy"})
    return df.where("x >= 0 and y >= 0 and x < w and y < h").select("image_id", "x", "y")
