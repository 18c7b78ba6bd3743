"""Masks in sparse form (image_id, x, y: a row is a pixel inside) over dimensions (image_id, w, h)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.plans.rounds import connected_components, discard, sorted_join, written
from shapelake.plans.tiles import TILE, Square, over_tiles, tiled

KEY = ["image_id", "x", "y"]
FAR = 1 << 29


def grid(dims: DataFrame) -> DataFrame:
    df = dims.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return df.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).select("image_id", "x", "y", "w", "h")


def dense(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """Every pixel with inside."""
    return sorted_join(grid(dims)).join(mask.select(*KEY, F.lit(True).alias("inside")), KEY, "left").fillna(False, ["inside"])


def _distance(df: DataFrame, zero: Column) -> DataFrame:
    """Adds d: 4-neighbour distance to the nearest pixel where zero holds, along columns and then along rows.

    Both ways are running minima, one of them in falling order: a frame that
    reaches to the end would be summed up anew for each pixel.
    """
    way = lambda line, order: Window.partitionBy("image_id", line).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(zero, F.col("y"))
    up, down = F.max(at).over(way("x", F.asc("y"))), F.min(at).over(way("x", F.desc("y")))
    df = df.withColumn("_g", F.coalesce(F.least(F.col("y") - up, down - F.col("y")), F.lit(FAR)))
    left = F.min(F.col("_g") - F.col("x")).over(way("y", F.asc("x"))) + F.col("x")
    right = F.min(F.col("_g") + F.col("x")).over(way("y", F.desc("x"))) - F.col("x")
    return df.withColumn("d", F.least(left, right)).drop("_g")


def distance_transform(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """image_id, x, y, inside, d: distance to the nearest pixel outside the mask; the image's edge is not outside."""
    return _distance(dense(mask, dims), ~F.col("inside"))


#: Up to this radius a tile's rim is small beside the tile.
NEAR = 32


def erode(mask: DataFrame, dims: DataFrame, radius: int) -> DataFrame:
    """Pixels farther than the radius from all pixels outside; in one pass over tiles where the radius is small."""
    if radius > NEAR:
        return distance_transform(mask, dims).where(F.col("d") > radius).select(*KEY)
    return over_tiles(mask, dims, radius, lambda m, *_: ~_grown(~m, radius))


def dilate(mask: DataFrame, dims: DataFrame, radius: int) -> DataFrame:
    """Pixels within the radius of the mask; in one pass over tiles where the radius is small."""
    if radius > NEAR:
        return _distance(dense(mask, dims), F.col("inside")).where(F.col("d") <= radius).select(*KEY)
    return over_tiles(mask, dims, radius, lambda m, *_: _grown(m, radius))


def opened(mask: DataFrame, dims: DataFrame, radius: int) -> DataFrame:
    """Eroded and dilated; in one pass over tiles where the radius is small."""
    if radius > NEAR:
        return dilate(erode(mask, dims, radius), dims, radius)
    return over_tiles(mask, dims, 2 * radius, lambda m, *_: _grown(~_grown(~m, radius), radius))


def closed(mask: DataFrame, dims: DataFrame, radius: int) -> DataFrame:
    """Dilated and eroded; in one pass over tiles where the radius is small."""
    if radius > NEAR:
        return erode(dilate(mask, dims, radius), dims, radius)
    return over_tiles(mask, dims, 2 * radius, lambda m, *_: ~_grown(~_grown(m, radius), radius))


def area(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id").agg(F.count("*").alias("area"))


def has_minimum(mask: DataFrame, n: int) -> DataFrame:
    """The masks of images with at least so many pixels."""
    return mask.join(area(mask).where(F.col("area") >= n), "image_id", "left_semi")


def bounds(mask: DataFrame, dims: DataFrame, margin: int = 0) -> DataFrame:
    """image_id, x0, y0, x1, y1 with a margin, inside the image; zeros for an empty mask."""
    box = mask.groupBy("image_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    df = dims.join(box, "image_id", "left")
    low = lambda c: F.coalesce(F.greatest(F.lit(0), F.col(f"lo{c}") - margin), F.lit(0)).cast("int")
    high = lambda c, n: F.coalesce(F.when(F.col(f"hi{c}").isNotNull(), F.least(F.col(n) - 1, F.col(f"hi{c}") + margin)), F.lit(0)).cast("int")
    return df.select("image_id", low("x").alias("x0"), low("y").alias("y0"), high("x", "w").alias("x1"), high("y", "h").alias("y1"))


def crop(mask: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part inside each box in the box's coordinates, and its dimensions."""
    df = mask.join(boxes, "image_id").where("x between x0 and x1 and y between y0 and y1")
    part = df.select("image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"))
    return part, boxes.select("image_id", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


def paste(part: DataFrame, boxes: DataFrame) -> DataFrame:
    df = part.join(boxes, "image_id")
    return df.select("image_id", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"))


def strip_border(mask: DataFrame, dims: DataFrame, n: int = 5) -> DataFrame:
    df = mask.join(dims, "image_id")
    return df.where((F.col("x") >= n) & (F.col("y") >= n) & (F.col("x") < F.col("w") - n) & (F.col("y") < F.col("h") - n)).select(*KEY)


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*KEY)
    for m in masks[1:]:
        out = out.unionByName(m.select(*KEY))
    return out.dropDuplicates(KEY)


def _label(tile: pa.Table) -> pa.Table:
    """A tile's pixels with the first pixel, row by row, of their component inside the tile."""
    x, y = tile["x"].to_numpy(), tile["y"].to_numpy()
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    begins = np.ones(len(x), dtype=bool)
    begins[1:] = (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1)
    first = np.flatnonzero(begins)
    rows, left, right = y[first].tolist(), x[first].tolist(), x[np.append(first[1:], len(x)) - 1].tolist()
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    j = 0
    for i, row in enumerate(rows):
        while j < len(rows) and (rows[j] <= row or (rows[j] == row + 1 and right[j] < left[i])):
            j += 1
        k = j
        while k < len(rows) and rows[k] == row + 1 and left[k] <= right[i]:
            one, other = sorted((find(i), find(k)))
            root[other] = one
            k += 1
    of_run = first[[find(i) for i in range(len(first))]]
    at = of_run[np.cumsum(begins) - 1]
    columns = {"x": x, "y": y, "cy": y[at], "cx": x[at]}
    return pa.table({"image_id": tile["image_id"].take(pa.array(order)), **{k: pa.array(v, tile[k[-1]].type) for k, v in columns.items()}})


def components(mask: DataFrame, size: int = TILE) -> DataFrame:
    """image_id, x, y, cy, cx: 4-connected components, named by their first pixel row by row.

    Tiles of a fixed size are labelled one by one; what meets at the edges of
    tiles is joined in rounds over the tiles' components. An image may have any
    number of tiles, and images of one tile need no rounds.
    """
    kinds = {c: mask.schema[c].dataType.simpleString() for c in KEY}
    tiles = tiled(mask.select(*KEY), 0, size)
    schema = ", ".join(f"{c} {k}" for c, k in {**kinds, "cy": kinds["y"], "cx": kinds["x"]}.items())
    own = written(tiles.groupBy("image_id", "tx", "ty").applyInArrow(_label, schema))
    node = F.struct("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"))
    edges = None
    for c, other in (("x", "y"), ("y", "x")):
        far = own.where(F.pmod(c, F.lit(size)) == size - 1).select("image_id", (F.col(c) + 1).alias(c), other, node.alias("src"))
        near = own.where(F.pmod(c, F.lit(size)) == 0).select("image_id", c, other, node.alias("dst"))
        met = far.join(near, KEY).select("src", "dst")
        edges = met if edges is None else edges.unionAll(met)
    if not edges.limit(1).count():
        return own
    names = connected_components(edges).select(F.col("node.image_id"), F.col("node.y").alias("cy"), F.col("node.x").alias("cx"), "component")
    joined = own.join(names, ["image_id", "cy", "cx"], "left")
    return joined.select(*KEY, F.coalesce("component.y", "cy").alias("cy"), F.coalesce("component.x", "cx").alias("cx"))


def largest_component(mask: DataFrame) -> DataFrame:
    """The largest component of each image, the first of equals."""
    c = components(mask)
    sizes = c.groupBy("image_id", "cy", "cx").agg(F.count("*").alias("n"))
    best = sizes.groupBy("image_id").agg(F.max_by(F.struct("cy", "cx"), F.struct(F.col("n"), -F.col("cy"), -F.col("cx"))).alias("b"))
    return c.join(best.select("image_id", "b.cy", "b.cx"), ["image_id", "cy", "cx"], "left_semi").select(*KEY)


def component_at(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """The components that hold a seed (image_id, x, y)."""
    c = components(mask)
    held = c.join(seeds, KEY, "left_semi").select("image_id", "cy", "cx").distinct()
    return c.join(sorted_join(held), ["image_id", "cy", "cx"], "left_semi").select(*KEY)


def fill_holes(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """Adds what is outside but not reachable from the image's border.

    What lies around the mask's box is reachable, so only the box with a rim of
    one pixel is looked at.
    """
    boxes = bounds(mask, dims, 1).join(sorted_join(mask.select("image_id").distinct()), "image_id", "left_semi")
    cells = boxes.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    outside = components(sorted_join(cells.select(*KEY)).join(mask, KEY, "left_anti")).join(boxes, "image_id")
    rim = (F.col("x") == F.col("x0")) | (F.col("y") == F.col("y0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y1"))
    holes = outside.groupBy("image_id", "cy", "cx").agg(F.max(rim).alias("open")).where("not open")
    return mask.select(*KEY).unionByName(outside.join(sorted_join(holes), ["image_id", "cy", "cx"], "left_semi").select(*KEY))


def enforce_corridor(mask: DataFrame, dims: DataFrame, width: int = 3) -> DataFrame:
    """Removes pixels beside an inside neighbour whose distance is below half the width."""
    least = max(1, (width + 1) // 2)
    if least <= NEAR:
        return over_tiles(mask, dims, least, lambda m, *_: _wide(m, least))
    df = distance_transform(mask, dims)
    thin = F.col("inside") & (F.col("d") < least)
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    df = df.withColumn("thin", thin)
    beside = F.greatest(*[F.coalesce(f("thin").over(w), F.lit(False)) for w in (across, down) for f in (F.lag, F.lead)])
    return df.withColumn("_b", beside).where("inside and not _b").select(*KEY)


def smooth_topology(mask: DataFrame, dims: DataFrame, passes: int = 3) -> DataFrame:
    """Adds one pixel at each diagonal bridge, corner touch and junction, from a copy of the mask, so many times."""

    def change(m: np.ndarray, square: Square, w: int, h: int) -> np.ndarray:
        inner = _inner(m.shape, square, w, h)
        for _ in range(passes):
            m = _smoothed(m, inner)
        return m

    return over_tiles(mask, dims, 2 * passes, change)


def prune_dead_ends(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """Drops pixels with at most one neighbour until none is left; pixels on the image's border stay.

    Tiles are pruned one by one, with the pixels around a tile taken to stay.
    What then still ends somewhere crosses tiles, and ``prune_paths`` takes it.
    """
    return prune_paths(over_tiles(mask, dims, 1, _pruned), dims)


def prune_paths(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """Drops dead ends by whole paths.

    Pixels with two neighbours at most make up paths. A path with a dead end
    goes as a whole, as its pixels would one by one; what it hung on may then
    be the end of a longer path. Every round takes away all such paths, so that
    rounds follow how deep branches fork and not how long they are.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    m = written(mask.select(*KEY))
    while True:
        near = m.withColumn("o", steps).select("image_id", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
        near = near.groupBy(*KEY).agg(F.count("*").alias("c"))
        df = m.join(near, KEY, "left").join(dims, "image_id").withColumn("c", F.coalesce("c", F.lit(0)))
        paths = df.where("c <= 2 and x > 0 and y > 0 and x < w - 1 and y < h - 1").select(*KEY, "c")
        if not paths.where("c <= 1").limit(1).count():
            return m
        ended = paths.where("c <= 1").select("image_id").distinct()
        paths = written(paths.join(sorted_join(ended), "image_id", "left_semi"))
        parts = components(paths)
        dead = parts.join(paths.where("c <= 1"), KEY, "left_semi").select("image_id", "cy", "cx").distinct()
        gone = parts.join(sorted_join(dead), ["image_id", "cy", "cx"], "left_semi")
        last, m = m, written(m.join(sorted_join(gone), KEY, "left_anti"))
        discard(last)
        discard(paths)


def _shifted(m: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """What lies so far from each pixel, false beyond the edge."""
    out, (h, w) = np.zeros_like(m), m.shape
    if h > abs(dy) and w > abs(dx):
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = m[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


FOUR = ((0, -1), (1, 0), (0, 1), (-1, 0))


def _grown(m: np.ndarray, radius: int) -> np.ndarray:
    for _ in range(radius):
        m = m | np.any([_shifted(m, *d) for d in FOUR], axis=0)
    return m


def _wide(m: np.ndarray, least: int) -> np.ndarray:
    """What ``enforce_corridor`` leaves of a mask."""
    thin = m & _grown(~m, least - 1)
    return m & ~np.any([_shifted(thin, *d) for d in FOUR], axis=0)


def _smoothed(m: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """One pass of ``smooth_topology``."""
    (n, e, s, w), corners = (_shifted(m, *d) for d in FOUR), {d: _shifted(m, *d) for d in ((1, -1), (1, 1), (-1, 1), (-1, -1))}
    ne, se, sw, nw = corners.values()
    alone, junction = ~(n | e | s | w), n.astype(int) + e + s + w >= 3
    rules = [(n & e & ~ne, (1, -1)), (e & s & ~se, (1, 1)), (s & w & ~sw, (-1, 1)), (w & n & ~nw, (-1, -1)), (alone & (ne & sw | nw & se), (0, -1))]
    rules += [(junction & ~corners[d], d) for d in ((1, -1), (-1, -1), (1, 1), (-1, 1))]
    out, free = m.copy(), m & inner
    for rule, (dx, dy) in rules:
        out |= _shifted(free & rule, -dx, -dy)
        free = free & ~rule
    return out


def _pruned(m: np.ndarray, square: Square, w: int, h: int) -> np.ndarray:
    """Own pixels without dead ends; the rim stays, as does the image's border."""
    m, free = m.copy(), square.own_only(_inner(m.shape, square, w, h))
    while True:
        ends = m & free & (sum(_shifted(m, *d).astype(np.int8) for d in FOUR) <= 1)
        if not ends.any():
            return m
        m[ends] = False
        if ends.sum() < 64:  # a few long paths are followed one by one
            _follow(m, free, ends)


def _follow(m: np.ndarray, free: np.ndarray, ends: np.ndarray) -> None:
    h, w = m.shape
    stack = [(y + b, x + a) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(ends)), strict=True) for a, b in FOUR]
    while stack:
        y, x = stack.pop()
        if 0 <= y < h and 0 <= x < w and m[y, x] and free[y, x]:
            near = [(y + b, x + a) for a, b in FOUR]
            if sum(0 <= p < h and 0 <= q < w and bool(m[p, q]) for p, q in near) <= 1:
                m[y, x] = False
                stack += near


def _inner(shape: tuple, square: Square, w: int, h: int) -> np.ndarray:
    """True off the image's border."""
    y, x = np.ogrid[square.y0 : square.y0 + shape[0], square.x0 : square.x0 + shape[1]]
    return (x > 0) & (y > 0) & (x < w - 1) & (y < h - 1)


#: Radius of the opening that a shape is cleaned by.
OPENING = 2


def clean_shape(mask: DataFrame, dims: DataFrame, opening: int = OPENING, closing: int = 1, width: int = 3, passes: int = 3) -> DataFrame:
    """Fills holes, opens by 2, closes by 1, enforces the corridor, smooths the topology, prunes dead ends.

    All but the first and the end of the last step look at bounded
    neighbourhoods, so that one pass over tiles with a rim as wide as all of
    them takes the place of one pass for each.
    """
    least = max(1, (width + 1) // 2)
    rim = 2 * opening + 2 * closing + least + 2 * passes + 1

    def change(m: np.ndarray, square: Square, w: int, h: int) -> np.ndarray:
        m = _grown(~_grown(~m, opening), opening)
        m = ~_grown(~_grown(m, closing), closing)
        m = _wide(m, least)
        inner = _inner(m.shape, square, w, h)
        for _ in range(passes):
            m = _smoothed(m, inner)
        return _pruned(m, square, w, h)

    return prune_paths(over_tiles(written(fill_holes(mask, dims)), dims, rim, change), dims)


def clean_each_component(mask: DataFrame, dims: DataFrame, least: int = 20) -> DataFrame:
    """``clean_shape`` of every component by itself, small survivors dropped, united.

    A component takes the place of an image, so all are cleaned together. Of one
    whose box has no room for the disc of the opening nothing would be left: it
    is not looked at.
    """
    parts = written(components(mask).withColumn("owner", F.col("image_id")))
    key = ["owner", "cy", "cx"]
    boxes = parts.groupBy(*key).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = boxes.join(dims.withColumnRenamed("image_id", "owner"), "owner")
    # Beyond the image's edge nothing has to be inside.
    first = lambda c: F.col(f"lo{c}") + F.when(F.col(f"lo{c}") > 0, OPENING).otherwise(0)
    last = lambda c, n: F.col(f"hi{c}") - F.when(F.col(f"hi{c}") < F.col(n) - 1, OPENING).otherwise(0)
    sizes = written(boxes.where((first("x") <= last("x", "w")) & (first("y") <= last("y", "h"))).select(*key, "w", "h"))
    name = F.struct(*key)
    own = parts.join(sorted_join(sizes.select(*key)), key, "left_semi").select(name.alias("image_id"), "x", "y")
    clean = clean_shape(own, sizes.select(name.alias("image_id"), "w", "h"))
    return union(has_minimum(written(clean), least).select(F.col("image_id.owner").alias("image_id"), "x", "y"))


def ensure_min_area(clean: DataFrame, raw: DataFrame, seeds: DataFrame, least: int = 20) -> DataFrame:
    """The clean mask where it is large enough, else the raw mask's component at the seed.

    A region that is still too small is not grown: what growing gives is only
    used to see that it can reach the least size, and the component is what stays.
    """
    fine = has_minimum(clean, least)
    small = raw.join(sorted_join(fine.select("image_id").distinct()), "image_id", "left_anti")
    return fine.unionByName(component_at(small, seeds))


def clean_mask(mask: DataFrame, dims: DataFrame, seeds: DataFrame | None = None, keep_many: bool = False, least: int = 20) -> DataFrame:
    """Border stripped, cropped to its box, cleaned, and put back.

    One region is kept, the largest, and where it is too small the raw one at
    the seed (image_id, x, y); or with ``keep_many`` every part is cleaned by
    itself, and where too little is left of all of them the raw mask stays.
    """
    stripped = written(strip_border(mask, dims))
    boxes = written(bounds(stripped, dims, 4))
    part, sizes = crop(stripped, boxes)
    if keep_many:
        clean = has_minimum(written(clean_each_component(part, sizes, least)), least)
        rest = part.join(sorted_join(clean.select("image_id").distinct()), "image_id", "left_anti")
        return paste(clean.unionByName(rest), boxes)
    moved = seeds.join(boxes, "image_id").select("image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"))
    clean = written(largest_component(clean_shape(part, sizes)))
    return paste(ensure_min_area(clean, part, moved, least), boxes)


def carve(mask: DataFrame, dims: DataFrame, strokes: DataFrame, least: int = 9) -> DataFrame:
    """Takes discs (image_id, cx, cy, radius) away, refills holes, keeps the largest part of at least so many pixels."""
    r = F.col("radius")
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - r).cast("int"), F.ceil(F.col(c) + r).cast("int")))
    disc = strokes.withColumn("x", span("cx")).withColumn("y", span("cy"))
    disc = disc.where((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= r * r).select(*KEY).distinct()
    rest = mask.join(sorted_join(disc), KEY, "left_anti")
    return has_minimum(largest_component(written(fill_holes(rest, dims))), least)


def rasterize(outlines: DataFrame) -> DataFrame:
    """image_id (the outline's), x, y inside by even-odd scanlines through pixel centres."""
    from shapelake.operators.outline_metrics import with_neighbours

    e = with_neighbours(outlines).where("y != ny")
    low, high = F.least("y", "ny"), F.greatest("y", "ny")
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    e = e.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    at = F.col("x") + (F.col("row") + 0.5 - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x"))
    e = e.select("outline_id", "row", at.alias("at"))
    order = Window.partitionBy("outline_id", "row").orderBy("at")
    a, b = F.ceil(F.col("at") - 0.5).cast("int"), F.floor(F.lead("at").over(order) - 0.5).cast("int")
    e = e.withColumns({"a": a, "b": b, "k": F.row_number().over(order)})
    # Spans that touch share a pixel, which the first has: without it no pixel comes twice.
    e = e.withColumn("a", F.greatest("a", F.lag("b", 2).over(order) + 1)).where("k % 2 = 1 and a <= b")
    return e.select(F.col("outline_id").alias("image_id"), F.explode(F.sequence("a", "b")).alias("x"), F.col("row").alias("y"))
