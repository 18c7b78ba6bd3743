"""Pixel tables in tiles: squares of a fixed size with a rim of the pixels around them.

A tile is the unit of work, so that an image may be of any size and a task
holds a few tiles. What depends on a bounded neighbourhood takes one pass with
a rim that wide; what spreads further takes rounds, in each of which only the
tiles that something has entered are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.plans.rounds import written

TILE = 256
KEY = ["image_id", "x", "y"]
TILE_KEY = ["image_id", "tx", "ty"]


def tiled(pixels: DataFrame, rim: int = 0, size: int = TILE) -> DataFrame:
    """Adds tx and ty: every pixel once for its own tile and once for each whose rim it lies in."""
    for c in "xy":
        tile = lambda d, c=c: F.floor((F.col(c) + d) / size)
        own = tile(0) if not rim else F.explode(F.sequence(F.greatest(tile(-rim), F.lit(0)), tile(rim)))
        pixels = pixels.withColumn(f"t{c}", own)
    return pixels


class Square:
    """The part of an image that a tile and its rim cover, cut at the image's edges where they are known."""

    def __init__(self, tx: int, ty: int, rim: int, size: int, w: int | None = None, h: int | None = None):
        self.x0, self.y0 = max(0, tx * size - rim), max(0, ty * size - rim)
        self.x1, self.y1 = (((t + 1) * size + rim) for t in (tx, ty))
        self.x1, self.y1 = (b if n is None else min(b, n) for b, n in ((self.x1, w), (self.y1, h)))
        self.own = slice(ty * size - self.y0, (ty + 1) * size - self.y0), slice(tx * size - self.x0, (tx + 1) * size - self.x0)

    def empty(self, kind=bool) -> np.ndarray:
        return np.zeros((max(0, self.y1 - self.y0), max(0, self.x1 - self.x0)), dtype=kind)

    def put(self, out: np.ndarray, table: pa.Table, values=True) -> np.ndarray:
        out[table["y"].to_numpy() - self.y0, table["x"].to_numpy() - self.x0] = values
        return out

    def places(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, x = np.nonzero(mask)
        return x + self.x0, y + self.y0

    def own_only(self, mask: np.ndarray) -> np.ndarray:
        out = np.zeros_like(mask)
        out[self.own] = mask[self.own]
        return out


def repeated(value: pa.Array, n: int) -> pa.Array:
    """A column of one value."""
    return value.take(pa.array(np.zeros(n, dtype=np.int64)))


def over_tiles(mask: DataFrame, dims: DataFrame, rim: int, change: Callable[[np.ndarray, Square, int, int], np.ndarray], size: int = TILE) -> DataFrame:
    """A mask after ``change``, which gets a tile's pixels with the rim and must depend on no others."""
    kind = {f.name: f.dataType.simpleString() for f in mask.schema}

    def run(tile: pa.Table) -> pa.Table:
        tx, ty, w, h = (tile[c][0].as_py() for c in ("tx", "ty", "w", "h"))
        square = Square(tx, ty, rim, size, w, h)
        x, y = square.places(square.own_only(change(square.put(square.empty(), tile), square, w, h)))
        return pa.table({"image_id": repeated(tile["image_id"].combine_chunks(), len(x)), "x": pa.array(x, tile["x"].type), "y": pa.array(y, tile["y"].type)})

    df = tiled(mask.select(*KEY), rim, size).join(dims.select("image_id", "w", "h"), "image_id")
    return df.groupBy(*TILE_KEY).applyInArrow(run, ", ".join(f"{c} {kind[c]}" for c in KEY))


Rule = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def spread(pixels: DataFrame, columns: list[str], seeds: DataFrame, rule: Rule, size: int = TILE) -> DataFrame:
    """Pixels (image_id, x, y) reached from the seeds by steps to 4-neighbours that ``rule`` allows, seeds included.

    ``rule`` gets the columns of the pixels that are left and of those that are
    entered. Every round fills the tiles that were entered and tells which
    pixels beyond their edges are reached; it takes as many rounds as a way
    crosses edges, and none but the first for images of one tile.
    """
    kind = {f.name: f.dataType.simpleString() for f in pixels.schema}

    def fill(tile: pa.Table, entered: pa.Table) -> pa.Table:
        schema = pa.schema([("image_id", entered["image_id"].type), ("x", entered["x"].type), ("y", entered["y"].type), ("own", pa.bool_())])
        if not entered.num_rows or not tile.num_rows:
            return schema.empty_table()
        square = Square(tile["tx"][0].as_py(), tile["ty"][0].as_py(), 1, size)
        y0, x0 = tile["y"].to_numpy().min(), tile["x"].to_numpy().min()
        square.y1, square.x1 = int(tile["y"].to_numpy().max()) + 1, int(tile["x"].to_numpy().max()) + 1
        assert y0 >= square.y0 and x0 >= square.x0
        there = square.put(square.empty(), tile)
        values = {c: square.put(square.empty(tile[c].to_numpy().dtype), tile, tile[c].to_numpy()) for c in columns}
        height, width = there.shape
        padded = np.zeros((height, width), dtype=bool)
        old, new = entered["old"].to_numpy().astype(bool), entered
        seen = square.put(square.empty(), new.filter(pa.array(old)))
        start = square.put(square.empty(), new.filter(pa.array(~old)))
        steps = []
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            out_of = slice(max(0, -dy), height - max(0, dy)), slice(max(0, -dx), width - max(0, dx))
            into = slice(max(0, dy), height - max(0, -dy)), slice(max(0, dx), width - max(0, -dx))
            allowed = padded.copy()
            left, right = ({c: v[s] for c, v in values.items()} for s in (out_of, into))
            allowed[out_of] = there[out_of] & there[into] & rule(left, right)
            steps.append((dy * width + dx, allowed.ravel().tobytes()))
        own = square.own_only(np.ones_like(there)).ravel().tobytes()
        reached, stack = bytearray((seen | start).ravel().tobytes()), np.flatnonzero(start).tolist()
        while stack:
            at = stack.pop()
            for step, allowed in steps:
                if allowed[at] and not reached[at + step]:
                    reached[at + step] = 1
                    if own[at + step]:
                        stack.append(at + step)
        fresh = np.frombuffer(bytes(reached), dtype=bool).reshape(there.shape) & ~seen
        x, y = square.places(fresh)
        inside = square.own_only(fresh)[fresh]
        return pa.table({"image_id": repeated(entered["image_id"].combine_chunks(), len(x)), "x": pa.array(x, schema.field("x").type), "y": pa.array(y, schema.field("y").type), "own": pa.array(inside)})

    tiles = written(tiled(pixels.select(*KEY, *columns), 1, size))
    front = seeds.select(*[F.col(c).cast(kind[c]).alias(c) for c in KEY]).distinct()
    reached = front  # seeds that lie on no pixel belong to the result as well
    known = front.limit(0)
    schema = ", ".join(f"{c} {kind[c]}" for c in KEY) + ", own boolean"
    while True:
        entered = tiled(front, 0, size)
        here = entered.select(*TILE_KEY).distinct()
        old = tiled(known, 0, size).join(here, TILE_KEY, "left_semi").withColumn("old", F.lit(True))
        entered = entered.withColumn("old", F.lit(False)).unionByName(old)
        looked = tiles.join(here, TILE_KEY, "left_semi")
        found = written(looked.groupBy(*TILE_KEY).cogroup(entered.groupBy(*TILE_KEY)).applyInArrow(fill, schema))
        reached = reached.unionByName(found.where("own").select(*KEY)).distinct()
        if not found.where("not own").limit(1).count():
            return reached
        reached = known = written(reached)
        front = written(found.where("not own").select(*KEY).distinct().join(known, KEY, "left_anti"))
        if not front.limit(1).count():
            return reached
        reached = known.unionByName(front)
