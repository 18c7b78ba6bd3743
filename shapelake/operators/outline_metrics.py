"""Metrics of closed outlines in long form: outline_id, seq, x, y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.plans.rounds import written


def _by():
    return Window.partitionBy("outline_id").orderBy("seq")


def _all():
    return Window.partitionBy("outline_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def following(c: str) -> Column:
    """The next vertex's value, the first's for the last."""
    return F.coalesce(F.lead(c).over(_by()), F.first(c).over(_all()))


def preceding(c: str) -> Column:
    return F.coalesce(F.lag(c).over(_by()), F.last(c).over(_all()))


def with_neighbours(outlines: DataFrame) -> DataFrame:
    """Adds nx, ny, px, py: the next and the previous vertex, cyclically."""
    return outlines.withColumns({"nx": following("x"), "ny": following("y"), "px": preceding("x"), "py": preceding("y")})


def without_closure(outlines: DataFrame) -> DataFrame:
    """Drops a last vertex that repeats the first (squared gap below 1)."""
    last = F.row_number().over(Window.partitionBy("outline_id").orderBy(F.desc("seq"))) == 1
    gap = (F.col("x") - F.first("x").over(_all())) ** 2 + (F.col("y") - F.first("y").over(_all())) ** 2
    first = F.row_number().over(_by()) == 1
    df = outlines.withColumns({"_drop": last & ~first & (gap < 1.0)})
    return df.where("not _drop").drop("_drop")


def with_closure(outlines: DataFrame) -> DataFrame:
    """Repeats the first vertex at the end where the last is not there already."""
    ends = outlines.groupBy("outline_id").agg(
        F.min_by(F.struct("x", "y"), "seq").alias("f"), F.max_by(F.struct("x", "y"), "seq").alias("l"), F.max("seq").alias("m")
    )
    gap = (F.col("f.x") - F.col("l.x")) ** 2 + (F.col("f.y") - F.col("l.y")) ** 2
    more = ends.where(gap >= 1.0).select("outline_id", (F.col("m") + 1).alias("seq"), "f.x", "f.y")
    return outlines.select("outline_id", "seq", "x", "y").unionByName(more)


def turning_angles(outlines: DataFrame) -> DataFrame:
    """Adds angle: the signed turn at each vertex in degrees, 0 beside an edge shorter than 1e-10."""
    df = with_neighbours(outlines)
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    short = (g.distance("px", "py", "x", "y") < 1e-10) | (g.distance("x", "y", "nx", "ny") < 1e-10)
    return df.withColumn("angle", F.when(short, 0.0).otherwise(g.angle_between(ax, ay, bx, by)))


def perimeter_area(outlines: DataFrame) -> DataFrame:
    """outline_id, n, perimeter, signed_area, area."""
    df = with_neighbours(outlines)
    return (
        df.groupBy("outline_id")
        .agg(
            F.count("*").alias("n"),
            F.sum(g.distance("x", "y", "nx", "ny")).alias("perimeter"),
            (F.sum(g.cross("x", "y", "nx", "ny")) / 2).alias("signed_area"),
        )
        .withColumn("area", F.abs("signed_area"))
    )


def shape_metrics(outlines: DataFrame) -> DataFrame:
    """One row for each outline: lengths and areas, bounding box, ratios and turning angle statistics."""
    df = turning_angles(outlines)
    turn = F.abs("angle")
    m = df.groupBy("outline_id").agg(
        F.count("*").alias("n"),
        F.sum(g.distance("x", "y", "nx", "ny")).alias("perimeter"),
        F.abs(F.sum(g.cross("x", "y", "nx", "ny")) / 2).alias("area"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        g.half_even(F.sum(turn), 4).alias("sum_turning"),
        F.when(F.count("*") < 2, 0.0).otherwise(g.half_even(F.var_pop(turn), 4)).alias("var_turning"),
    )
    return m.withColumns(
        {
            "mean_turning": g.half_even(F.col("sum_turning") / F.col("n"), 4),
            "aspect_ratio": g.guarded_ratio(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), 2),
            "perimeter_area_ratio": g.guarded_ratio("perimeter", "area", 4),
            "circularity": g.circularity("perimeter", "area"),
        }
    )


#: A cell with more edges is cut into SPLITS by SPLITS, LEVELS times at most: edges through one point stay together.
CROWD, SPLITS, LEVELS = 48, 8, 8


def _covered(edges: DataFrame, cells: Column) -> DataFrame:
    """Edges in the cells that they run through, of a grid of so many cells each way over the box bx, by, bw, bh.

    An edge is cut by the columns of the grid, and lists the rows that each
    piece spans; cx and cy count from the whole outline's first cell, ix and iy.
    """
    df = edges.withColumn("m", cells).withColumns({"cw": F.col("bw") / F.col("m"), "ch": F.col("bh") / F.col("m")})
    x0, x1 = F.least("x", "nx"), F.greatest("x", "nx")
    place = lambda v, low, side: F.greatest(F.lit(0), F.least(F.col("m") - 1, F.floor((v - F.col(low)) / F.col(side)))).cast("long")
    df = df.where((x1 >= F.col("bx")) & (x0 <= F.col("bx") + F.col("bw")))
    df = df.withColumn("i", F.explode(F.sequence(place(x0, "bx", "cw"), place(x1, "bx", "cw"))))
    left = F.col("bx") + F.col("i") * F.col("cw")
    at = lambda v: F.col("y") + (v - F.col("x")) / (F.col("nx") - F.col("x")) * (F.col("ny") - F.col("y"))
    ends = [F.when(F.col("nx") == F.col("x"), F.col(c)).otherwise(at(v)) for c, v in (("y", F.greatest(x0, left)), ("ny", F.least(x1, left + F.col("cw"))))]
    room = F.col("ch") * 1e-6
    df = df.withColumns({"lo": F.least(*ends) - room, "hi": F.greatest(*ends) + room})
    df = df.where((F.col("hi") >= F.col("by")) & (F.col("lo") <= F.col("by") + F.col("bh")))
    df = df.withColumn("j", F.explode(F.sequence(place(F.col("lo"), "by", "ch"), place(F.col("hi"), "by", "ch"))))
    return df.select(
        "outline_id", "k", "n", "x", "y", "nx", "ny", (F.col("ix") * F.col("m") + F.col("i")).alias("ix"), (F.col("iy") * F.col("m") + F.col("j")).alias("iy"),
        (F.col("bx") + F.col("i") * F.col("cw")).alias("bx"), (F.col("by") + F.col("j") * F.col("ch")).alias("by"), F.col("cw").alias("bw"), F.col("ch").alias("bh"),
    )


def crossing_candidates(outlines: DataFrame) -> DataFrame:
    """Pairs of edges of an outline that share a cell and are no neighbours: outline_id, k, n, x, y, nx, ny and k2, x2, ...

    The grid has about as many cells as the outline has edges; cells that many
    edges run through are cut again, as often as it takes.
    """
    df = with_neighbours(outlines).withColumn("k", F.row_number().over(_by()) - 1)
    size = Window.partitionBy("outline_id")
    extent = lambda c: F.greatest(F.max(c).over(size) - F.min(c).over(size), F.lit(1e-9))
    df = df.withColumns({
        "n": F.count("*").over(size), "bx": F.min("x").over(size), "by": F.min("y").over(size), "bw": extent("x"), "bh": extent("y"),
        "ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long"),
    })
    cells, key, pairs = written(_covered(df, F.ceil(F.sqrt("n")).cast("long"))), ["outline_id", "ix", "iy"], None
    for level in range(LEVELS + 1):
        crowded = cells.groupBy(*key).agg(F.count("*").alias("edges")).where(F.col("edges") > CROWD) if level < LEVELS else None
        more = crowded is not None and crowded.limit(1).count() > 0
        e = cells.join(crowded, key, "left_anti") if more else cells
        o = e.select(*key, *[F.col(c).alias(f"{c}2") for c in ("k", "x", "y", "nx", "ny")])
        met = e.join(o, key).where("k2 > k + 1 and not (k = 0 and k2 = n - 1)")
        pairs = met if pairs is None else pairs.unionByName(met)
        if not more:
            return pairs
        cells = written(_covered(cells.join(crowded, key, "left_semi"), F.lit(SPLITS).cast("long")))
    return pairs


def self_intersections(outlines: DataFrame) -> DataFrame:
    """outline_id and intersects: whether two edges that are not neighbours cross strictly."""
    pair = crossing_candidates(outlines)
    side = lambda ax, ay, bx, by, px, py: g.cross(F.col(bx) - F.col(ax), F.col(by) - F.col(ay), F.col(px) - F.col(ax), F.col(py) - F.col(ay))
    hit = (side("x", "y", "nx", "ny", "x2", "y2") * side("x", "y", "nx", "ny", "nx2", "ny2") < 0) & (
        side("x2", "y2", "nx2", "ny2", "x", "y") * side("x2", "y2", "nx2", "ny2", "nx", "ny") < 0
    )
    crossing = pair.where(hit).select("outline_id").distinct().withColumn("intersects", F.lit(True))
    return outlines.select("outline_id").distinct().join(crossing, "outline_id", "left").fillna(False, ["intersects"])


def resample(outlines: DataFrame, spacing: float = 4.0, closed: bool = True) -> DataFrame:
    """Vertices at equal arc length, max(3, round(length / spacing)) of them, the first kept; without closure.

    Outlines that are not ``closed`` have no closing duplicate: a last vertex
    beside the first is one of their own.
    """
    df = with_neighbours(without_closure(outlines) if closed else outlines)
    df = df.withColumn("step", g.distance("x", "y", "nx", "ny"))
    df = df.withColumns({
        "at": F.sum("step").over(_by().rowsBetween(Window.unboundedPreceding, 0)) - F.col("step"),
        "total": F.sum("step").over(Window.partitionBy("outline_id")), "k": F.row_number().over(_by()),
        "m": F.count("*").over(Window.partitionBy("outline_id")),
    })
    df = df.withColumn("count", F.greatest(F.lit(3), F.rint(F.col("total") / spacing).cast("int")))
    # Sample i lies on the edge whose arc interval holds i * total / count: each edge lists its own samples.
    per = F.col("total") / F.col("count")
    after = F.when(F.col("k") == 1, 0).otherwise(F.floor(F.col("at") / per) + 1).cast("int")
    upto = F.when(F.col("k") == F.col("m"), F.col("count") - 1).otherwise(F.floor((F.col("at") + F.col("step")) / per)).cast("int")
    df = df.where("total >= 1e-6 and m >= 3").where(after <= upto)
    df = df.withColumn("i", F.explode(F.sequence(after, upto)))
    t = F.when(F.col("step") > 0, (F.col("i") * per - F.col("at")) / F.col("step")).otherwise(0.0)
    return df.select(
        "outline_id", F.col("i").alias("seq"), (F.col("x") + t * (F.col("nx") - F.col("x"))).alias("x"),
        (F.col("y") + t * (F.col("ny") - F.col("y"))).alias("y"),
    )


def smooth(outlines: DataFrame, passes: int, spacing: float = 4.0, closed: bool = True) -> DataFrame:
    """Resampled vertices after so many cyclic 1-2-1 averages, as one convolution with binomial weights."""
    from math import comb

    df = resample(outlines, spacing, closed)
    df = df.withColumn("n", F.count("*").over(Window.partitionBy("outline_id")))
    weights = [(j - passes, comb(2 * passes, j) / 4.0**passes) for j in range(2 * passes + 1)]
    offsets = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w")) for j, w in weights]))
    parts = df.withColumn("o", offsets)
    seq = F.pmod(F.col("seq") + F.col("o.j"), F.col("n")).cast("int")
    return parts.groupBy("outline_id", seq.alias("seq")).agg(
        F.sum(F.col("x") * F.col("o.w")).alias("x"), F.sum(F.col("y") * F.col("o.w")).alias("y")
    )


def nearest_vertex(points: DataFrame, outlines: DataFrame, fan: int = 64) -> DataFrame:
    """point_id, outline_id, seq and distance of the closest vertex to points (point_id, outline_id, px, py), the first of equals.

    Vertices lie in boxes of ``fan`` neighbours, and those in boxes again. From
    the top level down, a point keeps the boxes that are no farther than the
    far side of its nearest one, and opens them. Points without coordinates, or
    whose outline has no vertex, have no row.
    """
    v = outlines.where("x is not null and y is not null")
    v = written(v.select("outline_id", "seq", "x", "y", (F.row_number().over(_by()) - 1).cast("long").alias("idx")))
    most, levels = v.agg(F.max("idx")).first()[0] or 0, []
    nodes = v.select("outline_id", "idx", F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    while most >= fan:
        most //= fan
        up = nodes.groupBy("outline_id", F.floor(F.col("idx") / fan).alias("idx"))
        nodes = written(up.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")))
        levels.append(nodes)
    beyond = lambda p, low, high: F.greatest(low - F.col(p), F.col(p) - high, F.lit(0.0))
    across = lambda p, low, high: F.greatest(F.abs(F.col(p) - low), F.abs(F.col(p) - high))
    reach = lambda o, f: F.sqrt(f("px", o["x0"], o["x1"]) ** 2 + f("py", o["y0"], o["y1"]) ** 2)

    def boxed(table: DataFrame, *columns: str) -> DataFrame:
        """A row a box, with all that lies in it: a point then meets a box in one row, and not in ``fan``."""
        return table.groupBy("outline_id", F.floor(F.col("idx") / fan).alias("up")).agg(F.collect_list(F.struct(*columns)).alias("in"))

    kept = points.where("px is not null and py is not null").select("point_id", "outline_id", "px", "py", F.lit(0).cast("long").alias("up"))
    for level, nodes in enumerate(reversed(levels)):
        opened = kept.join(boxed(nodes, "idx", "x0", "x1", "y0", "y1"), ["outline_id", "up"])
        opened = opened.withColumn("in", F.transform("in", lambda o: F.struct(o["idx"].alias("idx"), reach(o, beyond).alias("near"), reach(o, across).alias("far"))))
        opened = opened.withColumn("least", F.array_min(F.transform("in", lambda o: o["far"])))
        if level:  # below the top level a point may have opened several boxes
            opened = opened.withColumn("least", F.min("least").over(Window.partitionBy("point_id", "outline_id")))
        inside = F.filter("in", lambda o: o["near"] <= F.col("least") * (1 + 1e-12))
        kept = written(opened.select("point_id", "outline_id", "px", "py", F.explode(F.transform(inside, lambda o: o["idx"])).alias("up")))
    away = lambda o: F.struct(g.distance("px", "py", o["x"], o["y"]).alias("d"), o["seq"].alias("seq"))
    found = kept.join(boxed(v, "seq", "x", "y"), ["outline_id", "up"])
    found = found.select("point_id", "outline_id", F.array_min(F.transform("in", away)).alias("best")).groupBy("point_id", "outline_id")
    return found.agg(F.min("best").alias("best")).select("point_id", "outline_id", "best.seq", F.col("best.d").alias("distance"))


def pack(outlines: DataFrame) -> DataFrame:
    """outline_id and points, an array in order."""
    points = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return outlines.groupBy("outline_id").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("outline_id", F.posexplode("points").alias("seq", "p")).select("outline_id", "seq", "p.x", "p.y")
