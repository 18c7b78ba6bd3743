"""From masks to closed outlines: boundary tracing by list ranking, hulls, and the finished outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.operators import outline_metrics as om
from shapelake.operators.splines import simplify
from shapelake.plans.rounds import until_stable, written


def trace_boundary(mask: DataFrame) -> DataFrame:
    """outline_id (the image's), seq, x, y: corners of the loop around the topmost-leftmost pixel's component.

    Every side between a pixel inside and one outside is a directed edge;
    edges are joined head to tail, at a pinch by the most clockwise turn. An
    edge's place in its loop comes from pointer doubling, in logarithmic rounds.
    """
    key = ["image_id", "x", "y"]
    sides = (("n", 0, -1, (0, 0), (1, 0)), ("e", 1, 0, (1, 0), (1, 1)), ("s", 0, 1, (1, 1), (0, 1)), ("w", -1, 0, (0, 1), (0, 0)))
    each = F.explode(F.array(*[
        F.struct(F.lit(d).alias("d"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(p[0]).alias("px"), F.lit(p[1]).alias("py"),
                 F.lit(q[0]).alias("qx"), F.lit(q[1]).alias("qy")) for d, a, b, p, q in sides
    ]))
    df = mask.select(*key).withColumn("s", each)
    beyond = mask.select("image_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    df = df.withColumns({"bx": F.col("x") + F.col("s.dx"), "by": F.col("y") + F.col("s.dy")})
    df = df.join(beyond, ["image_id", "bx", "by"], "left_anti")
    e = df.select(
        "image_id", F.struct("y", "x", "s.d").alias("id"), (F.col("x") + F.col("s.px")).alias("ax"), (F.col("y") + F.col("s.py")).alias("ay"),
        (F.col("x") + F.col("s.qx")).alias("bx"), (F.col("y") + F.col("s.qy")).alias("by"),
    )
    e = written(e)
    nxt = e.select("image_id", F.col("id").alias("next"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    j = e.join(nxt, ["image_id", "bx", "by"])
    u = (F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    v = (F.col("cx") - F.col("bx"), F.col("cy") - F.col("by"))
    clockwise = -F.atan2(g.cross(*u, *v).cast("double"), g.dot(*u, *v).cast("double"))
    link = j.groupBy("image_id", "id").agg(F.max_by("next", F.struct(clockwise, "next")).alias("next"))
    first = mask.groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("f"))
    first = first.select("image_id", F.struct("f.y", "f.x", F.lit("n").alias("d")).alias("start"))
    df = e.join(link, ["image_id", "id"]).join(first, "image_id")
    # Distance to the edge that closes the loop at the start; edges of other loops never get there.
    ends = F.col("next") == F.col("start")
    rank = df.select("image_id", "id", F.when(~ends, F.col("next")).alias("to"), F.lit(1).cast("long").alias("n"), ends.alias("home"))
    rank = written(rank)

    def double(r: DataFrame) -> DataFrame:
        ahead = r.select("image_id", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("home").alias("home2"))
        r = r.join(ahead, ["image_id", "to"], "left")
        return r.select(
            "image_id", "id", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
            (F.col("home") | F.coalesce("home2", F.lit(False))).alias("home"),
        )

    # Loops away from the start circle for ever: only edges that get home are counted.
    rank = until_stable(rank, double, lambda r: r.where("home and to is null").count())
    loop = e.join(rank.where("home").select("image_id", "id", "n"), ["image_id", "id"])
    seq = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"))) - 1
    loop = loop.join(first, "image_id")
    # The start edge is the farthest from home.
    return loop.select(F.col("image_id").alias("outline_id"), seq.alias("seq"), F.col("ax").cast("double").alias("x"), F.col("ay").cast("double").alias("y"))


def build_outline(mask: DataFrame, eps: float = 1.5) -> DataFrame:
    """Traced, simplified and closed outlines; the dense loop where the simple one crosses itself.

    Loops of fewer than 8 points and outlines of fewer than 3 are left out.
    """
    dense = trace_boundary(mask)
    n = F.count("*").over(Window.partitionBy("outline_id"))
    dense = written(dense.withColumn("_n", n).where("_n >= 8").drop("_n"))
    simple = simplify(dense.withColumnRenamed("outline_id", "line_id"), eps).withColumnRenamed("line_id", "outline_id")
    simple = written(simple.withColumn("_n", n).where("_n >= 3").drop("_n"))
    crossed = om.self_intersections(simple).where("intersects").select("outline_id")
    out = simple.join(crossed, "outline_id", "left_anti").unionByName(dense.join(crossed, "outline_id", "left_semi"))
    return om.with_closure(out)


def convex_hull(points: DataFrame) -> DataFrame:
    """outline_id, seq, x, y of each point set's hull, counter-clockwise from its lowest point; collinear points dropped.

    All sides of all hulls grow at once: in a round, each takes the farthest
    point outside it, and keeps the points outside its two new sides.
    """
    p = points.select("outline_id", "x", "y").distinct()
    ends = p.groupBy("outline_id").agg(F.count("*").alias("n"), F.min(F.struct("x", "y")).alias("l"), F.max(F.struct("x", "y")).alias("r"))
    ends = written(ends.where("n >= 3"))
    side = lambda a, b: g.cross(F.col(f"{b}.x") - F.col(f"{a}.x"), F.col(f"{b}.y") - F.col(f"{a}.y"), F.col("x") - F.col(f"{a}.x"), F.col("y") - F.col(f"{a}.y"))
    both = F.explode(F.array(F.struct(F.col("l").alias("a"), F.col("r").alias("b")), F.struct(F.col("r").alias("a"), F.col("l").alias("b"))))
    open_ = p.join(ends, "outline_id").withColumn("s", both)
    open_ = open_.select("outline_id", "x", "y", "s.a", "s.b").withColumn("d", side("b", "a")).where("d > 0")
    open_ = written(open_)
    hull = ends.select("outline_id", F.explode(F.array("l", "r")).alias("v"))
    while open_.limit(1).count():
        apex = open_.groupBy("outline_id", "a", "b").agg(F.max_by(F.struct("x", "y"), F.struct("d", "x", "y")).alias("c"))
        apex = written(apex)
        hull = hull.unionAll(apex.select("outline_id", F.col("c").alias("v")))
        halves = F.explode(F.array(F.struct("a", F.col("c").alias("b")), F.struct(F.col("c").alias("a"), "b")))
        nxt = open_.join(apex, ["outline_id", "a", "b"]).withColumn("s", halves).select("outline_id", "x", "y", "s.a", "s.b")
        open_ = written(nxt.withColumn("d", side("b", "a")).where("d > 0"))
    hull = hull.distinct()
    low = hull.groupBy("outline_id").agg(F.min(F.struct("v.y", "v.x")).alias("p"))
    hull = hull.join(low, "outline_id")
    turn = F.atan2(F.col("v.y") - F.col("p.y"), F.col("v.x") - F.col("p.x"))
    first = (F.col("v.x") == F.col("p.x")) & (F.col("v.y") == F.col("p.y"))
    order = Window.partitionBy("outline_id").orderBy(F.desc(first), turn)
    return hull.select("outline_id", (F.row_number().over(order) - 1).alias("seq"), "v.x", "v.y")


def solidity(outlines: DataFrame) -> DataFrame:
    """outline_id, hull_area, solidity: area over hull area to four digits."""
    hull = om.perimeter_area(convex_hull(outlines)).select("outline_id", F.col("area").alias("hull_area"))
    df = om.perimeter_area(outlines).join(hull, "outline_id", "left").fillna(0.0, ["hull_area"])
    return df.select("outline_id", "hull_area", g.guarded_ratio("area", "hull_area", 4).alias("solidity"))
