"""Clicks to arcs: a third click that makes a flat arc is ignored, and the next one that does not is taken."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.operators.assembly import assemble
from shapelake.plans.ranks import numbered
from shapelake.plans.rounds import discard, written

ENDS = ["x1", "y1", "x2", "y2", "x3", "y3"]
FAN = 64
#: Of a rounding error in a cross product, against the size of its terms.
ROOM = 1e-13


def flat_arc(x1, y1, x2, y2, x3, y3) -> Column:
    """True where the bisectors of an arc hardly meet; false, not null, where the chord has no length."""
    square = (g.col(x2) - g.col(x1)) ** 2 + (g.col(y2) - g.col(y1)) ** 2
    twice = F.abs(g.cross(g.col(x2) - g.col(x1), g.col(y2) - g.col(y1), g.col(x3) - g.col(x1), g.col(y3) - g.col(y1)))
    # With the third point at the height twice / chord over the chord's middle.
    return (square > 0) & (twice / (square / 4 + twice * twice / F.nullif(square, F.lit(0.0))) <= g.EPS)


def _is_flat(*ends) -> Column:
    return F.coalesce(flat_arc(*ends), F.lit(False))


def assemble_arcs(clicks: DataFrame, at_once: int = 4096) -> DataFrame:
    """session_id, op_seq and x1, y1 to x3, y3: two ends and a third click each.

    Where no plain triple of a session is flat, its plain triples are its arcs.
    Other sessions are read click by click if they have at most ``at_once``
    clicks, and else searched as ``_searched`` says. Clicks left over, and
    clicks behind two ends that no third click fits, make no arc.
    """
    plain = assemble(clicks, 3)
    bent = plain.where(_is_flat(*ENDS)).select("session_id").distinct()
    sizes = written(clicks.join(bent, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("clicks")))
    sessions, most = sizes.agg(F.count("*"), F.max("clicks")).first()
    if not sessions:
        return plain
    rest = plain.join(sizes, "session_id", "left_anti").select("session_id", F.col("op_seq").cast("long").alias("op_seq"), *ENDS)
    own = clicks.select("session_id", "click_seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    short = own.join(sizes.where(F.col("clicks") <= at_once), "session_id", "left_semi")
    kind = clicks.schema["session_id"].dataType.simpleString()
    schema = f"session_id {kind}, op_seq long, " + ", ".join(f"{c} double" for c in ENDS)
    out = rest.unionByName(short.groupBy("session_id").applyInPandas(_read, schema))
    if most <= at_once:
        return out
    return out.unionByName(_searched(own.join(sizes.where(F.col("clicks") > at_once), "session_id", "left_semi")))


def _read(clicks: pd.DataFrame) -> pd.DataFrame:
    """Arcs of one session of bounded size."""
    out, held = [], []
    for x, y in clicks.sort_values("click_seq")[["x", "y"]].itertuples(index=False, name=None):
        if len(held) < 2:
            held.append((x, y))
            continue
        (ax, ay), (bx, by) = held
        square = (bx - ax) ** 2 + (by - ay) ** 2
        twice = abs((bx - ax) * (y - ay) - (by - ay) * (x - ax))
        if square > 0 and math.isfinite(twice) and twice / (square / 4 + twice * twice / square) <= g.EPS:
            continue
        out.append((len(out), ax, ay, bx, by, x, y))
        held = []
    df = pd.DataFrame(out, columns=["op_seq", *ENDS])
    df.insert(0, "session_id", clicks["session_id"].iloc[0])
    return df


def _searched(clicks: DataFrame) -> DataFrame:
    """Arcs of sessions of any size.

    Where an arc that begins at a click would end depends on later clicks
    alone. For first clicks with a flat third one, that end is looked for in a
    tree of boxes over the session's clicks (``_first_fits``). Which clicks are
    first ones follows from jumps of doubling length.
    """
    points = written(numbered(clicks, ["session_id"], ["click_seq"]).drop("click_seq"))
    moved = lambda k: points.select("session_id", (F.col("n") - (k - 1)).alias("n"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    starts = moved(1).join(moved(2), ["session_id", "n"]).join(moved(3), ["session_id", "n"])
    starts = written(starts.withColumn("flat", _is_flat(*ENDS)))
    found = starts.where("not flat").select("session_id", "n", (F.col("n") + 2).alias("end"))
    flat = starts.where("flat").select("session_id", "n", "x1", "y1", "x2", "y2", (F.col("n") + 3).alias("at"))
    found = written(found.unionByName(_first_fits(points, flat)))
    jumps = found.select("session_id", "n", (F.col("end") + 1).alias("to"))
    firsts = written(points.where("n = 0").select("session_id", "n"))
    while jumps.limit(1).count():
        firsts = written(firsts.unionAll(jumps.join(firsts, ["session_id", "n"], "left_semi").select("session_id", F.col("to").alias("n"))))
        onward = jumps.select("session_id", F.col("n").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(onward, ["session_id", "to"]).select("session_id", "n", F.col("then").alias("to")))
    ops = found.join(firsts, ["session_id", "n"], "left_semi")
    third = points.select("session_id", F.col("n").alias("end"), F.col("x").alias("x3"), F.col("y").alias("y3"))
    ops = ops.join(starts.drop("x3", "y3", "flat"), ["session_id", "n"]).join(third, ["session_id", "end"])
    return numbered(ops, ["session_id"], ["n"], "op_seq").select("session_id", "op_seq", *ENDS)


def _boxes(points: DataFrame, level: int) -> DataFrame:
    """Boxes around the points (session_id, idx, x, y) of each idx, along the line from the first to the farthest of them.

    The box lies at (ox, oy), its side in the direction (ex, ey) spans a0 to
    a1 and the other c0 to c1. A point without coordinates makes its box odd.
    """
    every = Window.partitionBy("session_id", "idx")  # FAN clicks or FAN boxes' corners
    df = points.withColumn("odd", F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y"))
    df = df.withColumn("o", F.min(F.when(~F.col("odd"), F.struct("x", "y"))).over(every))
    df = df.withColumns({"dx": F.col("x") - F.col("o.x"), "dy": F.col("y") - F.col("o.y")})
    df = df.withColumn("far", F.max(F.when(~F.col("odd"), F.struct(F.hypot("dx", "dy").alias("d"), "dx", "dy"))).over(every))
    unit = lambda c, other: F.when(F.col("far.d") > 0, F.col(f"far.{c}") / F.col("far.d")).otherwise(F.lit(other))
    df = df.withColumns({"ex": unit("dx", 1.0), "ey": unit("dy", 0.0)})
    df = df.withColumns({"a": F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey"), "c": F.col("dy") * F.col("ex") - F.col("dx") * F.col("ey")})
    return df.groupBy("session_id", "idx").agg(
        F.max("odd").alias("odd"), F.first("o.x").alias("ox"), F.first("o.y").alias("oy"), F.first("ex").alias("ex"), F.first("ey").alias("ey"),
        F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
    ).withColumn("level", F.lit(level))


def _corner(a: str, c: str) -> tuple[Column, Column]:
    x = F.col("ox") + F.col("ex") * F.col(a) - F.col("ey") * F.col(c)
    return x, F.col("oy") + F.col("ey") * F.col(a) + F.col("ex") * F.col(c)


CORNERS = (("a0", "c0"), ("a0", "c1"), ("a1", "c0"), ("a1", "c1"))


def _surely_flat() -> Column:
    """Whether all of a box makes flat arcs with a chord: all of it near the chord's line, or all far off on one side."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    root = math.sqrt(1 - g.EPS * g.EPS)
    near, far = square * ((1 - root) / (2 * g.EPS)), square * ((1 + root) / (2 * g.EPS))
    heights, sizes = [], []
    for a, c in CORNERS:
        x, y = _corner(a, c)
        heights.append(dx * (y - F.col("y1")) - dy * (x - F.col("x1")))
        sizes.append(F.abs(dx) * (F.abs(y) + F.abs("y1")) + F.abs(dy) * (F.abs(x) + F.abs("x1")))
    room = F.greatest(*sizes) * ROOM + near * 1e-9
    low, high = F.least(*heights) - room, F.greatest(*heights) + room
    beyond = far * (1 + 1e-9)
    return ~F.col("odd") & (((low >= -near) & (high <= near)) | (low >= beyond) | (high <= -beyond))


def _first_fits(points: DataFrame, flat: DataFrame) -> DataFrame:
    """session_id, n, end: the first click from ``at`` on that makes no flat arc with the chord of x1, y1 and x2, y2.

    Every round looks at one box's children at most, from the place reached on:
    the first that is not surely flat is opened, and where there is none the
    search goes on one level up. So a search takes as many rounds as the tree
    has levels, up and down, however many clicks it passes.
    """
    nodes = points.select("session_id", F.lit(0).alias("level"), F.col("n").alias("idx"), F.lit(False).alias("odd"), F.col("x").alias("ox"), F.col("y").alias("oy"), *[F.lit(None).cast("double").alias(c) for c in ("ex", "ey", "a0", "a1", "c0", "c1")])
    columns, level, most = nodes.columns, 0, points.agg(F.max("n")).first()[0] or 0
    below = points.select("session_id", F.floor(F.col("n") / FAN).alias("idx"), "x", "y")
    while most >= FAN:
        level, most = level + 1, most // FAN
        boxes = written(_boxes(below, level).select(*columns))
        nodes = nodes.unionAll(boxes)
        corner = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (_corner(*k) for k in CORNERS)])).alias("p")
        lone = F.when(F.col("odd"), F.lit(None).cast("double"))  # an odd box's parent is odd
        below = boxes.select("session_id", F.floor(F.col("idx") / FAN).alias("idx"), "odd", corner)
        below = below.select("session_id", "idx", F.when(F.col("odd"), lone).otherwise(F.col("p.x")).alias("x"), F.col("p.y").alias("y"))
    nodes = written(nodes.withColumn("group", F.floor(F.col("idx") / FAN)))
    open_ = written(flat.withColumn("level", F.lit(0)))
    found, names = open_.limit(0).select("session_id", "n", F.col("at").alias("end")), open_.columns
    while True:
        q = open_.withColumn("group", F.floor(F.col("at") / FAN))
        tried = q.join(nodes, ["session_id", "level", "group"]).where("idx >= at")
        flat_here = F.when(F.col("level") == 0, _is_flat("x1", "y1", "x2", "y2", "ox", "oy")).otherwise(_surely_flat())
        hit = tried.groupBy(*names, "group").agg(F.min(F.when(~flat_here, F.col("idx"))).alias("hit"))
        hit = written(hit)
        found = written(found.unionByName(hit.where("level = 0 and hit is not null").select("session_id", "n", F.col("hit").alias("end"))))
        on = hit.where("level > 0 or hit is null")
        down = F.col("hit").isNotNull()
        to = {"at": F.when(down, F.col("hit") * FAN).otherwise(F.col("group") + 1), "level": F.when(down, F.col("level") - 1).otherwise(F.col("level") + 1)}
        after = written(on.withColumns(to).where(F.col("level") <= level).select(*names))
        discard(open_)
        open_ = after
        if not open_.limit(1).count():
            return found
