"""Elliptic Fourier descriptors of closed outlines, in long form: outline_id, harmonic, a, b, c, d."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.operators.outline_metrics import with_neighbours


def _by():
    return Window.partitionBy("outline_id").orderBy("seq")


def harmonic_clamp(h) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(1), F.coalesce(g.col(h), F.lit(10))))


def efd_raw(outlines: DataFrame, harmonics: int = 10) -> DataFrame:
    """Coefficients by arc length; zeros for an outline shorter than 1e-10, edges shorter than that add nothing."""
    harmonics = max(1, min(100, harmonics))
    df = with_neighbours(outlines).withColumn("step", g.distance("x", "y", "nx", "ny"))
    df = df.withColumns({
        "to": F.sum("step").over(_by().rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("step").over(Window.partitionBy("outline_id")),
    })
    df = df.withColumn("harmonic", F.explode(F.sequence(F.lit(1), F.lit(harmonics))))
    turn = 2 * math.pi * F.col("harmonic") / F.col("total")
    df = df.withColumns({"a1": turn * F.col("to"), "a0": turn * (F.col("to") - F.col("step"))})
    counts = (F.col("total") >= 1e-10) & (F.col("step") >= 1e-10)
    part = lambda d, f: F.sum(F.when(counts, d / F.col("step") * (f("a1") - f("a0"))).otherwise(0.0))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    sums = df.groupBy("outline_id", "harmonic").agg(
        F.first("total").alias("total"), part(dx, F.cos).alias("a"), part(dx, F.sin).alias("b"),
        part(dy, F.cos).alias("c"), part(dy, F.sin).alias("d"),
    )
    scale = F.col("total") / (2.0 * F.col("harmonic") * F.col("harmonic") * math.pi * math.pi)
    return sums.select("outline_id", "harmonic", *[(scale * F.col(x)).alias(x) for x in "abcd"])


def efd_normalized(raw: DataFrame) -> DataFrame:
    """Coefficients free of start point, rotation and size, by the first harmonic; as they are where that has no size."""
    one = lambda x: F.max(F.when(F.col("harmonic") == 1, F.col(x))).over(Window.partitionBy("outline_id"))
    df = raw.withColumns({f"{x}1": one(x) for x in "abcd"})
    theta = 0.5 * F.atan2(
        2 * (F.col("a1") * F.col("b1") + F.col("c1") * F.col("d1")),
        F.col("a1") ** 2 - F.col("b1") ** 2 + F.col("c1") ** 2 - F.col("d1") ** 2,
    )
    df = df.withColumn("theta", theta)
    df = df.withColumns({
        "sa": F.col("a1") * F.cos("theta") + F.col("b1") * F.sin("theta"),
        "sc": F.col("c1") * F.cos("theta") + F.col("d1") * F.sin("theta"),
        "t": F.col("harmonic") * F.col("theta"),
    })
    df = df.withColumns({"psi": F.atan2("sc", "sa"), "size": F.sqrt(F.col("sa") ** 2 + F.col("sc") ** 2)})
    turned = {
        "ar": F.col("a") * F.cos("t") + F.col("b") * F.sin("t"), "br": F.col("b") * F.cos("t") - F.col("a") * F.sin("t"),
        "cr": F.col("c") * F.cos("t") + F.col("d") * F.sin("t"), "dr": F.col("d") * F.cos("t") - F.col("c") * F.sin("t"),
    }
    df = df.withColumns(turned)
    along = lambda x, y: (F.col(x) * F.cos("psi") + F.col(y) * F.sin("psi")) / F.col("size")
    across = lambda x, y: (F.col(y) * F.cos("psi") - F.col(x) * F.sin("psi")) / F.col("size")
    out = {"a": along("ar", "cr"), "b": along("br", "dr"), "c": across("ar", "cr"), "d": across("br", "dr")}
    kept = [F.when(F.col("size") < 1e-10, F.col(k)).otherwise(v).alias(k) for k, v in out.items()]
    return df.select("outline_id", "harmonic", *kept)


def series(efd: DataFrame, samples: int) -> DataFrame:
    """x(t) and y(t) of the descriptors' curve at samples + 1 steps of a turn."""
    df = efd.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    angle = F.col("harmonic") * (2 * math.pi * F.col("sample") / samples)
    return df.groupBy("outline_id", "sample").agg(
        F.sum(F.col("a") * F.cos(angle) + F.col("b") * F.sin(angle)).alias("x"),
        F.sum(F.col("c") * F.cos(angle) + F.col("d") * F.sin(angle)).alias("y"),
    )


def projection_series(normalized: DataFrame, harmonics: int = 10) -> DataFrame:
    return series(normalized.where(F.col("harmonic") <= harmonics), max(200, 20 * harmonics))


def vertex_mean(outlines: DataFrame) -> DataFrame:
    return outlines.groupBy("outline_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def reconstruct(raw: DataFrame, means: DataFrame, harmonics: int = 10) -> DataFrame:
    """The closed curve of the raw descriptors around the outline's mean vertex."""
    curve = series(raw.where(F.col("harmonic") <= harmonics), max(100, 20 * harmonics)).join(means, "outline_id")
    return curve.select(
        "outline_id", "sample", (F.col("x") + F.col("mean_x")).alias("x"), (F.col("y") + F.col("mean_y")).alias("y")
    )
