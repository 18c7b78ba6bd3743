"""Scalar geometry as Column expressions. A point is a pair of double columns.

Ratios and angles are rounded half to even on the scaled value, and guards
give 0 rather than null; only a missing predecessor gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def half_even(x, digits: int) -> Column:
    return F.rint(col(x) * 10.0**digits) / 10.0**digits


def guarded_ratio(a, b, digits: int, least: float = EPS) -> Column:
    """a / b to so many digits, 0 where b is not above ``least``."""
    return F.when(col(b) > least, half_even(col(a) / col(b), digits)).otherwise(0.0)


def relative(now, before) -> Column:
    """now / before to two digits, null without a predecessor above the least size."""
    return F.when(col(before) > EPS, half_even(col(now) / col(before), 2))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    return F.sqrt(dx * dx + dy * dy)


def dot(ax, ay, bx, by) -> Column:
    return col(ax) * col(bx) + col(ay) * col(by)


def cross(ax, ay, bx, by) -> Column:
    return col(ax) * col(by) - col(ay) * col(bx)


def add(a: tuple, b: tuple) -> tuple[Column, ...]:
    """Sum of two vectors of two or three parts."""
    return tuple(col(p) + col(q) for p, q in zip(a, b, strict=True))


def subtract(a: tuple, b: tuple) -> tuple[Column, ...]:
    return tuple(col(p) - col(q) for p, q in zip(a, b, strict=True))


def scale(a: tuple, by) -> tuple[Column, ...]:
    return tuple(col(p) * col(by) for p in a)


def dot_product(a: tuple, b: tuple) -> Column:
    return sum((col(p) * col(q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def magnitude(a: tuple) -> Column:
    return F.sqrt(dot_product(a, a))


def normalized(a: tuple) -> tuple[Column, ...]:
    """The vector at length 1; null for the zero vector."""
    return tuple(F.when(magnitude(a) > 0, col(p) / magnitude(a)) for p in a)


def cross_3d(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    (x, y, z), (u, v, w) = a, b
    return cross(y, z, v, w), cross(z, x, w, u), cross(x, y, u, v)


def angle_between(ax, ay, bx, by) -> Column:
    """Signed angle from a to b in degrees."""
    return F.atan2(cross(ax, ay, bx, by), dot(ax, ay, bx, by)) * 180.0 / F.lit(3.141592653589793)


def unit(x, y) -> tuple[Column, Column]:
    """The vector at length 1; null for the zero vector."""
    n = F.sqrt(col(x) * col(x) + col(y) * col(y))
    return F.when(n > 0, col(x) / n), F.when(n > 0, col(y) / n)


def line_direction(ax, ay, bx, by, least: float = 1e-6) -> tuple[Column, Column]:
    n = distance(ax, ay, bx, by)
    one = lambda d: F.when(n < least, 0.0).otherwise(d / n)
    return one(col(bx) - col(ax)), one(col(by) - col(ay))


def perpendicular_direction(ax, ay, bx, by) -> tuple[Column, Column]:
    return unit(col(ay) - col(by), col(bx) - col(ax))


def line_angle(ax, ay, bx, by) -> Column:
    """Direction in degrees, 0 to 360."""
    a = F.degrees(F.atan2(col(by) - col(ay), col(bx) - col(ax)))
    return F.when(a < 0, a + 360.0).otherwise(a)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance to the nearest point of the segment."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    square = dx * dx + dy * dy
    along = ((col(px) - col(ax)) * dx + (col(py) - col(ay)) * dy) / square
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    return distance(px, py, col(ax) + t * dx, col(ay) + t * dy)


def in_triangle(p, a, b, c) -> Column:
    """True inside or on the edge; every argument is a pair."""

    def side(q, r):
        return (col(p[0]) - col(r[0])) * (col(q[1]) - col(r[1])) - (col(q[0]) - col(r[0])) * (col(p[1]) - col(r[1]))

    s = [side(a, b), side(b, c), side(c, a)]
    return ~((F.least(*s) < 0) & (F.greatest(*s) > 0))


def aspect_ratio(a, b) -> Column:
    return guarded_ratio(F.greatest(col(a), col(b)), F.least(col(a), col(b)), 2)


def triangle_aspect_ratio(longest, area) -> Column:
    height = F.when(col(area) > EPS, col(area) * 2.0 / col(longest)).otherwise(0.0)
    return guarded_ratio(longest, height, 2)


def circularity(perimeter, area) -> Column:
    ratio = 4.0 * 3.141592653589793 * col(area) / (col(perimeter) * col(perimeter))
    return F.when(col(perimeter) > EPS, half_even(ratio, 4)).otherwise(0.0)


def ellipse_area(width, height) -> Column:
    return F.lit(3.141592653589793) * (col(width) / 2.0) * (col(height) / 2.0)


def perceptual_distance(r1, g1, b1, r2, g2, b2) -> Column:
    dr, dg, db = (col(x).cast("double") - col(y).cast("double") for x, y in ((r1, r2), (g1, g2), (b1, b2)))
    return F.sqrt(2.0 * dr * dr + 4.0 * dg * dg + 3.0 * db * db)


def locked_angle(text) -> Column:
    """Degrees from a text, 0 where it is no number."""
    return F.coalesce(col(text).try_cast("double"), F.lit(0.0))


def target_pixels(count, percent) -> Column:
    """Pixels that a percentage stands for; both are clamped."""
    share = F.greatest(F.lit(0.001), F.least(F.lit(100.0), col(percent)))
    return F.greatest(F.lit(1), F.least(col(count), F.rint(col(count) * share / 100.0).cast("long"))).cast("long")


def target_percent(count, pixels) -> Column:
    """Share of pixels that a number stands for, clamped to 1 and to all, in percent with two digits."""
    return half_even(F.greatest(F.lit(1), F.least(col(count), col(pixels))) / col(count) * 100.0, 2)
