"""Operators over pieces of bounded size against plain versions, with pieces small enough to matter."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake import catalog
from shapelake.operators import masks, outline_metrics, regions, splines
from shapelake.plans import tiles
from shapelake.plans.ranks import numbered
from shapelake.sources import reports, tables
from tests.test_cleaning import FOUR, around, cells, dilate, erode, frames, part, parts, pixels_of

SF = "/root/testdata/sf0.001"


def noise(w, h, share, seed):
    rng = random.Random(seed)
    return {p for p in cells(w, h) if rng.random() < share}


def test_components_across_tiles(spark):
    given = {1: noise(40, 33, 0.6, 1), 2: {(x, y) for x in range(40) for y in range(33) if y % 4 == 0 or x == (0 if y % 8 < 4 else 39)}, 3: {(7, 7), (8, 8)}}
    mask, _ = frames(spark, given, 40, 33)
    for size in (8, 256):
        got = {}
        for r in masks.components(mask, size).collect():
            got.setdefault((r.image_id, r.cy, r.cx), set()).add((r.x, r.y))
        want = {(i, *min((y, x) for x, y in c)): c for i, m in given.items() for c in parts(m)}
        assert got == want, size


def test_neighbourhoods_across_tiles(spark):
    given = {1: noise(40, 33, 0.9, 2), 2: {(39, 32), (15, 16)}}
    mask, dims = frames(spark, given, 40, 33)
    grown = tiles.over_tiles(mask, dims, 3, lambda m, *_: masks._grown(m, 3), 16)
    assert pixels_of(grown) == {i: dilate(m, 40, 33, 3) for i, m in given.items()}
    shrunk = tiles.over_tiles(mask, dims, 1, lambda m, *_: ~masks._grown(~m, 1), 16)
    assert pixels_of(shrunk) == {i: e for i, m in given.items() if (e := erode(m, 40, 33, 1))}


@pytest.mark.parametrize("size", [5, 256])
def test_spreading_across_tiles(spark, size):
    rng = random.Random(5)
    value = {(i, *p): rng.randrange(4) for i in (1, 2) for p in cells(23, 19)}
    px = spark.createDataFrame([(*k, v) for k, v in value.items() if rng.random() < 0.95], "image_id long, x int, y int, v int")
    value = {(r.image_id, r.x, r.y): r.v for r in px.collect()}
    seeds = [(1, 4, 4), (1, 20, 3), (2, 0, 0), (2, 22, 18), (3, 1, 1)]
    got = tiles.spread(px, ["v"], spark.createDataFrame(seeds, "image_id long, x long, y long"), lambda a, b: b["v"] <= a["v"] + 1, size)
    seen, stack = set(seeds), [s for s in seeds if s in value]
    while stack:
        i, x, y = stack.pop()
        for q in around((x, y)):
            at = (i, *q)
            if at in value and at not in seen and value[at] <= value[i, x, y] + 1:
                seen.add(at)
                stack.append(at)
    assert {tuple(r) for r in got.collect()} == seen and got.count() == len(seen)


def test_places_in_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.random(), k) for k in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, though the table is small
    try:
        got = numbered(spark.createDataFrame(rows, "g int, v double, k int"), ["g"], ["v", "k"], "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert {r.k: r.place for r in got} == want


def test_watershed_query_floods_as_a_heap_does(spark):
    got = {}
    for r in catalog.QUERIES["watershed"](spark, SF).collect():
        got.setdefault(r.image_id, set()).add((r.x, r.y))
    from shapelake.operators.pixels import box_blur, sobel_gradient

    height = {}
    for r in sobel_gradient(box_blur(tables.pixels(spark, SF), 1)).collect():
        height.setdefault(r.image_id, {})[r.x, r.y] = r.gradient
    back = {}
    for r in catalog.QUERIES["background_mask"](spark, SF).collect():
        back.setdefault(r.image_id, set()).add((r.x, r.y))
    peak = {r.image_id: (r.px, r.py) for r in catalog.QUERIES["interior_peak"](spark, SF).collect()}
    assert set(got) <= set(peak) and got
    for i, (px, py) in peak.items():
        label = {p: 0 for p in cells(32, 32) if p in back[i] or not (0 < p[0] < 31 and 0 < p[1] < 31)}
        for p in cells(32, 32):
            if (p[0] - px) ** 2 + (p[1] - py) ** 2 <= 9:
                label.setdefault(p, 1)
        heap = [(height[i][p], p[1] * 32 + p[0], p) for p in label]
        heapq.heapify(heap)
        while heap:
            _, _, p = heapq.heappop(heap)
            for q in around(p):
                if q in height[i] and q not in label:
                    label[q] = label[p]
                    heapq.heappush(heap, (height[i][q], q[1] * 32 + q[0], q))
        front = {p for p, k in label.items() if k == 1 and p not in back[i]}
        assert got.get(i, set()) == part(front, (px, py) if (px, py) in front else (16, 16)), i


def recursion(pts, eps):
    kept, stack = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while stack:
        s, e = stack.pop()
        if e - s < 2:
            continue
        (ax, ay), (bx, by) = pts[s], pts[e]
        p, dx, dy = np.array(pts[s + 1 : e]), bx - ax, by - ay
        square = dx * dx + dy * dy
        t = np.clip(((p[:, 0] - ax) * dx + (p[:, 1] - ay) * dy) / square, 0, 1) if square else np.zeros(len(p))
        d = np.hypot(p[:, 0] - ax - t * dx, p[:, 1] - ay - t * dy)
        if d.max() > eps:
            k = s + 1 + int(np.argmax(d))
            kept.add(k)
            stack += [(s, k), (k, e)]
    return kept


@pytest.mark.parametrize("at_once", [60, 16_384])
def test_simplified_lines(spark, monkeypatch, at_once):
    rng, rounds = random.Random(8), []
    monkeypatch.setattr(splines, "discard", lambda t: rounds.append(1))
    walk, at = [], 0.0
    for k in range(700):
        at += rng.uniform(-3, 3)
        walk.append((float(k), at))
    spiral = [(t * math.cos(t), t * math.sin(t)) for t in np.linspace(0, 60 if at_once == 60 else 400, 400 if at_once == 60 else 10_000)]
    given = {1: walk, 2: spiral, 3: [(0.0, 0.0)], 4: [(1.0, 1.0), (1.0, 1.0)], 5: [(0.0, 0.0), (5.0, 9.0), (0.0, 0.0)]}
    rows = [(i, k, float(x), float(y)) for i, pts in given.items() for k, (x, y) in enumerate(pts)]
    got = {}
    for r in splines.simplify(spark.createDataFrame(rows, "line_id long, seq int, x double, y double").repartition(5), 1.5, at_once).collect():
        got.setdefault(r.line_id, set()).add(r.seq)
    assert got == {i: recursion(pts, 1.5) for i, pts in given.items()}
    assert at_once == 60 or len(rounds) < 2 * math.log2(10_000)


def bezier(pts, tolerance):
    """Segments of one line by the recursion, with the same parameters and guards."""
    pts = np.array(pts)

    def towards(a, b, c):
        v = b - a if np.hypot(*(b - a)) >= 1e-9 or c is None else c - a
        n = np.hypot(*v)
        return v / n if n > 0 else np.zeros(2)

    def fit(a, b):
        p, span = pts[a : b + 1], b - a
        steps = np.hypot(*np.diff(p, axis=0).T)
        u = np.concatenate([[0], np.cumsum(steps)])
        u = u / u[-1] if u[-1] >= 1e-12 else np.arange(span + 1) / span
        t1, t2 = towards(p[0], p[1], p[2] if span > 1 else None), towards(p[-1], p[-2], p[-3] if span > 1 else None)
        basis = [(1 - u) ** 3, 3 * u * (1 - u) ** 2, 3 * u * u * (1 - u), u**3]
        rest = p - np.outer(basis[0] + basis[1], p[0]) - np.outer(basis[2] + basis[3], p[-1])
        c00, c01, c11 = (basis[1] ** 2).sum() * (t1 @ t1), (basis[1] * basis[2]).sum() * (t1 @ t2), (basis[2] ** 2).sum() * (t2 @ t2)
        x0, x1 = (basis[1] * (rest @ t1)).sum(), (basis[2] * (rest @ t2)).sum()
        chord, det = np.hypot(*(p[-1] - p[0])), c00 * c11 - c01 * c01
        left, right = ((x0 * c11 - x1 * c01) / det, (c00 * x1 - c01 * x0) / det) if abs(det) > 1e-12 else (chord / 3, chord / 3)
        if min(left, right) < chord * 1e-6 or span == 1:
            left = right = chord / 3
        q = [p[0], p[0] + t1 * left, p[-1] + t2 * right, p[-1]]
        v = np.arange(span + 1) / span
        curve = sum(np.outer(k, c) for k, c in zip(((1 - v) ** 3, 3 * v * (1 - v) ** 2, 3 * v * v * (1 - v), v**3), q, strict=True))
        err = np.hypot(*(p - curve).T)[1:-1]
        at = a + 1 + int(np.argmax(err)) if len(err) else a
        if len(err) and err.max() > tolerance and a + 1 < at < b - 1:
            return fit(a, at) + fit(at, b)
        return [(a, b, *np.round(np.concatenate(q), 5), float(err.max()) if len(err) else 0.0)]

    return fit(0, len(pts) - 1)


def test_bezier_segments_and_their_errors(spark):
    lines = {}
    for r in tables.polylines(spark, SF).collect():
        lines.setdefault(r.line_id, []).append((r.seq, r.x, r.y))
    lines = {i: [(x, y) for _, x, y in sorted(v)] for i, v in lines.items() if len(v) > 1}
    lines[-1] = [(float(i), math.sin(i / 3) * 10) for i in range(60)]
    rows = [(i, k, x, y) for i, v in lines.items() for k, (x, y) in enumerate(v)]
    got = {}
    for r in splines.fit_bezier(spark.createDataFrame(rows, "line_id long, seq int, x double, y double"), 2.0).collect():
        got.setdefault(r.line_id, []).append((r.a, r.b, r.x0, r.y0, r.x1, r.y1, r.x2, r.y2, r.x3, r.y3))
    for i, v in lines.items():
        want = bezier(v, 2.0)
        assert [s[:2] for s in sorted(got[i])] == [s[:2] for s in want], i
        assert np.allclose([s[2:] for s in sorted(got[i])], [s[2:10] for s in want], atol=1e-4), i
    assert len(got[-1]) > 3 and all(s[10] <= 2.0 for s in bezier(lines[-1], 2.0) if s[1] - s[0] > 4)


def crossing(pts):
    n = len(pts)
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, c, d = pts[i], pts[(i + 1) % n], pts[j], pts[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def test_crossings(spark, monkeypatch):
    monkeypatch.setattr(outline_metrics, "CROWD", 4)
    rng = random.Random(11)
    ring = lambda n, f: [((10 + f(k)) * math.cos(2 * math.pi * k / n), (10 + f(k)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    given = {k: ring(40, lambda _: rng.uniform(-8, 8)) for k in range(4)}
    given |= {k: [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randrange(4, 9))] for k in range(10, 30)}
    tiny = [(x * 1e-3, y * 1e-3) for x, y in ring(60, lambda _: 0.0)]
    given |= {50: [*tiny, (90.0, 1.0)], 51: [*tiny[:30], tiny[31], tiny[30], *tiny[32:], (90.0, -80.0)], 60: [(0.0, 0.0)] * 5}
    rows = [(i, k, *p) for i, v in given.items() for k, p in enumerate(v)]
    got = outline_metrics.self_intersections(spark.createDataFrame(rows, "outline_id long, seq int, x double, y double"))
    assert {r.outline_id: r.intersects for r in got.collect()} == {i: crossing(v) for i, v in given.items()}


def test_pairs_of_edges_follow_their_number(spark):
    n = 100_000
    t = 2 * F.pi() * F.col("id") / n
    # Half of the vertices lie in a thousandth of the outline.
    t = F.when(F.col("id") < n / 2, t * 0.002).otherwise(2 * F.pi() * (0.001 + 0.999 * (F.col("id") - n / 2) / (n / 2)))
    r = 10 + F.sin(40 * t)
    o = spark.range(n).select(F.lit(1).alias("outline_id"), F.col("id").alias("seq"), (r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"))
    assert outline_metrics.crossing_candidates(o).count() < 20 * n
    assert outline_metrics.self_intersections(o).first().intersects is False


def test_nearest_vertices_through_boxes(spark):
    rng = random.Random(12)
    given = {1: [(math.cos(k / 50), math.sin(k / 50)) for k in range(314)], 2: [(rng.random(), rng.random()) for _ in range(90)], 3: [(0.0, 0.0)]}
    rows = [(i, k * 2, *p) for i, v in given.items() for k, p in enumerate(v)]
    points = [(100 * i + k, i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in given for k in range(40)] + [(7, 1, 0.0, 0.0), (8, 9, 1.0, 1.0), (9, 1, None, 1.0)]
    o = spark.createDataFrame(rows, "outline_id long, seq int, x double, y double")
    got = outline_metrics.nearest_vertex(spark.createDataFrame(points, "point_id long, outline_id long, px double, py double"), o, 4)
    want = {}
    for p, i, x, y in points:
        if i in given and x is not None:
            want[p] = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), 2 * k) for k, (a, b) in enumerate(given[i]))
    got = {r.point_id: (r.distance, r.seq) for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[p][0] - d) < 1e-12 for p, (d, _) in want.items())
    assert all(got[p][1] == s for p, (_, s) in want.items() if p != 7)  # the centre is as near to all


def test_points_meet_a_box_of_vertices_in_one_row(spark):
    t = F.col("id") / 50
    o = spark.range(600).select(F.lit(1).alias("outline_id"), F.col("id").alias("seq"), F.cos(t).alias("x"), F.sin(t).alias("y"))
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(1).alias("outline_id"), (F.col("id") / 100).alias("px"), F.lit(0.3).alias("py"))
    found = outline_metrics.nearest_vertex(points, o)
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Every row of the join by box holds the box's vertices, so that sums and sorts have a row for a point and box.
    assert plan.count("collect_list") >= 1 and "min_by" not in plan


def test_csv_files_in_order(spark, tmp_path):
    rows = [(i, h, i / 7 + h, -1e-17 * i, 1 / 3, 2.0**-40 * h) for i in range(50) for h in range(1, 4)]
    efd = spark.createDataFrame(rows, "outline_id long, harmonic int, a double, b double, c double, d double")
    names = spark.createDataFrame([(i, f'no. {i}, "x"\nsecond line' if i % 9 == 0 else f"n{i}") for i in range(50)], "image_id long, specimen_name string")
    banked = reports.bank_specimens(efd, names)
    path = f"file://{tmp_path}/out"
    for _ in range(2):  # over what is there
        reports.write_efd_csv(reports.efd_csv_lines(banked).repartition(6), path, 4)
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) > 1 and all(f.name.startswith("part-") for f in files)
    text = "".join(f.read_text() for f in files)
    blocks = text.split("\n\n")
    assert len(blocks) == 50 and text.endswith("\n") and not text.endswith("\n\n")
    assert [b.split("\nharmonic")[0].strip('"').replace('""', '"') for b in blocks] == [r.specimen_name for r in names.orderBy("image_id").collect()]
    back = {(r.specimen_name, r.harmonic): tuple(r)[2:] for r in reports.read_efd_csv(spark, path).collect()}
    assert back == {(r.specimen_name, r.harmonic): (r.a, r.b, r.c, r.d) for r in banked.collect()}


def test_segment_takes_flooding_where_watershed_finds_nothing(spark):
    of = lambda name: pixels_of(catalog.QUERIES[name](spark, SF))
    by_watershed, by_flood, got = of("watershed"), of("flood_fill"), of("segment")
    assert got == {i: by_watershed.get(i, by_flood[i]) for i in by_flood}
    # A background that holds all but the seed leaves no room for a watershed.
    px = spark.createDataFrame([(1, x, y, 100, 100, 100) for x, y in cells(12, 12)], "image_id long, x int, y int, r int, g int, b int")
    back = spark.createDataFrame([(1, x, y) for x, y in cells(12, 12) if not (4 <= x <= 6 and y == 5)], "image_id long, x int, y int")
    click = spark.createDataFrame([(1, 5, 5)], "image_id long, x int, y int")
    assert pixels_of(regions.segment(px, click, back)) == {1: {(4, 5), (5, 5), (6, 5)}}


def test_watershed_of_one_tile_takes_no_rounds(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(6):
        places = [p for p in cells(13, 9) if rng.random() < 0.95]
        ranks = rng.sample(range(1, len(places) + 1), len(places))
        rows += [(i, x, y, k, rng.choice([0, 1, *[None] * 12]) if i else None) for (x, y), k in zip(places, ranks, strict=True)]
    nodes = spark.createDataFrame(rows, "image_id long, x int, y int, rank long, label int")
    got = {tuple(r) for r in nodes.groupBy("image_id").applyInArrow(regions._flooded, "image_id long, x int, y int").collect()}
    assert got == {tuple(r) for r in regions._flooded_in_rounds(nodes).collect()} and len(got) > 50
    px = spark.createDataFrame([(7, x, y, x * y % 11, x + y, 3) for x, y in cells(12, 12)], "image_id long, x int, y int, r int, g int, b int")
    seeds = spark.createDataFrame([(7, 6, 6)], "image_id long, x int, y int")
    want = {tuple(r) for r in regions.watershed(px, seeds).collect()}
    monkeypatch.setattr(regions, "TILE", 4)
    assert want == {tuple(r) for r in regions.watershed(px, seeds).collect()} and want
    monkeypatch.setattr(regions, "TILE", 256)
    monkeypatch.setattr(regions, "_flooded_in_rounds", None)
    assert want == {tuple(r) for r in regions.watershed(px, seeds).collect()}
