"""Known answers, invariants, and small independent versions of the operators that take rounds."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.operators import fourier, masks, outline_building, outline_metrics, pixels, regions, sessions, splines
from shapelake.plans.rounds import connected_components
from shapelake.sources import images, reports

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def outline(spark, points, oid=1):
    return spark.createDataFrame([(oid, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "outline_id long, seq int, x double, y double")


def mask_of(spark, rows):
    cells = [(1, x, y) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"]
    m = spark.createDataFrame(cells, "image_id long, x int, y int")
    return m, spark.createDataFrame([(1, len(rows[0]), len(rows))], "image_id long, w int, h int")


def cells(df):
    return {(r.x, r.y) for r in df.collect()}


def test_unit_square(spark):
    m = outline_metrics.shape_metrics(outline(spark, SQUARE)).first()
    assert (m.area, m.perimeter, m.sum_turning, m.var_turning, m.circularity) == (1.0, 4.0, 360.0, 0.0, 0.7854)
    assert outline_building.solidity(outline(spark, SQUARE)).first().solidity == 1.0


def test_circle(spark):
    ring = [(math.cos(2 * math.pi * i / 360), math.sin(2 * math.pi * i / 360)) for i in range(360)]
    o = outline(spark, ring)
    assert outline_metrics.shape_metrics(o).first().circularity == 0.9999 or outline_metrics.shape_metrics(o).first().circularity == 1.0
    raw = {r.harmonic: r for r in fourier.efd_raw(o, 5).collect()}
    assert abs(raw[1].a - 1) < 1e-3 and all(abs(raw[h].a) < 1e-6 for h in range(2, 6))


def test_descriptors_do_not_depend_on_place_size_turn_or_start(spark):
    random.seed(3)
    base = [((10 + random.random() * 4) * math.cos(2 * math.pi * i / 40), (6 + random.random()) * math.sin(2 * math.pi * i / 40)) for i in range(40)]
    turn = [(3 * (x * math.cos(0.3) - y * math.sin(0.3)) + 7, 3 * (x * math.sin(0.3) + y * math.cos(0.3)) - 2) for x, y in base]
    a = fourier.efd_normalized(fourier.efd_raw(outline(spark, base), 6)).orderBy("harmonic").collect()
    b = fourier.efd_normalized(fourier.efd_raw(outline(spark, turn), 6)).orderBy("harmonic").collect()
    assert all(abs(x[c] - y[c]) < 1e-9 for x, y in zip(a, b) for c in "abcd")


def triple(spark, *p):
    row = (1, 0, *[float(v) for q in p for v in q])
    return spark.createDataFrame([row], "session_id long, op_seq long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


def test_landmarks(spark):
    arc = sessions.circular_arc_metrics(triple(spark, (-1, 0), (1, 0), (0, 1))).first()
    assert (arc.central_angle, arc.chord_rise_ratio, arc.chord_arc_ratio) == (180.0, 2.0, 0.64)
    assert sessions.circular_arc_metrics(triple(spark, (-1, 0), (1, 0), (3, 0))).first().is_flat
    par = sessions.parabola_metrics(triple(spark, (0, 0), (1, 0), (0.5, 0.25))).first()
    assert (par.a, par.vertex_curvature, par.rise_span_ratio) == (-1.0, 2.0, 0.25)
    tri = sessions.triangle_metrics(triple(spark, (0, 0), (3, 0), (0, 4))).first()
    assert (tri.angle_a, tri.angle_b, tri.angle_c, tri.aspect_ratio) == (90.0, 53.13, 36.87, 2.08)
    assert sessions.triangle_metrics(triple(spark, (0, 0), (1, 1), (2, 2))).first().is_degenerate


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(7, 7), (7, 99)]
    parent = list(range(100))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: root(v) for e in edges for v in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def noise(w, h, share, seed):
    random.seed(seed)
    return ["".join("#" if random.random() < share else "." for _ in range(w)) for _ in range(h)]


def spread(inside, starts):
    seen, stack = set(starts), list(starts)
    while stack:
        x, y = stack.pop()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in inside and n not in seen:
                seen.add(n)
                stack.append(n)
    return seen


def test_mask_components_and_peeling(spark):
    rows = noise(14, 12, 0.6, 5)
    m, dims = mask_of(spark, rows)
    inside = cells(m)
    for r in masks.components(m).collect():
        assert (r.cx, r.cy) == min(spread(inside, [(r.x, r.y)]), key=lambda c: (c[1], c[0]))
    left = set(inside)
    while True:
        loose = {(x, y) for x, y in left if 0 < x < 13 and 0 < y < 11 and sum(n in left for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))) <= 1}
        if not loose:
            break
        left -= loose
    assert cells(masks.prune_dead_ends(m, dims)) == left


def test_flood_fill_takes_the_accepted_pixels_only(spark):
    random.seed(9)
    raster = {(x, y): tuple(random.choice((40, 55, 70, 120)) for _ in range(3)) for x in range(9) for y in range(9)}
    df = spark.createDataFrame([(1, x, y, *c) for (x, y), c in raster.items()], "image_id long, x int, y int, r int, g int, b int")
    seed = spark.createDataFrame([(1, 4, 4, *raster[4, 4])], "image_id long, x int, y int, sr int, sg int, sb int")
    far = lambda a, b: math.sqrt(2 * (a[0] - b[0]) ** 2 + 4 * (a[1] - b[1]) ** 2 + 3 * (a[2] - b[2]) ** 2)
    seen, queue = {(4, 4)}, [(4, 4)]
    while queue:
        x, y = queue.pop()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in raster and n not in seen:
                s, d = far(raster[n], raster[4, 4]), far(raster[n], raster[x, y])
                if (d <= 40 or s <= 60) and (s <= 60 or d <= 30 and s <= 300):
                    seen.add(n)
                    queue.append(n)
    assert cells(regions.flood_fill(df, seed, None, tolerance=60.0)) == seen


def test_watershed_is_the_flooding(spark):
    random.seed(4)
    w = h = 16
    value = {(x, y): (60 if (x - 8) ** 2 + (y - 8) ** 2 < 20 else 200) + random.randrange(12) for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(1, x, y, v, v, v) for (x, y), v in value.items()], "image_id long, x int, y int, r int, g int, b int")
    seeds = spark.createDataFrame([(1, 8, 8)], "image_id long, x int, y int")
    grad = {(r.x, r.y): r.gradient for r in pixels.sobel_gradient(df).collect()}
    peak = regions.interior_peak(df, seeds).first()
    label, heap = {}, []
    for c in sorted(value, key=lambda c: (c[1], c[0])):
        if c[0] in (0, w - 1) or c[1] in (0, h - 1):
            label[c] = 0
        elif (c[0] - peak.px) ** 2 + (c[1] - peak.py) ** 2 <= 9:
            label[c] = 1
    for c in label:
        heapq.heappush(heap, (grad[c], c[1] * w + c[0]))
    while heap:
        _, i = heapq.heappop(heap)
        x, y = i % w, i // w
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in value and n not in label:
                label[n] = label[x, y]
                heapq.heappush(heap, (grad[n], n[1] * w + n[0]))
    front = {c for c, k in label.items() if k == 1}
    assert cells(regions.watershed(df, seeds)) == spread(front, [(peak.px, peak.py)])


def test_trace_and_build(spark):
    m, _ = mask_of(spark, ["......", ".####.", ".####.", ".##...", ".##..#", "......"])
    loop = outline_building.trace_boundary(m).orderBy("seq").collect()
    assert (loop[0].x, loop[0].y) == (1.0, 1.0) and len(loop) == 16
    assert outline_metrics.perimeter_area(outline_building.trace_boundary(m)).first().area == 12.0
    built = outline_building.build_outline(m).orderBy("seq").collect()
    assert (built[0].x, built[0].y) == (built[-1].x, built[-1].y)


def test_simplify_is_the_recursion(spark):
    random.seed(2)
    pts = [(float(i), random.random() * 6) for i in range(40)]

    def dist(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def keep(s, e):
        if e <= s + 1:
            return {s, e}
        d, i = max(((dist(pts[i], pts[s], pts[e]), -i) for i in range(s + 1, e)))
        return keep(s, -i) | keep(-i, e) if d > 1.5 else {s, e}

    line = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "line_id long, seq int, x double, y double")
    assert {r.seq for r in splines.simplify(line, 1.5).collect()} == keep(0, 39)


def test_bezier_ends_and_error(spark):
    pts = [(float(i), math.sin(i / 3) * 10) for i in range(30)]
    line = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "line_id long, seq int, x double, y double")
    fitted = splines.fit_bezier(line).orderBy("a").collect()
    assert fitted[0].a == 0 and fitted[-1].b == 29 and all(p.b == q.a for p, q in zip(fitted, fitted[1:]))
    assert all((s.x0, s.y0) == pts[s.a] and (s.x3, s.y3) == pts[s.b] for s in fitted)


def test_opening_and_closing_bound_the_mask(spark):
    m, dims = mask_of(spark, noise(12, 12, 0.7, 8))
    assert cells(masks.opened(m, dims, 1)) <= cells(m) <= cells(masks.closed(m, dims, 1))


def test_pixels_from_bytes(spark):
    rows = [(1, 1, 2, 3, bytearray([1, 2, 3, 4, 5, 6])), (2, 1, 2, 1, bytearray([9, 8]))]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary")
    got = {(r.image_id, r.x): (r.r, r.g, r.b) for r in images.explode_pixels(df).collect()}
    assert got == {(1, 0): (3, 2, 1), (1, 1): (6, 5, 4), (2, 0): (9, 9, 9), (2, 1): (8, 8, 8)}


def test_csv_quotes(spark):
    efd = spark.createDataFrame([(1, 1, 0.5, 0.25, 1.0, 2.0)], "outline_id long, harmonic int, a double, b double, c double, d double")
    names = spark.createDataFrame([(1, 'a,"b"')], "image_id long, specimen_name string")
    lines = [r.line for r in reports.efd_csv_lines(reports.bank_specimens(efd, names)).orderBy("line_no").collect()]
    assert lines == ['"a,""b"""', "harmonic,a,b,c,d", "1,0.5,0.25,1.0,2.0", ""]


@pytest.mark.parametrize("actions,left", [("ccu", [1]), ("ccur", [1, 2]), ("cucr", [3]), ("uuc", [3])])
def test_histories(spark, actions, left):
    word = {"c": "commit", "u": "undo", "r": "redo"}
    log = [(1, i, word[a], "line", float(i)) for i, a in enumerate(actions, 1)]
    df = spark.createDataFrame(log, "session_id long, event_seq long, action string, kind string, measure double")
    assert sorted(r.op_seq for r in sessions.replay_history(df).collect()) == left


def _arcs_by_hand(points):
    out, held = [], []
    for p in points:
        if len(held) < 2:
            held.append(p)
            continue
        (ax, ay), (bx, by) = held
        chord = math.dist(*held)
        height = abs((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)) / chord if chord else 0
        if chord and chord * height / (chord * chord / 4 + height * height) <= 1e-5:
            continue
        out.append((*held[0], *held[1], *p))
        held = []
    return out


def test_arcs_ignore_flat_third_clicks(spark):
    r = random.Random(3)
    sessions_ = {s: [(float(r.randrange(4)), float(r.randrange(2) if s % 2 else r.randrange(3))) for _ in range(n)] for s, n in enumerate((0, 1, 2, 3, 40, 41, 77))}
    sessions_[7] = [(float(i), 0.0) for i in range(12)]  # never ends its first arc
    sessions_[8] = [(float(i), float(i * i)) for i in range(31)]  # no flat arc
    rows = [(s, 3 * i, x, y) for s, ps in sessions_.items() for i, (x, y) in enumerate(ps)]
    got = {}
    for x in sessions.assemble_arcs(spark.createDataFrame(rows, "session_id long, click_seq long, x double, y double")).orderBy("session_id", "op_seq").collect():
        got.setdefault(x.session_id, []).append(tuple(x)[1:])
    for s, ps in sessions_.items():
        assert got.get(s, []) == [(i, *op) for i, op in enumerate(_arcs_by_hand(ps))]


def test_vectors_of_two_and_three_parts(spark):
    a, b, zero = (F.lit(1.0), F.lit(2.0), F.lit(2.0)), (F.lit(3.0), F.lit(0.0), F.lit(4.0)), (F.lit(0.0),) * 3
    row = spark.range(1).select(
        F.array(*g.add(a, b)), F.array(*g.subtract(a, b)), F.array(*g.scale(a, 2.0)), g.dot_product(a, b), F.array(*g.cross_3d(a, b)),
        g.magnitude(a[1:]), F.array(*g.normalized(b[::2])), F.array(*g.normalized(zero)),
    ).first()
    assert list(row) == [[4, 2, 6], [-2, 2, -2], [2, 4, 4], 11, [8, 2, -6], math.sqrt(8), [0.6, 0.8], [None] * 3]


def test_replay_without_a_session(spark):
    log = [(None, 1, "commit", "line", 2.0), (None, 2, "commit", "line", 3.0), (None, 3, "undo", None, None), (5, 1, "undo", None, None)]
    df = spark.createDataFrame(log, "session_id long, event_seq long, action string, kind string, measure double")
    assert [tuple(x) for x in sessions.replay_history(df).collect()] == [(None, 1, "line", 2.0, None)]
    assert {tuple(x) for x in sessions.latest_result(df).collect()} == {(None, "line", 2.0, None), (5, None, 0.0, None)}
