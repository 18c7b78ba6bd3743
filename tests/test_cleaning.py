"""Dead ends, cleaned masks and merged clicks against plain versions with queues."""

import random
from collections import deque

import pytest

from shapelake import catalog
from shapelake.operators import masks
from shapelake.operators import regions

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))


def around(p):
    return [(p[0] + a, p[1] + b) for a, b in FOUR]


def prune(m, w, h):
    m, queue = set(m), deque(m)
    while queue:
        p = queue.popleft()
        if p in m and 0 < p[0] < w - 1 and 0 < p[1] < h - 1 and sum(q in m for q in around(p)) <= 1:
            m.remove(p)
            queue += [q for q in around(p) if q in m]
    return m


def distances(sources, w, h):
    d, queue = dict.fromkeys(sources, 0), deque(sources)
    while queue:
        p = queue.popleft()
        for q in around(p):
            if 0 <= q[0] < w and 0 <= q[1] < h and q not in d:
                d[q] = d[p] + 1
                queue.append(q)
    return d


def cells(w, h):
    return {(x, y) for x in range(w) for y in range(h)}


def erode(m, w, h, r):
    d = distances(cells(w, h) - m, w, h)
    return {p for p in cells(w, h) if d.get(p, 1 << 29) > r}


def dilate(m, w, h, r):
    return {p for p, d in distances(m, w, h).items() if d <= r}


def part(m, seed):
    seen, queue = ({seed}, [seed]) if seed in m else (set(), [])
    while queue:
        for q in around(queue.pop()):
            if q in m and q not in seen:
                seen.add(q)
                queue.append(q)
    return seen


def parts(m):
    left, out = set(m), []
    for p in sorted(m, key=lambda p: (p[1], p[0])):
        if p in left:
            out.append(part(left, p))
            left -= out[-1]
    return out


def fill(m, w, h):
    out = cells(w, h) - m
    rim = [c for c in parts(out) if any(x in (0, w - 1) or y in (0, h - 1) for x, y in c)]
    return cells(w, h) - set().union(*rim)


def smooth(m, w, h):
    for _ in range(3):
        old = set(m)
        for x, y in old:
            if not (0 < x < w - 1 and 0 < y < h - 1):
                continue
            at = {k: (x + a, y + b) for k, (a, b) in {"n": (0, -1), "s": (0, 1), "e": (1, 0), "w": (-1, 0), "ne": (1, -1), "nw": (-1, -1), "se": (1, 1), "sw": (-1, 1)}.items()}
            on = {k: p in old for k, p in at.items()}
            plain = sum(on[k] for k in "nsew")
            missing = [a + b for a, b in (("n", "e"), ("s", "e"), ("s", "w"), ("n", "w")) if on[a] and on[b] and not on[a + b]]
            order = [k for k in ("ne", "se", "sw", "nw") if k in missing]
            if order:
                m = m | {at[order[0]]}
            elif not plain and ((on["ne"] and on["sw"]) or (on["nw"] and on["se"])):
                m = m | {at["n"]}
            elif plain >= 3:
                free = [k for k in ("ne", "nw", "se", "sw") if not on[k]]
                m = m | {at[free[0]]} if free else m
    return m


def clean_shape(m, w, h):
    m = fill(m, w, h)
    m = dilate(erode(m, w, h, 2), w, h, 2)
    m = erode(dilate(m, w, h, 1), w, h, 1)
    d = distances(cells(w, h) - m, w, h)
    m = {p for p in m if not any(q in m and d.get(q, 1 << 29) < 2 for q in around(p))}
    return prune(smooth(m, w, h), w, h)


def clean_mask(m, w, h, seed, keep_many, least=20):
    m = {p for p in m if 5 <= p[0] < w - 5 and 5 <= p[1] < h - 5}
    if not m:
        return set()
    x0, y0 = (max(0, min(p[k] for p in m) - 4) for k in (0, 1))
    cw, ch = (min(n - 1, max(p[k] for p in m) + 4) - low + 1 for k, n, low in ((0, w, x0), (1, h, y0)))
    inner = {(x - x0, y - y0) for x, y in m}
    if keep_many:
        out = set().union(*[c for c in (clean_shape(p, cw, ch) for p in parts(inner)) if len(c) >= least])
        out = out if len(out) >= least else inner
    else:
        left = parts(clean_shape(inner, cw, ch))
        out = max(left, key=len) if left else set()
        out = out if len(out) >= least else part(inner, (seed[0] - x0, seed[1] - y0))
    return {(x + x0, y + y0) for x, y in out}


def frames(spark, given, w, h):
    rows = [(i, x, y) for i, m in given.items() for x, y in m]
    mask = spark.createDataFrame(rows, "image_id long, x int, y int")
    return mask, spark.createDataFrame([(i, w, h) for i in given], "image_id long, w int, h int")


def pixels_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, set()).add((r.x, r.y))
    return out


def blobs(seed, w, h, n):
    rng, m = random.Random(seed), set()
    for _ in range(n):
        cx, cy, r = rng.randrange(w), rng.randrange(h), rng.randrange(2, 7)
        m |= {p for p in cells(w, h) if (p[0] - cx) ** 2 + (p[1] - cy) ** 2 <= r * r}
    return {p for p in m if rng.random() > 0.03} | {p for p in cells(w, h) if rng.random() < 0.02}


def test_dead_ends(spark):
    rng = random.Random(3)
    given = {1: blobs(1, 30, 20, 3), 2: {p for p in cells(30, 20) if rng.random() < 0.45}, 3: {(3, 3)}, 4: {(0, 4), (1, 4), (2, 4), (3, 4)}}
    comb = {(x, 10) for x in range(2, 28)} | {(x, y) for x in range(2, 28, 2) for y in range(11, 18)}
    given[5], given[6] = comb, comb | {(x, 12) for x in range(4, 7)}
    got = pixels_of(masks.prune_dead_ends(*frames(spark, given, 30, 20)))
    assert got == {i: p for i, m in given.items() if (p := prune(m, 30, 20))}


def test_a_long_spur_takes_few_rounds(spark, monkeypatch):
    snake = {(x, y) for x in range(5, 8) for y in range(5, 8)} | {(8, k) for k in range(7, 150)} | {(k, 149) for k in range(8, 170)}
    rounds = []
    real = masks.components
    monkeypatch.setattr(masks, "components", lambda m: rounds.append(1) or real(m))
    got = pixels_of(masks.prune_dead_ends(*frames(spark, {1: snake}, 200, 200)))
    assert got[1] == prune(snake, 200, 200) and len(got[1]) == 9 and len(rounds) < 15


def test_clean_mask(spark):
    given = {i: blobs(i, 36, 30, 2 + i % 3) for i in range(1, 7)}
    given[7], given[8] = {(6, 6), (7, 6), (20, 20)}, {(1, 1)}
    mask, dims = frames(spark, given, 36, 30)
    seeds = {i: min(m, key=lambda p: (p[0] < 5 or p[1] < 5, p)) for i, m in given.items()}
    at = spark.createDataFrame([(i, *p) for i, p in seeds.items()], "image_id long, x int, y int")
    for many in (False, True):
        got = pixels_of(masks.clean_mask(mask, dims, at, many))
        assert got == {i: c for i, m in given.items() if (c := clean_mask(m, 36, 30, seeds[i], many))}, many


def test_merged_clicks_of_the_query(spark, monkeypatch):
    seen = {}
    real = regions.merge_seeds
    monkeypatch.setattr(regions, "merge_seeds", lambda *a: seen.update(args=a) or real(*a))
    got = {}
    for r in catalog.QUERIES["merge_seeds"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault((r.image_id, r.region, r.confirmed), set()).add((r.x, r.y))
    raster, clicks, background, _ = seen["args"]
    colour = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in raster.collect()}
    back = {(r.image_id, r.x, r.y) for r in background.collect()}
    order = {}
    for r in sorted(clicks.collect(), key=lambda r: (r.image_id, r.click_seq)):
        order.setdefault(r.image_id, []).append((r.x, r.y))
    want = {}
    for image, turns in order.items():
        pending, region = set(), 0
        for p in turns:
            if p in pending:
                want[image, region, True] = pending
                pending, region = set(), region + 1
                continue
            new = flood(image, p, colour, back)
            if pending:
                wide = erode(dilate(pending | new, 32, 32, 6), 32, 32, 6)
                pending = clean_mask(wide, 32, 32, p, True)
            else:
                first = clean_mask(new, 32, 32, p, False)
                pending = first if len(first) >= 20 else set()
        if pending:
            want[image, region, False] = pending
    assert got == want and {k[2] for k in got} == {True, False}


def flood(image, seed, colour, back):
    """Region growing with a stack, by the rule of ``flood_fill``."""
    apart = lambda a, b: (2 * (a[0] - b[0]) ** 2 + 4 * (a[1] - b[1]) ** 2 + 3 * (a[2] - b[2]) ** 2) ** 0.5
    square = [(image, seed[0] + a, seed[1] + b) for a in range(-2, 3) for b in range(-2, 3)]
    near = [colour[p] for p in square if p in colour and p not in back] or [colour[(image, *seed)]]
    mean = [sum(c[k] for c in near) // len(near) for k in range(3)]
    seen, stack = {seed}, [seed]
    while stack:
        p = stack.pop()
        for q in around(p):
            at = (image, *q)
            if at in colour and at not in back and q not in seen:
                d = apart(colour[at], mean)
                if d <= 30 or (apart(colour[at], colour[(image, *p)]) <= 15 and d <= 150):
                    seen.add(q)
                    stack.append(q)
    return seen


def test_components_without_room_are_not_cleaned(spark, monkeypatch):
    box = lambda x, y, w, h: {(x + i, y + j) for i in range(w) for j in range(h)}
    ring = box(12, 3, 7, 7) - box(14, 5, 3, 3)  # filled before it is opened
    given = {
        1: box(0, 0, 6, 6) | box(10, 14, 4, 9) | box(20, 14, 9, 4) | {(9, 2), (25, 2), (26, 2)} | ring,
        2: box(0, 8, 3, 9) | box(27, 21, 3, 3) | box(8, 0, 9, 3) | box(20, 8, 5, 5) | box(4, 10, 4, 4),
    }
    seen = []
    whole = masks.clean_shape
    monkeypatch.setattr(masks, "clean_shape", lambda mask, dims: seen.append(dims.count()) or whole(mask, dims))
    for least in (1, 9):
        got = pixels_of(masks.clean_each_component(*frames(spark, given, 30, 24), least))
        want = {i: set().union(*[c for c in (clean_shape(p, 30, 24) for p in parts(m)) if len(c) >= least]) for i, m in given.items()}
        assert got == {i: m for i, m in want.items() if m}
    assert seen == [6, 6]
