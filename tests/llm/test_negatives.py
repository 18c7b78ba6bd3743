"""op12 against all pairs; its query is also held against SQL in test_queries."""

import random

import numpy as np
from pyspark.sql import functions as F

from shapelake.llm import hard_negatives as hn


def brute(rows, is_anchor, p):
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows})
    out = []
    for x in rows:
        if not is_anchor(x[0]):
            continue
        scored = [(sum(a * b for a, b in zip(x[2], y[2], strict=True)), y) for y in rows if y != x and len(y[2]) == len(x[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for score, y in [s for s in scored if s[1][1] == x[1]][: p.positives]:
            fits = [s for s in scored if s[1][1] != x[1] and p.low * score <= 100 * s[0] and 100 * s[0] <= p.high * score]
            out += [(x[0], y[0], r, z[0], score, s) for r, (s, z) in enumerate(fits[: p.negatives], 1)]
    return sorted(out)


def clustered(n, seed, dim=8):
    rng = random.Random(seed)
    centres = [[rng.randint(-400, 400) for _ in range(dim)] for _ in range(6)]
    return [(i, rng.randrange(4), [c + rng.randint(-9, 9) for c in rng.choice(centres)]) for i in range(n)]


def test_equals_all_pairs_in_any_blocks(spark):
    rows = clustered(400, 3)
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    for p in (hn.MiningParameters(), hn.MiningParameters(block=70, anchor_block=9, positives=2, negatives=4, low=20)):
        got = hn.mine(df, F.col("vec_id") % 7 == 0, p)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 7 == 0, p)


def test_odd_rows(spark):
    rows = clustered(60, 5) + [(70, 1, [5] * 8), (70, 1, [5] * 8), (77, 1, [5] * 8), (84, 2, [4] * 8), (91, 2, [0] * 8)]
    rows += [(98, 1, [-5] * 8), (105, 3, [7, 7]), (106, 3, [7, 8]), (107, 1, [7, 6]), (77, 2, [5] * 8)]
    odd = [(112, None, [1] * 8), (119, 1, None), (126, 1, []), (None, 1, [1] * 8), (133, 1, [1, None] * 4), (140, 1, [1 << 40] * 8)]
    schema = "vec_id long, label int, v array<long>, row int, positives int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], schema)
    p = hn.MiningParameters(block=20, anchor_block=4)
    got = hn.mine(df, F.col("vec_id") % 7 == 0, p)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 7 == 0, p)
    assert hn.mine(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = 1 << 28
    rows = [(7 * i, i % 2, [big + i, big - 3 * i, i]) for i in range(9)]
    p = hn.MiningParameters(high=100)
    got = hn.mine(spark.createDataFrame(rows, "vec_id long, label int, v array<long>"), F.lit(True), p)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: True, p)


def test_bounds_hold_and_save_work():
    rows = clustered(600, 9)
    v = np.array([r[2] for r in rows])
    anchors = v[::10]
    parent, edge = hn.spanning_tree(anchors)
    assert (parent == np.arange(len(anchors))).sum() == 1
    seen, scored = 0, 0

    def choose(k, low, high):
        nonlocal seen, scored
        exact = v @ anchors[k]
        assert ((low <= exact) & (exact <= high)).all()
        rows = np.flatnonzero(high >= np.sort(exact)[-60])
        seen, scored = seen + len(v), scored + len(rows)
        return rows

    walked = [k for k, _, _ in hn.walk(v, anchors, parent, edge, choose)]
    assert sorted(walked) == list(range(len(anchors)))
    assert scored < 0.5 * seen
