"""Arcs of sessions of any length, with flat third clicks, against reading click by click."""

import math
import random

import pytest

from shapelake.operators import arcs

SCHEMA = "session_id long, click_seq long, x double, y double"


def by_hand(points):
    out, held = [], []
    for x, y in points:
        if len(held) < 2:
            held.append((x, y))
            continue
        (ax, ay), (bx, by) = held
        square, twice = (bx - ax) ** 2 + (by - ay) ** 2, abs((bx - ax) * (y - ay) - (by - ay) * (x - ax))
        if square > 0 and twice / (square / 4 + twice * twice / square) <= 1e-5:
            continue
        out.append((len(out), ax, ay, bx, by, x, y))
        held = []
    return out


def line(n, rng, bend=0.0):
    """Clicks along a slanted line, the last one off it."""
    at = [rng.uniform(-900, 900) for _ in range(n - 1)]
    return [(x, 0.37 * x + 5 + bend * math.sin(x)) for x in at] + [(3.0, 500.0)]


def sessions():
    rng = random.Random(4)
    dots = lambda n: [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(n)]
    few = lambda n: [(float(rng.randrange(4)), float(rng.randrange(3))) for _ in range(n)]
    return {
        1: line(5000, rng) + dots(20), 2: dots(301), 3: few(400), 4: line(70, rng) + line(90, rng, 1e-9) + few(9), 5: few(6), 6: [(1.0, 1.0)] * 8,
        7: [(0.0, 0.0), (1e-7, 0.0), *[(1e3 * k, 1e3) for k in range(200)], (1e-7, 1e-7)], 8: dots(2), 9: line(129, rng)[:-1],
    }


@pytest.mark.parametrize("at_once", [4, 10_000])
def test_arcs(spark, at_once):
    given = sessions()
    rows = [(s, i * 3, *p) for s, points in given.items() for i, p in enumerate(points)]
    random.Random(1).shuffle(rows)
    got = arcs.assemble_arcs(spark.createDataFrame(rows, SCHEMA), at_once).collect()
    for s, points in given.items():
        assert sorted(tuple(r)[1:] for r in got if r.session_id == s) == by_hand(points), s


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(arcs, "discard", lambda table: rounds.append(1))
    points = line(5000, random.Random(2))
    rows = [(1, i, *p) for i, p in enumerate(points)]
    got = arcs.assemble_arcs(spark.createDataFrame(rows, SCHEMA), 100).collect()
    assert [tuple(r)[1:] for r in got] == by_hand(points) and len(rounds) < 20
