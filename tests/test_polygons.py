"""Metres inside polygons against sampling, and the rule for stairs."""

import math
import random

import pytest

from stepfree.operators import polygons

SEGS = "id long, x1 double, y1 double, x2 double, y2 double"
SHAPES = "polygon_id long, rings array<array<struct<x: double, y: double>>>"


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def shape(i, rings):
    return i, [[{"x": x, "y": y} for x, y in ring] for ring in rings]


def test_equals_sampling(spark):
    rng = random.Random(2)
    shapes = []
    for i in range(25):
        cx, cy, n = rng.uniform(0, 150), rng.uniform(0, 150), rng.randint(3, 9)
        star = lambda scale: [(cx + scale * rng.uniform(3, 25) * math.cos(2 * math.pi * k / n), cy + scale * rng.uniform(3, 25) * math.sin(2 * math.pi * k / n)) for k in range(n)]  # noqa: B023, E731
        ring = star(1.0)
        shapes.append((i, [ring + ring[:1] * (i % 2), [((x - cx) * 0.3 + cx, (y - cy) * 0.3 + cy) for x, y in ring]]))  # with a hole; closed or not
    segs = [(i, *(rng.uniform(-20, 170) for _ in range(4))) for i in range(80)] + [(99, 5.0, 5.0, 5.0, 5.0)]
    got = {r["id"]: r["inside_m"] for r in polygons.covered(spark.createDataFrame(segs, SEGS), spark.createDataFrame([shape(i, r) for i, r in shapes], SHAPES), ["id"]).collect()}
    steps = 3000
    for i, x1, y1, x2, y2 in segs[:-1]:
        length = math.hypot(x2 - x1, y2 - y1)
        on = sum(any(inside(r, x1 + (x2 - x1) * (k + 0.5) / steps, y1 + (y2 - y1) * (k + 0.5) / steps) for _, r in shapes) for k in range(steps))
        assert got.get(i, 0.0) == pytest.approx(on / steps * length, abs=length * 20 / steps)
    assert 99 not in got and sum(v > 1 for v in got.values()) > 30


def test_exact_cases(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    shapes = spark.createDataFrame([shape(1, [square]), shape(2, [[(x + 5, y) for x, y in square]]), shape(3, [[(100.0, 0.0), (101.0, 0.0)]]), shape(4, [])], SHAPES)
    segs = [(1, -5.0, 5.0, 20.0, 5.0), (2, 2.0, 2.0, 4.0, 2.0), (3, 50.0, 5.0, 60.0, 5.0), (4, 3.0, -4.0, 3.0, 4.0), (5, 20.0, 5.0, -5.0, 5.0), (6, 99.0, 0.0, 102.0, 0.0)]
    got = {r["id"]: r["inside_m"] for r in polygons.covered(spark.createDataFrame(segs, SEGS), shapes, ["id"], 3.0).collect()}
    assert got == pytest.approx({1: 15.0, 2: 2.0, 4: 4.0, 5: 15.0})


def test_stairs_rule(spark):
    rows = [(1, 10.0, 10.0, "sidewalk", 3.0), (2, 10.0, 10.0, "sidewalk", 2.9), (3, 11.6, 10.0, "road", 9.0), (4, 10.0, 10.0, "overpass", 9.0), (5, 100.0, 100.0, "road", 29.0), (6, None, 10.0, "road", 5.0), (7, 10.0, 0.0, "road", 5.0), (8, 10.0, 10.0, "road", None)]
    edges = spark.createDataFrame([r[:4] for r in rows], "id long, length double, base_m double, link_type string")
    covers = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4]], "id long, inside_m double")
    got = {r["id"]: (r["link_type"], r["orig_link_type"]) for r in polygons.stairs(edges, covers, ["id"]).collect()}
    assert {i for i, (k, _) in got.items() if k == "steps"} == {1, 6} and got[1][1] == "sidewalk" and got[4] == ("overpass", None)


def test_blocked_sights_equal_all_pairs(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(12):
        cx, cy = rng.uniform(0, 200), rng.uniform(0, 200)
        shapes.append((i, [[(cx + a, cy + b) for a, b in ((-9, -6), (8, -7), (10, 9), (-7, 8))]]))
    walls = [tuple(rng.uniform(0, 200) for _ in range(4)) for _ in range(8)] + [(10.0, 10.0, 10.0, 10.0), (40.0, 0.0, 40.0, 200.0)]
    sights = [(i, *(rng.uniform(0, 200) for _ in range(4))) for i in range(120)]
    sights += [(200 + i, *[c + rng.uniform(-4, 4) for c in shapes[i % 12][1][0][0]], *(rng.uniform(0, 200) for _ in range(2))) for i in range(24)] + [(300, 5.0, 5.0, 5.0, 5.0)]
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    by_house, by_wall = set(), set()
    for i, x1, y1, x2, y2 in sights:
        a, b = (x1, y1), (x2, y2)
        for _, rings in shapes if a != b else ():
            if not inside(rings, *a) and not inside(rings, *b) and any(inside(rings, x1 + (x2 - x1) * k / 4000, y1 + (y2 - y1) * k / 4000) for k in range(4001)):
                by_house.add(i)
        for u1, v1, u2, v2 in walls:
            c, d = (u1, v1), (u2, v2)
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                by_wall.add(i)
    lines, houses = spark.createDataFrame(sights, SEGS), spark.createDataFrame([shape(i, r) for i, r in shapes], SHAPES)
    barriers = spark.createDataFrame(walls, "x1 double, y1 double, x2 double, y2 double")
    keys = lambda df: {r["id"] for r in df.collect()}
    for cell in (7.0, 30.0):
        assert keys(polygons.blocked(lines, ["id"], walls=barriers, cell=cell)) == by_wall
        assert keys(polygons.blocked(lines, ["id"], houses, barriers, cell)) == by_house | by_wall
    assert by_house - by_wall and keys(polygons.blocked(lines, ["id"])) == set()
