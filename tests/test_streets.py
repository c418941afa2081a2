import random

import pytest
from pyspark.sql import functions as F

from stepfree.operators import graph, routing, spatial

SCHEMA = "u long, v long, length double, slope double, link_type string, width double, curb_cut boolean, link_name string, topo_source string, confidence double"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (10 - len(r))) for r in rows], SCHEMA)


def diamond(spark, slope=1.0):
    return edges(spark, (1, 2, 100.0, slope, "sidewalk", 2.0, True), (2, 3, 100.0, slope, "sidewalk", 2.0, True), (1, 4, 60.0, 2.0, "steps", 1.2), (4, 3, 60.0, 9.0, "sidewalk", 1.2))


def plan(spark, df, profile, start=1, goal=3, n=1):
    trips = spark.createDataFrame([(0, start, goal)], "trip long, start long, goal long")
    return routing.plan(df, trips, profile, n).orderBy("alternative").collect()


def test_profiles_choose_their_way(spark):
    assert plan(spark, diamond(spark), "wheelchair_manual")[0]["path"] == [1, 2, 3]
    assert plan(spark, diamond(spark), "walk")[0]["path"] == [1, 4, 3]
    assert [r["path"] for r in plan(spark, diamond(spark), "walk", n=3)] == [[1, 4, 3], [1, 2, 3]]


def test_the_limit_relaxes_only_when_it_must(spark):
    assert plan(spark, diamond(spark, 5.0), "wheelchair_manual")[0]["relaxed"] == 0
    assert plan(spark, diamond(spark, 9.0), "wheelchair_manual")[0]["relaxed"] == 2
    assert plan(spark, diamond(spark, 13.0), "wheelchair_manual") == []
    assert plan(spark, diamond(spark), "walk", 1, 1) == []
    assert plan(spark, diamond(spark), "walk", 1, 99) == []


def test_passability_cases(spark):
    p = graph.PROFILES["wheelchair_manual"]
    rows = [
        ((8.0, 12.0, "sidewalk"), True), ((15.0, 12.0, "sidewalk"), False), ((50.0, 1.0, "steps"), False), ((50.0, 1.0, "sidewalk", 0.8), False), ((50.0, 1.0, "sidewalk", None), True),
        ((50.0, 1.0, "crossing", 2.0, False), False), ((50.0, 1.0, "crossing", 2.0, None), True), ((50.0, 1.0, "road", 2.0, None, None, "derived", 0.5), False), ((50.0, 1.0, "road", 2.0, None, None, "derived", 0.6), True), ((50.0, 1.0, "road", 2.0, None, None, "base", 0.1), True),
    ]
    df = edges(spark, *[(i, i + 100, *r) for i, (r, _) in enumerate(rows)])
    got = {r["u"]: r["ok"] for r in df.select("u", graph.passable(df, p).alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(rows)}
    blocked = df.withColumn("blocked", F.lit(True))
    assert blocked.where(graph.passable(blocked, p)).count() == 0


def test_costs_from_one_and_batch_routes_agree_on_random_graphs(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(18), 2))) for _ in range(34)}
    df = edges(spark, *[(u, v, float(rng.randrange(10, 90)), float(rng.randrange(8)), rng.choice(["sidewalk", "road", "crossing"]), 2.0, True, rng.choice(["", "x", None])) for u, v in pairs])
    p = graph.PROFILES["wheelchair_electric"]
    costs = {r["node"]: r["cost"] for r in graph.costs_from(df, 0, p).collect()}
    trips = spark.range(1, 18).select(F.col("id").alias("trip"), F.lit(0).cast("long").alias("start"), F.col("id").alias("goal"))
    routes = {r["trip"]: r["cost"] for r in routing.plan(df, trips, p).where("relaxed = 0").collect()}
    assert routes.keys() == costs.keys() - {0}
    assert all(routes[k] == pytest.approx(costs[k]) for k in routes)
    part = {r["node_id"] for r in graph.largest_component(df, p).collect()}
    assert costs.keys() <= part or not costs.keys() & part


def test_detours_and_slopes(spark):
    df = edges(spark, (1, 2, 10.0, 0.0, "sidewalk"), (2, 3, 10.0, 0.0, "sidewalk"), (3, 4, 10.0, 0.0, "sidewalk"))
    nodes = spark.createDataFrame([(1, 37.39, 126.95), (2, 37.39005, 126.95009), (3, 37.39, 126.9501), (4, 37.4, 127.0)], "node_id long, lat double, lng double")
    assert [(r["a"], r["m"], r["b"]) for r in graph.detours(df, nodes).collect()] == [(1, 2, 3)]
    z = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, None)], "node_id long, elev double")
    got = {r["u"]: r["slope"] for r in graph.slopes(df, z).collect()}
    assert got[1] == pytest.approx(45) and got[2] == got[3] == 0


def test_radius_join_equals_the_cross_join(spark):
    rng = random.Random(9)
    point = lambda: (37 + rng.random() * 0.05, 127 + rng.random() * 0.05)
    a = spark.createDataFrame([(i, *point()) for i in range(120)] + [(999, None, None)], "id long, lat double, lng double")
    b = spark.createDataFrame([(i, *point()) for i in range(120)] + [(999, None, 127.0)], "rid long, r_lat double, r_lng double")
    from stepfree.functions.geo import haversine

    plain = a.crossJoin(b).withColumn("d", haversine(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng")))
    for radius in (50, 400, 3000):
        want = {(r["id"], r["rid"]) for r in plain.where(F.col("d") <= radius).collect()}
        rows = [(r["id"], r["rid"]) for r in spatial.radius_join(a, b, radius).collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_virtual_links_join_a_place_to_both_ends(spark):
    from stepfree.operators import virtual

    links = spark.createDataFrame([(1, 2, 37.0, 127.0, 37.0, 127.002, 200.0, 3.0)], "u long, v long, lat1 double, lng1 double, lat2 double, lng2 double, length double, slope double")
    points = spark.createDataFrame([(10, 37.0001, 127.0005, 1, 2), (11, 37.0, 127.0, 1, 2), (12, 37.0, 127.003, 1, 2)], "id long, lat double, lng double, u long, v long")
    places, parts = virtual.attach(points, links)
    assert {r["id"]: r["node"] for r in places.collect()} == {10: None, 11: 1, 12: 2}
    got = {r["end"]: r for r in parts.collect()}
    assert got.keys() == {1, 2} and got[1]["length"] == pytest.approx(50) and got[2]["length"] == pytest.approx(150)
    assert all(r["orig_length"] == 200 and r["slope"] == 3 and r["id"] == 10 for r in got.values())
