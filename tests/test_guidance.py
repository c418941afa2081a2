import random

from pyspark.sql import functions as F

from stepfree.operators import graph, guidance, routing


def test_maneuvers():
    assert [guidance.maneuver(a) for a in (0, 19, 30, -30, 90, -90, 130, 170)] == ["straight", "straight", "slight_right", "slight_left", "right", "left", "sharp_right", "uturn"]
    assert guidance.turn_between(350, 10) == 20


def test_steps_fold():
    def f(*a):
        *steps, last = guidance.fold_steps(*a)
        assert last == ("arrive", None, 0.0)
        return steps

    assert f([50, 50], [0, 5], ["road", "road"]) == [("depart", "road", 100)]
    assert f([50, 50], [0, 90], ["road", "road"]) == [("depart", "road", 50), ("right", "road", 50)]
    # two bends of 45 degrees with a short link between are one turn
    assert f([50, 6, 50], [0, 45, 90], ["road"] * 3) == [("depart", "road", 56), ("right", "road", 50)]
    # two turns to the same side add up and keep their side; left and right cancel each other
    assert f([50, 8, 50], [0, 120, 240], ["road"] * 3) == [("depart", "road", 58), ("sharp_right", "road", 50)]
    assert f([50, 8, 50], [0, -120, -240], ["road"] * 3) == [("depart", "road", 58), ("sharp_left", "road", 50)]
    assert f([50, 8, 50], [0, 90, 0], ["road"] * 3) == [("depart", "road", 108)]
    assert f([50, 8, 50], [0, 100, 200], ["road"] * 3) == [("depart", "road", 58), ("uturn", "road", 50)]
    # special links are steps of their own and announce no turn; short links behind them join
    assert f([50, 8, 8, 50], [0, 0, 0, 0], ["sidewalk", "crossing", "crossing", "sidewalk"]) == [("depart", "sidewalk", 50), ("crossing", "crossing", 8), ("crossing", "crossing", 8), ("straight", "sidewalk", 50)]
    assert f([50, 20, 4, 20, 50], [0, 90, 90, 90, 180], ["sidewalk", "crossing", "sidewalk", "elevator", "underpass"]) == [("depart", "sidewalk", 50), ("crossing", "crossing", 24), ("elevator", "elevator", 20), ("right", "underpass", 50)]
    # a link that bends is left in the direction of its end
    assert f([50, 50], [0, 90], ["road"] * 2, [90, 90]) == [("depart", "road", 100)]
    assert guidance.fold_steps([], [], []) == []


def test_steps_cover_the_route(spark):
    links = spark.createDataFrame([(t, i, 10.0 + i, float(i * 40 % 360), "road") for t in (1, 2) for i in range(6)], "trip long, pos int, length double, bearing double, link_type string")
    got = guidance.steps(links).groupBy("trip").agg(F.sum("distance_m").alias("m"), F.max("idx").alias("n")).collect()
    assert {(r["trip"], r["m"]) for r in got} == {(1, 75.0), (2, 75.0)}


def test_landmarks_keep_their_distance(spark):
    rng = random.Random(2)
    rows = [(1, rng.random() * 3000, rng.randrange(3), rng.random() * 40, i) for i in range(200)]
    got = [r["id"] for r in guidance.landmarks(spark.createDataFrame(rows, "route_id long, position_m double, tier int, offset_m double, id long")).orderBy("idx").collect()]
    at = {r[4]: r for r in rows}
    chosen = [at[i] for i in got]
    assert all(b[1] - a[1] >= guidance.LANDMARK_GAP_M for a, b in zip(chosen, chosen[1:], strict=False))
    cursor = -1e9
    for c in chosen:
        first = min(r[1] for r in rows if r[1] >= cursor + guidance.LANDMARK_GAP_M)
        window = [r for r in rows if first <= r[1] <= first + guidance.LANDMARK_WINDOW_M]
        assert (c[2], c[3]) == min((r[2], r[3]) for r in window)
        cursor = c[1]
    assert guidance.thin([], [], [], []) == []


def test_turning_back_is_avoided_where_there_is_another_way(spark):
    # 1-2-3 doubles back at 2; 1-4-5-3 is longer but does not
    schema = "u long, v long, length double, slope double, link_type string, width double, curb_cut boolean, link_name string, topo_source string, confidence double"
    rows = [(1, 2, 50.0), (2, 3, 50.0), (1, 4, 40.0), (4, 5, 25.0), (5, 3, 40.0)]
    edges = spark.createDataFrame([(u, v, m, 0.0, "sidewalk", 2.0, True, None, None, None) for u, v, m in rows], schema)
    nodes = spark.createDataFrame([(1, 37.0, 127.0), (2, 37.001, 127.0), (3, 37.0002, 127.0001), (4, 37.0, 127.0005), (5, 37.0002, 127.0005)], "node_id long, lat double, lng double")
    trips = spark.createDataFrame([(0, 1, 3)], "trip long, start long, goal long")
    walk = graph.PROFILES["walk"]
    assert routing.plan(edges, trips, walk).first()["path"] == [1, 2, 3]
    assert routing.plan(edges, trips, walk, nodes=nodes).first()["path"] == [1, 4, 5, 3]


def all_paths(links, start, goal, seen=()):
    """Every path without repeated nodes, as a list of links."""
    if start == goal:
        yield []
    for e, (u, v) in enumerate(links):
        for a, b in ((u, v), (v, u)):
            if a == start and b not in seen and b != start:
                for rest in all_paths(links, b, goal, (*seen, start)):
                    yield [e, *rest]


def test_alternatives_and_turns_equal_search_of_all_paths(spark):
    rng = random.Random(12)
    schema = "u long, v long, length double, slope double, link_type string, width double, curb_cut boolean, link_name string, topo_source string, confidence double"
    walk = graph.PROFILES["walk"]
    turned = 0
    for round_ in range(4):
        links = sorted({tuple(sorted(rng.sample(range(7), 2))) for _ in range(12)})
        at = {i: (37 + rng.random() / 1000, 127 + rng.random() / 1000) for i in range(7)}
        rows = [(u, v, 20 + 100 * rng.random(), 0.0, "sidewalk", 2.0, True, "x", None, None) for u, v in links]
        edges = spark.createDataFrame(rows, schema)
        nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "node_id long, lat double, lng double")
        weight = {(r["u"], r["v"]): r["c"] for r in edges.select("u", "v", graph.cost(walk).alias("c")).collect()}
        trips = [(10 * a + b, a, b) for a in range(7) for b in range(7)] + [(99, None, 1)]
        df = spark.createDataFrame(trips, "trip long, start long, goal long")

        def cheapest(paths, extra):
            return min(paths, key=lambda p: sum(weight[links[e]] * (2.5 if e in extra else 1) for e in p), default=None)

        def nodes_of(start, path):
            out = [start]
            for e in path:
                u, v = links[e]
                out.append(v if out[-1] == u else u)
            return out

        def turns(start, path):
            p = nodes_of(start, path)
            h = [routing.heading(*at[a], *at[b]) for a, b in zip(p, p[1:], strict=False)]
            return {e for i in range(1, len(h)) if abs(guidance.turn_between(h[i - 1], h[i])) >= 150 for e in (path[i - 1], path[i])}

        want, straight = {}, {}
        for trip, a, b in trips[:-1]:
            paths = list(all_paths(links, a, b)) if a != b else []
            if not paths:
                continue
            own, used = [cheapest(paths, ())], set()
            while len(own) < 3:
                used |= set(own[-1])
                new = cheapest(paths, used)
                if new in own:
                    break
                own.append(new)
            want |= {(trip, i): nodes_of(a, p) for i, p in enumerate(own)}
            best, extra = own[0], set()
            for _ in range(3):
                if not turns(a, best):
                    break
                extra |= turns(a, best)
                new = cheapest(paths, extra)
                if new == best or len(turns(a, new)) >= len(turns(a, best)):
                    break
                best = new
            straight[trip] = nodes_of(a, best)
            turned += best != own[0]
        assert {(r["trip"], r["alternative"]): r["path"] for r in routing.plan(edges, df, walk, 3).collect()} == want
        assert {r["trip"]: r["path"] for r in routing.plan(edges, df, walk, nodes=nodes).collect()} == straight
    assert turned


def test_summary(spark):
    schema = "u long, v long, length double, slope double, link_type string, curb_cut boolean"
    edges = spark.createDataFrame([(1, 2, 100.0, 2.0, "sidewalk", None), (2, 3, 20.0, 1.0, "crossing", False), (3, 4, 30.0, 6.0, "ramp", None), (4, 5, 10.0, 0.0, "elevator", None)], schema)
    routes = spark.createDataFrame([(1, 0, [1, 2, 3]), (2, 0, [5, 4, 3, 2]), (3, 0, [1, 2])], "trip long, alternative int, path array<long>")
    p = graph.PROFILES["wheelchair_manual"]  # 4 degrees, 0.7 m/s
    got = {r["trip"]: r for r in routing.summary(routes, edges, p).collect()}
    assert round(got[1]["score"], 6) == round(0.6 * (1 - 2 / 4) + 0.4 - 0.05, 6) and got[1]["warnings"] == 1 and got[1]["crossings"] == 1
    assert round(got[1]["duration_s"], 6) == round(120 / 0.7, 6)
    assert round(got[2]["score"], 6) == round(0.4 - 0.1, 6) and (got[2]["ramps"], got[2]["elevators"], got[2]["warnings"]) == (1, 1, 2)
    poor = {r["trip"]: r for r in routing.summary(routes, edges, p, 0.2).collect()}
    assert round(got[3]["score"], 6) == 0.7 and poor[3]["score"] == 0.6 and poor[3]["warnings"] == 1


def test_steps_of_routes_equal_those_of_their_links(spark):
    """Both directions, links between the same nodes, and links that are not there."""
    import random

    from stepfree.operators import routing

    rng = random.Random(6)
    nodes = spark.createDataFrame([(i, 37.3 + i // 10 * 0.0002 + rng.random() * 0.0001, 126.8 + i % 10 * 0.0002 + rng.random() * 0.0001) for i in range(99)], "node_id long, lat double, lng double")
    pairs = [(i, j) for i in range(100) for j in (i + 1, i + 10) if j < 100 and (j - i == 10 or j % 10)]
    edges = spark.createDataFrame([(u, v, rng.uniform(3, 40), rng.choice(["sidewalk", "road", "crossing", None])) if u % 2 else (v, u, 15.0, "steps") for u, v in pairs], "u long, v long, length double, link_type string")
    near = {}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    paths = []
    for trip in range(60):
        path = [rng.randrange(100)]
        while len(path) < 12:
            path.append(rng.choice(near[path[-1]]))
        paths.append((trip, 0, path))
    routes = spark.createDataFrame([*paths, (70, 0, [5, 77, 78])], "trip long, alternative int, path array<long>")
    key = lambda rows: sorted((r["trip"], r["idx"], r["maneuver"], str(r["link_type"]), round(r["distance_m"], 9)) for r in rows)
    want = key(guidance.steps(guidance.with_bearings(routing.path_links(routes), edges, nodes)).collect())
    assert key(guidance.steps_of_routes(routes, edges, nodes).collect()) == want and len(want) > 300
