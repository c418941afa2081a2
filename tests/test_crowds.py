"""Many rows at few places: results equal the SQL, and rows at one place are not paired with each other."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from stepfree import registry
from stepfree.operators import spatial

from .test_queries import SF, TABLES, plain

#: Keys that places are made from; they repeat every 2,000.
KEYS = {"customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "lineitem": ("l_suppkey",)}
NAMES = """jn08_radius_topk win01_per_type_topn win02_fallback_topn agg09_count_per_type jn15_nearest_within set01_priority_union jn12_overlay_assignment flt17_charger_hint
  jn14_same_place jn20_attach_to_nearest tr12_access_points jn23_contains_else_nearest tr06_radius_expansion set03_subway_candidates tr01_candidates""".split()


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Four rows at each place, and lines that call at other copies than their first."""
    folder, c = str(tmp_path_factory.mktemp("crowds")), duckdb.connect()
    for t in TABLES:
        rows, keys = f"'{SF}/{t}.parquet'", KEYS.get(t, ())
        if t == "lineitem":
            c.execute(f"copy (select * replace (l_suppkey + l_orderkey % 4 * 2000 as l_suppkey) from {rows}) to '{folder}/{t}.parquet'")
        elif keys:
            new = ", ".join(f"{k} + i * 2000 as {k}" for k in keys)
            c.execute(f"copy (select * replace ({new}{f', s_name || i as s_name' if t == 'supplier' else ''}) from {rows}, range(4) r(i)) to '{folder}/{t}.parquet'")
        else:
            c.execute(f"copy (from {rows}) to '{folder}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return folder, c


@pytest.mark.parametrize("name", NAMES)
def test_crowds_equal_sql(spark, crowded, name):
    folder, duck = crowded
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)


def test_a_crowd_at_two_places_makes_no_pairs_of_rows(spark):
    left = spark.range(60_000).select("id", (F.col("id") % 2 * 0.001 + 37.0).alias("lat"), F.lit(127.0).alias("lng"))
    right = spark.range(60_000).select(F.col("id").alias("poi"), (F.col("id") % 2 * 0.001 + 37.0).alias("r_lat"), F.lit(127.0).alias("r_lng"), (F.col("id") % 3).alias("kind"))
    began = time.perf_counter()
    got = spatial.nearest_places(left, right, 500, ["poi"], 2, kinds=("kind",)).where("id < 2").select("id", "kind", "poi", "rank").collect()
    assert time.perf_counter() - began < 60  # 3.6 thousand million pairs of rows
    assert sorted(map(tuple, got)) == sorted((i, k, p, n + 1) for i in range(2) for k in range(3) for n, p in enumerate([p for p in range(i, 60_000, 2) if p % 3 == k][:2]))


def test_nearest_places_equal_brute_force(spark):
    left = [(i, (37.0 + i % 7 * 0.0004) if i % 11 else None, 127.0 + i % 5 * 0.0005) for i in range(60)]
    right = [(i, 37.0 + i % 9 * 0.0003, (127.0 + i % 4 * 0.0006) if i % 13 else None, "ab"[i % 2] if i % 17 else None) for i in range(90)]
    l, r = spark.createDataFrame(left, "id long, lat double, lng double"), spark.createDataFrame(right, "poi long, r_lat double, r_lng double, kind string")
    pairs = l.crossJoin(r).withColumn("d", spatial.haversine(*map(F.col, ("lat", "lng", "r_lat", "r_lng")))).where("d <= 90").collect()
    for digits in (None, 0, -2):
        want = []
        for i, kind in {(p["id"], p["kind"]) for p in pairs}:
            own = sorted((p["d"] if digits is None else round(p["d"], digits), p["poi"]) for p in pairs if (p["id"], p["kind"]) == (i, kind))
            want += [(i, kind or "", poi, n + 1) for n, (_, poi) in enumerate(own[:3])]
        got = spatial.nearest_places(l, r, 90, ["poi"], 3, digits, ("kind",)).select("id", F.coalesce("kind", F.lit("")), "poi", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert spatial.nearest_places(l, r, 90, ["poi"], how="left").select("id").distinct().count() == 60
