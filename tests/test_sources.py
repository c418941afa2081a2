import base64
import json

import pytest
from pyspark.sql import functions as F

from stepfree.operators import mutations
from stepfree.sources import readers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tabular_network(spark, tmp_path):
    nodes = write(tmp_path / "n.csv", "NODE_ID,X,Y,Node_Type\nA,126.9,37.3,x\nB,126.91,37.31,\nC,bad,37.3,\n")
    links = write(tmp_path / "l.csv", "LINK_ID,F_NODE,T_NODE,LENGTH,LINK_TYPE,WIDTH,ACCESSIBLE\n1,A,B,10,Sidewalk,1.5m,Y\n2,B,A,12,road,,N\n3,A,Z,5,road,,\n4,B,C,,,,?\n")
    n, e = readers.tabular(spark, nodes, links)
    assert {(r["node_id"], r["lng"]) for r in n.collect()} == {("A", 126.9), ("B", 126.91), ("C", None)}
    got = {(r["u"], r["v"]): r for r in e.collect()}
    assert got.keys() == {("A", "B"), ("B", "C")}
    assert (got["A", "B"]["length"], got["A", "B"]["link_type"], got["A", "B"]["curb_cut"]) == (12.0, "road", False)
    assert (got["B", "C"]["length"], got["B", "C"]["link_type"], got["B", "C"]["curb_cut"]) == (0.0, "unknown", None)


def test_parallel_links(spark):
    df = spark.createDataFrame([(1, 2, 5.0, 0), (2, 1, 3.0, 1), (1, 2, 3.0, 2), (2, 3, 1.0, 3)], "u long, v long, length double, at long")
    assert sorted((r["length"], r["at"]) for r in readers.shortest_parallels(df).collect()) == [(1.0, 3), (3.0, 1)]


def test_json_backends(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps([{"id": 1, "name": "x", "more": 2}, {"id": 2}], indent=1))
    write(tmp_path / "b.json", json.dumps({"items": [{"id": 3, "name": "y"}]}))
    schema = "id int, name string"
    read = lambda name, kind="file": [tuple(r) for r in readers.source(spark, kind, name, schema, str(tmp_path)).collect()]
    assert read("a") == [(1, "x"), (2, None)] and read("b") == [(3, "y")] and read("missing") == [] and read("a", "none") == []
    with pytest.raises(ValueError):
        read("a", "other")


def test_geojson_keys_and_sheets(spark, tmp_path):
    p = write(tmp_path / "g.json", json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [126.9, 37.3]}, "properties": {"w": 2.5}}, {"geometry": {"type": "LineString", "coordinates": []}, "properties": {}}]}))
    assert [tuple(r) for r in readers.geojson_points(spark, p, "w:double").collect()] == [(37.3, 126.9, 2.5)]
    k = write(tmp_path / "k.json", json.dumps({"p1": {"lat": 1.0, "note": "door"}}))
    assert [tuple(r) for r in readers.by_key(spark, k, "lat:double,note:string").collect()] == [("p1", 1.0, "door")]
    assert readers.by_key(spark, write(tmp_path / "bad.json", "[oops"), "lat:double").count() == 0
    files = spark.createDataFrame([("b_123456789_x.zip",), ("a_123456789_x.zip",), ("a_1_x.zip",)], "path string")
    assert [tuple(r) for r in readers.first_per_sheet(files).collect()] == [("123456789", "a_123456789_x.zip")]


def test_exchange_text(spark, tmp_path):
    g = write(tmp_path / "x.ngi", '<LAYER_START>\n$LAYER_NAME\n"ROAD"\n$END\n$RECORD 1\nLINESTRING\n2\n1.0 2.0\n3.0 4.0\n$RECORD 2\nPOINT\n1\n5 6\n<LAYER_END>\n')
    a = write(tmp_path / "x.nda", '<LAYER_START>\n$LAYER_NAME\n"ROAD"\n$END\n$RECORD 1\n"a, b", 7\n<LAYER_END>\n')
    got = {r["record"]: r for r in readers.exchange_text(spark, g, a).collect()}
    assert got[1]["points"] == [[1.0, 2.0], [3.0, 4.0]] and got[1]["attributes"] == ["a, b", "7"] and got[1]["layer"] == "ROAD"
    assert got[2]["attributes"] is None and got[2]["kind"] == "POINT"


def test_manual_links(spark):
    cols = "id string, from_node string, from_lat double, from_lng double, from_snap_m double, to_node string, to_lat double, to_lng double, to_snap_m double, width double, slope double"
    rows = [("a", "n", None, None, None, None, 37.0, 127.0, None, 1.0, 2.0), (None, "n", None, None, None, "m", None, None, None, None, None), ("c", None, 95.0, 127.0, None, "m", None, None, None, None, None), ("d", "n", None, None, None, None, 37.0, 127.0, -1.0, None, None), ("e", "n", None, None, None, "m", None, None, None, 0.0, None)]
    assert [r["error"] for r in readers.link_errors(spark.createDataFrame(rows, cols)).collect()] == [None, "no id", "bad start", "bad end", "bad width"]
    assert spark.range(1).select(readers.terrarium(F.lit(128), F.lit(10), F.lit(128))).first()[0] == 10.5


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id long, name string, x double")
    new = spark.createDataFrame([(1, None, 5.0), (3, "c", None)], "id long, name string, x double")
    assert sorted(map(tuple, mutations.upsert(old, new, ["id"]).collect())) == [(1, "a", 5.0), (2, "b", None), (3, "c", None)]
    points = spark.createDataFrame([(1, 0, "late", 9), (1, 0, "first", 3), (2, 0, "x", 1), (9, 9, "old", 1)], "route long, seq long, v string, at long")
    have = spark.createDataFrame([(9, 9, "kept", 0)], "route long, seq long, v string, at long")
    assert sorted(r["v"] for r in mutations.insert_ignore(have, points, ["route", "seq"], "at").collect()) == ["first", "x"]
    meta = spark.createDataFrame([(1, 0), (5, 7)], "route long, point_cnt long")
    assert sorted(tuple(r) for r in mutations.recount(meta, points, "route").collect()) == [(1, 2), (5, 0)]
    mutations.save_version(old, str(tmp_path / "g"), "r1")
    assert mutations.load_version(spark, str(tmp_path / "g"), "r1").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        mutations.save_version(old, str(tmp_path / "g"), "r1")
    mutations.export_csv(spark.createDataFrame([(True, ["a", "b"], None)], "ok boolean, l array<string>, n double").coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part*")).read_text().splitlines() == ["ok,l,n", 'true,"a,b",']
    mutations.append_log(spark.createDataFrame([("request", None, 5.0)], "kind string, path string, ms double"), str(tmp_path / "log"))
    mutations.append_log(spark.createDataFrame([("reroute", "p", None)], "kind string, path string, ms double"), str(tmp_path / "log"))
    lines = sorted(x for p in (tmp_path / "log").glob("part*") for x in p.read_text().splitlines())
    assert lines == ['{"kind":"request","ms":5.0}', '{"kind":"reroute","path":"p"}']


def test_photos(spark):
    jpeg = base64.b64encode(b"\xff\xd8\xff" + b"x" * 40).decode()
    big = base64.b64encode(b"\xff\xd8\xff" + b"x" * mutations.PHOTO_BYTES).decode()
    rows = [(0, jpeg), (1, "data:image/jpeg;base64," + jpeg), (2, "not base64!"), (3, big), (4, None), (5, base64.b64encode(b"GIF89a" + b"x" * 9).decode())]
    got = {r["i"]: r["m"] for r in spark.createDataFrame(rows, "i int, p string").select("i", mutations.photo_mime(F.col("p")).alias("m")).collect()}
    assert got == {0: "image/jpeg", 1: "image/jpeg", 2: None, 3: None, 4: None, 5: None}


def test_joins_of_the_views_are_broadcast_by_measured_sizes_only(spark):
    from pyspark.sql import functions as F

    from stepfree.sources.driver import Domain

    own = spark.newSession()  # a session of its own, as the settings stay
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "77777")
    d = Domain(own, "/root/testdata/sf0.01")
    Domain(own, "/root/testdata/sf0.01")
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "77777"
    copies = d.node.select(F.col("node_id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    plan = d.edge.join(copies, "u")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan.split("Join Inner")[0] and "SortMergeJoin" in plan


def test_tasks_are_small_and_smaller_settings_stay(spark, tmp_path):
    from stepfree.sources import driver

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "128MB")
        spark.conf.set(keys[1], "1m")
        (tmp_path / "lineitem.parquet").write_bytes(b"0" * (10 * driver.INPUT_BYTES))
        driver.Domain(spark, str(tmp_path))
        assert driver._bytes(spark.conf.get(keys[0])) == driver.READ_BYTES and spark.conf.get(keys[1]) == "1m"
        assert int(spark.conf.get(keys[2])) >= 10
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
