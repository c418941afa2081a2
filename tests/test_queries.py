"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from stepfree import registry
from stepfree.streaming import tracks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float) and not isinstance(x, bool):
        return None if math.isnan(x) else round(x, 6)
    return x if x is None or isinstance(x, (bool, int)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)


def test_stream_of_several_batches_keeps_first_writes(spark, tmp_path, tmp_path_factory):
    rows = [[(1, "2024-01-01 00:00:00", 1, "a", 1.0, ""), (2, "2024-01-01 00:01:00", 1, "a", 2.0, "")], [(2, "2024-01-01 00:01:00", 1, "a", 9.0, ""), (3, "2023-01-01 00:00:00", 2, "a", 3.0, "")], [(1, "2024-01-01 00:00:00", 1, "a", 7.0, "")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    def stream():
        read = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        return read.parquet(str(tmp_path)).select("event_id", "user_id", "value")

    folder = str(tmp_path_factory.mktemp("first-writes"))
    got = tracks.first_writes(stream(), ["event_id"], "value", folder).collect()
    assert sorted(r["event_id"] for r in got) == [1, 2, 3]
    # a restart in the same folder reads only what is new, and knows what it has seen
    more = spark.createDataFrame([(3, 9, 9.0), (4, 9, 4.0)], "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "user_id", "'a' event_type", "value", "'' props")
    more.coalesce(1).write.parquet(str(tmp_path / "f9"))
    again = {r["event_id"]: r["value"] for r in tracks.first_writes(stream(), ["event_id"], "value", folder).collect()}
    assert again == {r["event_id"]: r["value"] for r in got} | {4: 4.0}


def test_hourly_stream_equals_batch(spark, tmp_path):
    stream = tracks.read_events(spark, SF, "events.parquet")
    got = {(r["w"]["start"], r["event_type"]): r["n"] for r in tracks.collected(tracks.hourly(stream), str(tmp_path)).collect()}
    from pyspark.sql import functions as F

    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count().collect()
    assert got == {(r["w"]["start"], r["event_type"]): r["count"] for r in want}
