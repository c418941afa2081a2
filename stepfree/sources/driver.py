"""The benchmark's tables seen as the domain's relations.

Each view is written once, in SQL that Spark and DuckDB read alike, so that a query and the SQL it is compared with start
from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WIDTH = 40  # nodes in a row of the street lattice


def _grid(key: str, a: int, b: int) -> str:
    return f"cast(37.30 as double) + ({key} * {a} % 2000) * cast(0.0001 as double) AS lat, cast(126.80 as double) + ({key} * {b} % 2000) * cast(0.0001 as double) AS lng"


_FLAG = "CASE {} % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END"
_KIND = "CASE s_suppkey % 4 WHEN 0 THEN 'braille_lib' WHEN 1 THEN 'booknarae_lib' WHEN 2 THEN 'sports_fac' ELSE 'sports_org' END"
_LINK = "CASE p_type WHEN 'STANDARD' THEN 'sidewalk' WHEN 'ECONOMY' THEN 'road' WHEN 'MEDIUM' THEN 'crossing' WHEN 'PROMO' THEN 'steps' WHEN 'LARGE' THEN 'ramp' ELSE 'unknown' END"
_EDGE = (
    f"10.0D0 + ((7 * u + 3 * v) % 40) AS length, cast(p_size % 12 as double) AS slope, {_LINK} AS link_type, CASE WHEN p_size % 5 <> 0 THEN cast(0.7 as double) + (p_size % 9) * cast(0.2 as double) END AS width,"
    " CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS curb_cut, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_brand END AS link_name,"
    " CASE WHEN p_size % 11 = 0 THEN 'derived' ELSE 'base' END AS topo_source, CASE WHEN p_size % 11 = 0 THEN cast(0.4 as double) + (p_size % 6) * cast(0.1 as double) END AS confidence"
).replace("10.0D0", "cast(10 as double)")

VIEWS = {
    "poi": f"SELECT s_suppkey AS poi_id, s_name AS name, s_nationkey AS region, {_KIND} AS kind, {_grid('s_suppkey', 7919, 104729)} FROM supplier",
    "origin": f"SELECT c_custkey AS id, c_name AS name, c_nationkey AS region, {_grid('c_custkey', 6151, 15485863)} FROM customer",
    "facility": f"SELECT p_partkey AS fac_id, p_name AS name, p_type AS type, p_brand AS note, {_FLAG.format('p_size')} AS ramp_yn, {_FLAG.format('(p_size + p_partkey)')} AS elevator_yn, {_FLAG.format('p_partkey')} AS toilet_yn, {_grid('p_partkey', 7907, 104711)} FROM part",
    "route_station": "SELECT DISTINCT l_orderkey AS route_id, l_linenumber AS seq, l_suppkey AS stop_id FROM lineitem",
    "route": "SELECT o_orderkey AS route_id, o_orderpriority AS type, CASE o_orderstatus WHEN 'O' THEN 'N' WHEN 'F' THEN 'Y' END AS low_bus_yn, cast(o_orderdate AS date) AS base_dt FROM orders",
    "node": f"SELECT p_partkey AS node_id, cast(37.30 as double) + (p_partkey - p_partkey % {WIDTH}) / {WIDTH} * cast(0.0002 as double) AS lat, cast(126.80 as double) + (p_partkey % {WIDTH}) * cast(0.0002 as double) + (p_size % 7) * cast(0.00001 as double) AS lng, p_size FROM part",
    "edge": f"SELECT u, v, {_EDGE} FROM (SELECT p_partkey AS u, p_partkey + 1 AS v, p_size, p_type, p_brand FROM part WHERE p_partkey % {WIDTH} <> {WIDTH - 1} UNION ALL SELECT p_partkey AS u, p_partkey + {WIDTH} AS v, p_size + 5 AS p_size, p_type, p_brand FROM part) e WHERE v IN (SELECT p_partkey FROM part)",
    "track": "SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, value AS off_m, cast(37.30 as double) + (event_id * 31 % 500) * cast(0.0001 as double) AS lat, cast(126.80 as double) + (event_id * 17 % 500) * cast(0.0001 as double) AS lng FROM events",
    "request": "SELECT event_id, ts, event_type AS path, value * 100 AS ms, CASE WHEN event_id % 10 = 0 THEN 500 WHEN event_id % 10 = 1 THEN 404 ELSE 200 END AS status FROM events",
    "report": "SELECT event_id AS report_id, user_id, event_type AS reason, ts, value, event_id * 31 % 2000 AS cell FROM events",
    "vehicle": "SELECT l_orderkey AS route_id, l_linenumber AS seq, l_partkey AS veh_id, CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS low_floor, cast(l_quantity * 30 AS int) AS predict_sec, CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'R' THEN 'STOP' ELSE 'RUN' END AS flag FROM lineitem",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def broadcast_by_measure(spark: SparkSession) -> None:
    """Lets joins broadcast a side by its measured size only, up to the session's own threshold.

    The tables' keys take a byte or two a row in their files, so estimates from files call tables small that don't fit the driver once they are read,
    copied to cells or to salts.
    """
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if most != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


#: Bytes of a file, and of a shuffle, that a task takes at most; and of input for each partition of a shuffle.
READ_BYTES, TASK_BYTES, INPUT_BYTES = 32 << 20, 8 << 20, 16 << 20


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)(?:i?b)?", text.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def small_tasks(spark: SparkSession, sf_dir: str) -> None:
    """Bounds what one task takes, so that its memory doesn't grow with the tables; smaller settings of the session stay.

    The keys shrink to a byte or two a row in files and shuffles, so the usual sizes of tasks, which are of bytes there, hold many millions of rows
    in memory. The number of partitions of a shuffle grows with the tables; small ones are put together by Spark.
    """
    for key, most in (("spark.sql.files.maxPartitionBytes", READ_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)):
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if size // INPUT_BYTES > least:
        spark.conf.set(key, str(size // INPUT_BYTES))


class Domain:
    """Views over one folder of tables; each attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        broadcast_by_measure(spark)
        small_tasks(spark, sf_dir)
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in _BASE:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        sql = VIEWS[name]
        used = {t: self.__getattr__(t) for t in _BASE if f" {t}" in sql.replace("(", " ").replace(")", " ")}
        for t in used:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self._spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """DuckDB text: the views that the query names, then the query."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
        return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"
