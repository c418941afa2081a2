"""Readers of the formats that networks and facilities come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepfree.functions.text import number, yes_no

# The columns that tabular networks use, by what they mean.
NODE_COLUMNS = {"node_id": ("node_id", "id"), "lng": ("x", "lon", "lng", "longitude"), "lat": ("y", "lat", "latitude"), "node_type": ("node_type", "type")}
LINK_COLUMNS = {"u": ("f_node", "from", "u"), "v": ("t_node", "to", "v"), "length": ("length", "len"), "link_type": ("link_type", "type"), "width": ("width",), "surface": ("surface",), "link_name": ("link_name", "name"), "curb_cut": ("accessible", "curb_cut"), "slope": ("slope",)}


def _pick(df: DataFrame, names: tuple) -> Column:
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`") for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def tabular(spark: SparkSession, node_path: str, link_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of CSV files with any of the known column names; links with unknown ends go, the last repeat stays."""
    nodes, links = (spark.read.option("header", True).csv(p) for p in (node_path, link_path))
    nodes = nodes.select(*[_pick(nodes, v).alias(k) for k, v in NODE_COLUMNS.items()])
    nodes = nodes.select(F.trim("node_id").alias("node_id"), number(F.col("lat")).alias("lat"), number(F.col("lng")).alias("lng"), "node_type")
    rows = links.select(*[_pick(links, v).alias(k) for k, v in LINK_COLUMNS.items()], F.monotonically_increasing_id().alias("at"))
    rows = rows.select("at", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.coalesce(number(F.col("length")), F.lit(0.0)).alias("length"), F.coalesce(F.lower("link_type"), F.lit("unknown")).alias("link_type"), number(F.col("width")).alias("width"), "surface", "link_name", yes_no(F.col("curb_cut")).alias("curb_cut"), F.coalesce(number(F.col("slope")), F.lit(0.0)).alias("slope"))
    known = nodes.select("node_id")
    rows = rows.join(known.withColumnRenamed("node_id", "u"), "u", "left_semi").join(known.withColumnRenamed("node_id", "v"), "v", "left_semi")
    return nodes, rows.groupBy("u", "v").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("u", "v", "at")]), "at").alias("r")).select("u", "v", "r.*")


def shortest_parallels(links: DataFrame) -> DataFrame:
    """One link for each pair of nodes: the shortest, of equal ones the first by ``at``."""
    ends = links.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    best = ends.groupBy("a", "b").agg(F.min_by(F.struct(*links.columns), F.struct("length", "at")).alias("r"))
    return best.select("r.*")


def json_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array of rows, or an object that has them under ``items``; a missing file is an empty table."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True)
    rows = f"array<{schema.simpleString()}>"
    parsed = raw.select(F.coalesce(F.from_json(F.get_json_object("value", "$.items"), rows), F.from_json("value", rows)).alias("r"))
    return parsed.select(F.explode("r").alias("r")).select("r.*")


def source(spark: SparkSession, backend: str, name: str, schema: str, root: str = "", jdbc: dict | None = None) -> DataFrame:
    """A logical table from the database, a folder of JSON files, or nowhere (then it is empty)."""
    if backend == "db":
        return spark.read.format("jdbc").options(**(jdbc or {}), dbtable=name).load()
    if backend == "file":
        return json_table(spark, f"{root.rstrip('/')}/{name}.json", schema)
    if backend == "none":
        return spark.createDataFrame([], schema)
    raise ValueError(f"unknown backend: {backend}")


def geojson_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features: lat, lng and the properties; features without coordinates go."""
    schema = f"struct<features:array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<{properties}>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    f = raw.select(F.explode("j.features").alias("f")).where("f.geometry.type = 'Point' and size(f.geometry.coordinates) >= 2")
    return f.select(F.element_at("f.geometry.coordinates", 2).alias("lat"), F.element_at("f.geometry.coordinates", 1).alias("lng"), "f.properties.*")


def by_key(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of rows by key: one row for each, with the key; a file that is not one gives nothing."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "r")).select("key", "r.*")


def first_per_sheet(files: DataFrame, path: str = "path", pattern: str = r"_(\d{9})_") -> DataFrame:
    """One file for each sheet number, the first path in sort order."""
    return files.withColumn("sheet", F.regexp_extract(path, pattern, 1)).where("sheet <> ''").groupBy("sheet").agg(F.min(path).alias(path))


def exchange_text(spark: SparkSession, geometry_path: str, attribute_path: str) -> DataFrame:
    """Layers of a text exchange format: (layer, record, kind, points, attributes), attributes joined to their geometry.

    A layer starts at <LAYER_START> and has its name between $LAYER_NAME and $END; records are ``$RECORD n``, then a kind, a
    number of points and as many lines ``x y``. Attribute records have one line of quoted comma-separated values.
    """
    import csv

    import pandas as pd

    def layers(text):
        for part in text.split("<LAYER_START>")[1:]:
            lines = [x.strip() for x in part.splitlines()]
            name = next((lines[i + 1].strip('"') for i, x in enumerate(lines[:-1]) if x.upper() == "$LAYER_NAME"), "")
            yield name, lines

    def geometries(batches):
        for b in batches:
            out = []
            for text in b["value"]:
                for layer, lines in layers(text):
                    at = [i for i, x in enumerate(lines) if x.upper().startswith("$RECORD ")]
                    for i in at:
                        kind, n = lines[i + 1].upper(), int(lines[i + 2])
                        points = [[float(v) for v in x.split()[:2]] for x in lines[i + 3 : i + 3 + n]]
                        out.append((layer, int(lines[i].split()[1]), kind, points))
            yield pd.DataFrame(out, columns=["layer", "record", "kind", "points"])

    def attributes(batches):
        for b in batches:
            out = []
            for text in b["value"]:
                for layer, lines in layers(text):
                    for i, x in enumerate(lines):
                        if x.upper().startswith("$RECORD "):
                            out.append((layer, int(x.split()[1]), next(csv.reader([lines[i + 1]], skipinitialspace=True))))
            yield pd.DataFrame(out, columns=["layer", "record", "attributes"])

    read = lambda p: spark.read.text(p, wholetext=True)
    geo = read(geometry_path).mapInPandas(geometries, "layer string, record long, kind string, points array<array<double>>")
    att = read(attribute_path).mapInPandas(attributes, "layer string, record long, attributes array<string>")
    return geo.join(att, ["layer", "record"], "left")


def terrarium(red: Column, green: Column, blue: Column) -> Column:
    """Elevation of a terrain tile's pixel."""
    return red * 256 + green + blue / 256 - 32768


def link_errors(links: DataFrame) -> DataFrame:
    """Manual links with what is wrong with each, or null: ends, coordinates, width and slope."""
    bad_end = lambda n: F.col(f"{n}_node").isNull() & ~(F.col(f"{n}_lat").between(-90, 90) & F.col(f"{n}_lng").between(-180, 180) & (F.coalesce(f"{n}_snap_m", F.lit(0.0)) >= 0)).eqNullSafe(True)
    error = F.when(F.col("id").isNull(), "no id").when(bad_end("from"), "bad start").when(bad_end("to"), "bad end").when(F.col("width") <= 0, "bad width").when(F.abs("slope") > 90, "bad slope")
    return links.withColumn("error", error)
