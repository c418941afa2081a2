"""Writes as transformations: upserts, inserts that ignore repeats, states from reviews, checked photos, versioned saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHOTO_BYTES = 2 * 1024 * 1024


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; a column takes the new value unless that is null. New rows must have unique keys."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The new rows that are written: the first to arrive of each key that old lacks."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), arrival).alias("r")).select(*keys, "r.*")
    return first.select(*new.columns).join(old.select(*keys), keys, "left_anti")


def recount(meta: DataFrame, points: DataFrame, key: str, column: str = "point_cnt") -> DataFrame:
    counted = points.groupBy(key).agg(F.count("*").alias("_n"))
    return meta.drop(column).join(counted, key, "left").withColumn(column, F.coalesce("_n", F.lit(0))).drop("_n")


def photo_mime(encoded: Column) -> Column:
    """Type of a base64 photo by its first bytes, or null if it is not one, is damaged or too large."""
    body = F.regexp_replace(encoded, r"^data:[^,]*,", "")
    raw = F.try_to_binary(body, F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 12))
    kind = F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    return F.when(F.octet_length(raw) <= PHOTO_BYTES, kind)


def save_version(df: DataFrame, root: str, version: str) -> None:
    """Writes a version beside the others; Spark's commit makes it appear whole or not at all, and an existing one is an error."""
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={version}")


def load_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with true, false or blank for flags, and lists as comma-separated text."""
    out = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields]
    df.select(*out).write.option("header", True).option("emptyValue", "").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are left out."""
    df.write.mode("append").json(path)


def geojson_feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
