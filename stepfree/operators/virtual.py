"""Starting and ending a route in the middle of a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.geo import segment_projection

END_M = 1.0  # closer to an end than this, the end itself is taken


def attach(points: DataFrame, segments: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(places, links) for points (key, lat, lng, u, v) that lie on known links.

    places: key, node (the end, or null for a new one), t. links: key, end, length, orig_length and the link's other
    attributes, for new places only: one to each end. The originals stay, so that other routes are not cut; rules that look
    at a link's length use orig_length, as the slope was measured over the whole link.
    """
    rows = points.join(segments, ["u", "v"])
    t, _ = segment_projection(*map(F.col, ("lat", "lng", "lat1", "lng1", "lat2", "lng2")), lat0=F.col("lat"))
    rows = rows.withColumn("t", t)
    node = F.when(F.col("t") * F.col("length") < END_M, F.col("u")).when((1 - F.col("t")) * F.col("length") < END_M, F.col("v"))
    rows = rows.withColumn("node", node)
    places = rows.select(key, "node", "t")
    whole = F.coalesce(F.col("orig_length"), F.col("length")) if "orig_length" in segments.columns else F.col("length")
    rest = [c for c in segments.columns if c not in ("u", "v", "lat1", "lng1", "lat2", "lng2", "length", "orig_length")]
    parts = F.explode(F.array(F.struct(F.col("u").alias("end"), (F.col("t") * F.col("length")).alias("length")), F.struct(F.col("v").alias("end"), ((1 - F.col("t")) * F.col("length")).alias("length"))))
    links = rows.where("node is null").select(key, parts.alias("p"), whole.alias("orig_length"), *rest)
    return places, links.select(key, "p.end", "p.length", "orig_length", *rest)
