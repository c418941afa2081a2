"""How much of a line lies in polygons, exactly and without joining the polygons to one, and which lines of sight are blocked.

A segment's line crosses the edges of a polygon's rings an even number of times; by the even-odd rule it is inside between the first and
second crossing, the third and fourth, and so on. Clipped to the segment, these stretches of all polygons are merged by a window over
each segment, so what several polygons cover counts once. Coordinates are in a plane of metres. Segments meet the polygons whose boxes share a
cell with theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_M = 30.0
# Metres on stairs, declared by straight length at most, share on stairs at least; types that are avoided anyway.
LEAST_M, STRAIGHTNESS, LEAST_SHARE = 3.0, 1.15, 0.30
AVOIDED = ("steps", "overpass", "underpass")


def _side(p, q, r) -> Column:
    """Over zero if r is to the left of the line from p to q."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def _crossings(rings: Column, a: Column, b: Column) -> Column:
    """Where, from a at 0 to b at 1, the line through a and b crosses the rings' edges, in order. A corner on the line counts as right of it."""

    def of_ring(ring):
        n = F.size(ring)
        ends = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))

        def at(p, q):
            left, right = _side(a, b, p), _side(a, b, q)
            apart = (left > 0) != (right > 0)
            # the edge's point on the line, and how far along the line that is
            s = left / F.when(apart, left - right)
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            return F.when(apart, ((p["x"] + s * (q["x"] - p["x"]) - a["x"]) * dx + (p["y"] + s * (q["y"] - p["y"]) - a["y"]) * dy) / (dx * dx + dy * dy))

        return F.array_compact(F.zip_with(ring, ends, at))

    return F.sort_array(F.flatten(F.transform(rings, of_ring)))


def stretches(segs: DataFrame, polygons: DataFrame, key: list[str], cell: float = CELL_M) -> DataFrame:
    """key, polygon_id, s and e: the stretches of each segment (key, x1, y1, x2, y2), from 0 to 1, inside each polygon (polygon_id, rings, an array
    of arrays of struct<x, y>, closed or not)."""
    spans = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    own = segs.where("x1 <> x2 or y1 <> y2").withColumn("cx", spans(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("cy", spans(F.least("y1", "y2"), F.greatest("y1", "y2")))
    corners = F.flatten("rings")
    box = polygons.where(F.size(corners) > 2).withColumns({f"{f}_{c}": g(corners.getField(c)) for f, g in (("low", F.array_min), ("high", F.array_max)) for c in "xy"})
    box = box.withColumn("cx", spans(F.col("low_x"), F.col("high_x"))).withColumn("cy", spans(F.col("low_y"), F.col("high_y")))
    meet = (F.least("x1", "x2") <= F.col("high_x")) & (F.greatest("x1", "x2") >= F.col("low_x")) & (F.least("y1", "y2") <= F.col("high_y")) & (F.greatest("y1", "y2") >= F.col("low_y"))
    # a pair that shares several cells is met in the first of them
    first = (F.col("cx") == F.greatest(F.floor(F.least("x1", "x2") / cell), F.floor(F.col("low_x") / cell))) & (F.col("cy") == F.greatest(F.floor(F.least("y1", "y2") / cell), F.floor(F.col("low_y") / cell)))
    pairs = own.join(box, ["cx", "cy"]).where(meet & first)
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    pairs = pairs.withColumn("at", _crossings(F.col("rings"), a, b))
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    evens = F.filter("at", lambda t, i: i % 2 == 0)
    odds = F.filter("at", lambda t, i: i % 2 == 1)
    inside = F.zip_with(evens, odds, lambda s, e: F.struct(clip(s).alias("s"), clip(e).alias("e")))
    return pairs.select(*key, "polygon_id", F.explode(inside).alias("x")).select(*key, "polygon_id", "x.s", "x.e").where("e > s")


def covered(segs: DataFrame, polygons: DataFrame, key: list[str], cell: float = CELL_M) -> DataFrame:
    """key and inside_m: the metres of each segment inside any polygon, for those that are."""
    inside = stretches(segs, polygons, key, cell)
    w = Window.partitionBy(*key).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0.0))))
    share = inside.withColumn("new", new).groupBy(*key).agg(F.sum("new").alias("share"))
    length = segs.select(*key, F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length_m"))
    return share.join(length, key).select(*key, (F.col("share") * F.col("length_m")).alias("inside_m"))


def stairs(edges: DataFrame, covers: DataFrame, key: list[str], least: float = LEAST_M) -> DataFrame:
    """edges with on_stairs_m and orig_link_type; those become steps that lie on stairs for ``least`` metres and LEAST_SHARE of their line, unless their
    declared length says that the line is not straight, or they are avoided already.

    edges have length (declared), base_m (of the line that was looked at) and link_type; covers: key, inside_m.
    """
    rows = edges.join(covers, key, "left").withColumn("on_stairs_m", F.coalesce("inside_m", F.lit(0.0)))
    straight = F.coalesce(F.col("length") / F.when(F.col("base_m") > 0, F.col("base_m")) <= STRAIGHTNESS, F.col("base_m") > 0)
    found = (F.col("on_stairs_m") >= least) & (F.col("base_m") > 0) & straight & (F.col("on_stairs_m") >= LEAST_SHARE * F.col("base_m")) & ~F.col("link_type").isin(*AVOIDED)
    return rows.withColumn("orig_link_type", F.when(found, F.col("link_type"))).withColumn("link_type", F.when(found, "steps").otherwise(F.col("link_type"))).drop("inside_m")


def line_cells(segs: DataFrame, cell: float = CELL_M) -> DataFrame:
    """One row for each cell that a segment passes, column by column, so a long slanting one lies in few cells of its box."""
    dx = F.col("x2") - F.col("x1")
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    height = lambda cx, whole: F.col("y1") + (F.col("y2") - F.col("y1")) * F.when(dx == 0, F.lit(whole)).otherwise(clip((cx * cell - F.col("x1")) / F.when(dx != 0, dx)))
    columns = segs.withColumn("cx", F.explode(F.sequence(F.floor(F.least("x1", "x2") / cell), F.floor(F.greatest("x1", "x2") / cell))))
    a, b = height(F.col("cx"), 0.0), height(F.col("cx") + 1, 1.0)
    # a millionth to spare, as the heights are rounded
    return columns.withColumn("cy", F.explode(F.sequence(F.floor((F.least(a, b) - 1e-6) / cell), F.floor((F.greatest(a, b) + 1e-6) / cell))))


def blocked(sights: DataFrame, key: list[str], buildings: DataFrame | None = None, walls: DataFrame | None = None, cell: float = CELL_M) -> DataFrame:
    """The keys of sight lines (key, x1, y1, x2, y2) that pass a building (polygon_id, rings) or cross a wall (x1, y1, x2, y2).

    A building that holds either end does not block: what is in it must be left once. A line that touches a wall does not cross it, and one without length
    is never blocked.
    """
    found = []
    if buildings is not None:
        inside = stretches(sights, buildings, key, cell).groupBy(*key, "polygon_id").agg(F.min("s").alias("s"), F.max("e").alias("e"))
        found.append(inside.where("s > 0 and e < 1").select(*key))
    if walls is not None:
        there = line_cells(walls.select("x1", "y1", "x2", "y2").where("x1 <> x2 or y1 <> y2"), cell).withColumnsRenamed({"x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})
        pairs = line_cells(sights.where("x1 <> x2 or y1 <> y2"), cell).join(there, ["cx", "cy"])
        point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        a, b, c, d = point("x1", "y1"), point("x2", "y2"), point("u1", "v1"), point("u2", "v2")
        found.append(pairs.where((_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)).select(*key))
    if not found:
        return sights.select(*key).limit(0)
    return (found[0] if len(found) == 1 else found[0].union(found[1])).distinct()
