"""A network from loose lines: cut where others end on them, ends that lie together made one node, short gaps bridged, crumbs dropped.

Lines are (line_id, pts) in a plane of metres; pts is an array of struct<x, y>. What is near is found by cells, so nothing is compared with
everything; a line lies in all cells of its segments' boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfree.scratch import materialize

from .graph import components, components_of_places, salted_join
from .greedy import distant
from .overlay import _spread

# Fixed values, in metres: how near ends are the same, the widest gap that is bridged, the shortest part that stays, the shortest piece.
SNAP_M, BRIDGE_M, LEAST_PART_M, LEAST_PIECE_M = 1.5, 6.0, 30.0, 0.5
CELL_M = 20.0


def _apart(a, b) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def measured(lines: DataFrame) -> DataFrame:
    """Lines with ``along``: the length up to each point; those of fewer than two points or no length are left out."""
    n = F.size("pts")
    steps = F.zip_with(F.slice("pts", F.lit(1), n - 1), F.slice("pts", F.lit(2), n - 1), _apart)
    along = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return lines.where(n >= 2).withColumn("along", along).where(F.element_at("along", -1) > 0)


def segments(lines: DataFrame) -> DataFrame:
    """line_id, i, x1, y1, x2, y2 and from (the length before) of each segment of measured lines."""
    n = F.size("pts")
    parts = F.arrays_zip(F.slice("pts", F.lit(1), n - 1).alias("p"), F.slice("pts", F.lit(2), n - 1).alias("q"), F.slice("along", F.lit(1), n - 1).alias("before"))
    rows = lines.select("line_id", F.posexplode(parts).alias("i", "s"))
    return rows.select("line_id", "i", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"), F.col("s.before").alias("before"))


def _in_cells(segs: DataFrame, margin: float, cell: float = CELL_M) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - margin) / cell), F.floor((F.greatest(a, b) + margin) / cell))
    return segs.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def _ends(lines: DataFrame, *columns: str) -> DataFrame:
    """The two ends of each line: end (0 or 1), x, y."""
    both = F.array(F.struct(F.lit(0).alias("end"), F.col("pts")[0].alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("pts", -1).alias("p")))
    return lines.select(*columns, F.explode(both).alias("e")).select(*columns, F.col("e.end").alias("end"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def touches(lines: DataFrame, tol: float = SNAP_M) -> DataFrame:
    """line_id, other, end and d: where (by length) an end of another line lies within tol of a measured line, but not near the line's own ends."""
    ends = _ends(lines.withColumnRenamed("line_id", "other"), "other")
    ends = ends.withColumns({"cx": F.floor(F.col("x") / CELL_M), "cy": F.floor(F.col("y") / CELL_M)})
    near = _in_cells(segments(lines), tol).join(ends, ["cx", "cy"]).where("line_id <> other")
    # most ends in a cell lie outside the segment's box; the exact distance of the rest is rounded, which takes time
    inside = lambda c, a, b: F.col(c).between(F.least(a, b) - tol - 1e-6, F.greatest(a, b) + tol + 1e-6)
    near = near.where(inside("x", "x1", "x2") & inside("y", "y1", "y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / square))).otherwise(0.0)
    near = near.withColumn("t", t).withColumn("off", F.hypot(F.col("x") - F.col("x1") - F.col("t") * dx, F.col("y") - F.col("y1") - F.col("t") * dy)).where(F.round("off", 9) <= tol)
    best = near.groupBy("line_id", "other", "end").agg(F.min(F.struct(F.round("off", 9).alias("off"), "i", (F.col("before") + F.col("t") * F.sqrt(square)).alias("d"))).alias("best"))
    length = lines.select("line_id", F.element_at("along", -1).alias("length"))
    return best.join(length, "line_id").select("line_id", "other", "end", F.col("best.d").alias("d"), "length").where((F.col("d") > tol) & (F.col("d") < F.col("length") - tol))


def _at(d: Column) -> Column:
    """The point of a measured line at a length."""
    k = F.greatest(F.lit(1), F.least(F.size(F.filter("along", lambda c: c <= d)), F.size("pts") - 1))
    p, q, a, b = F.element_at("pts", k), F.element_at("pts", k + 1), F.element_at("along", k), F.element_at("along", k + 1)
    t = F.when(b > a, (d - a) / (b - a)).otherwise(0.0)
    return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))


def split(lines: DataFrame, tol: float = SNAP_M) -> DataFrame:
    """line_id, part (from 0), pts and length of the pieces of measured lines, cut where others end on them; cuts by the centimetre."""
    cuts = touches(lines, tol).groupBy("line_id").agg(F.sort_array(F.collect_set(F.round("d", 2))).alias("cuts"))
    whole = lines.join(cuts, "line_id", "left").withColumn("length", F.element_at("along", -1))
    marks = F.concat(F.coalesce("cuts", F.array().cast("array<double>")), F.array("length"))
    # marks that follow the one before too closely are passed over
    kept = F.aggregate(marks, F.array(F.lit(0.0)), lambda acc, d: F.when(d - F.element_at(acc, -1) < LEAST_PIECE_M, acc).otherwise(F.concat(acc, F.array(d))))
    n = F.size("kept")
    whole = whole.withColumn("kept", kept)
    spans = F.filter(F.arrays_zip(F.slice("kept", F.lit(1), n - 1).alias("s"), F.slice("kept", F.lit(2), n - 1).alias("e")), lambda x: x["e"] - x["s"] > LEAST_PIECE_M)
    spans = F.when(F.col("cuts").isNull() | (F.size(spans) == 0), F.array(F.struct(F.lit(0.0).alias("s"), F.col("length").alias("e")))).otherwise(spans)
    rows = whole.select("line_id", "pts", "along", F.posexplode(spans).alias("part", "x"))
    inner = F.filter(F.arrays_zip(F.col("pts").alias("p"), F.col("along").alias("at")), lambda v: (v["at"] > F.col("x.s")) & (v["at"] < F.col("x.e")))
    pts = F.concat(F.array(_at(F.col("x.s"))), F.transform(inner, lambda v: v["p"]), F.array(_at(F.col("x.e"))))
    return rows.select("line_id", "part", pts.alias("pts"), (F.col("x.e") - F.col("x.s")).alias("length"))


def crossings(lines: DataFrame) -> DataFrame:
    """line_id < other with x, y: where segments of two measured lines cross; touching is not crossing."""
    segs = segments(lines)
    own = _in_cells(segs, 0.0)
    there = own.select(F.col("line_id").alias("other"), F.col("i").alias("j"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"), "cx", "cy")
    # two segments meet in all cells that both lie in; the first of these counts
    low = lambda a, b, c, d: F.floor(F.greatest(F.least(a, b), F.least(c, d)) / CELL_M)
    first = (F.col("cx") == low("x1", "x2", "u1", "u2")) & (F.col("cy") == low("y1", "y2", "v1", "v2"))
    pairs = own.join(there, ["cx", "cy"]).where((F.col("line_id") < F.col("other")) & first)
    side = lambda ax, ay, bx, by, px, py: (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))
    a, b = side("x1", "y1", "x2", "y2", "u1", "v1"), side("x1", "y1", "x2", "y2", "u2", "v2")
    c, d = side("u1", "v1", "u2", "v2", "x1", "y1"), side("u1", "v1", "u2", "v2", "x2", "y2")
    t = c / (c - d)
    hit = pairs.where((a * b < 0) & (c * d < 0))
    return hit.select("line_id", "i", "other", "j", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def close(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Pairs a < b of points (key, x, y) within the radius, with their distance d."""
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    cells = points.select(F.col(key).alias("a"), "x", "y").withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    there = points.select(F.col(key).alias("b"), F.col("x").alias("u"), F.col("y").alias("v")).withColumn("sx", step).withColumn("sy", step)
    there = there.select("b", "u", "v", (F.floor(F.col("u") / radius) + F.col("sx")).alias("cx"), (F.floor(F.col("v") / radius) + F.col("sy")).alias("cy"))
    return cells.join(there, ["cx", "cy"]).where("a < b").withColumn("d", F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))).where(F.col("d") <= radius).select("a", "b", "d")


def build(lines: DataFrame, tol: float = SNAP_M, bridge: float = BRIDGE_M, least_part: float = LEAST_PART_M) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): node_id, x, y; and line_id, part (null for bridges), u, v, length, bridged.

    A node is a group of ends that lie within tol of each other, one by one; it stands where the first of them does, by x and y. Nodes within
    ``bridge`` that are not within three links of each other are joined, nearest first, each bridge counting for those after it. Parts of the
    network that are shorter than ``least_part`` in all go, and so do lines that begin and end at the same node.
    """
    pieces = materialize(split(measured(lines), tol), "pieces")
    ends = _ends(pieces, "line_id", "part")
    spots = ends.select("x", "y").distinct().repartitionByRange("x", "y").sortWithinPartitions("x", "y")
    spots = materialize(spots.select(F.monotonically_increasing_id().alias("spot"), "x", "y"), "spots")  # in order of x, y
    groups = components(close(spots, "spot", tol).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = spots.join(groups.select(F.col("node").alias("spot"), "root"), "spot", "left").withColumn("node_id", F.coalesce("root", "spot"))
    placed = materialize(placed.select("spot", "node_id", "x", "y"), "placed")
    known = ends.join(placed, ["x", "y"]).groupBy("line_id", "part").agg(F.max(F.when(F.col("end") == 0, F.col("node_id"))).alias("u"), F.max(F.when(F.col("end") == 1, F.col("node_id"))).alias("v"))
    links = pieces.select("line_id", "part", "length").join(known, ["line_id", "part"]).where("u <> v").select("line_id", "part", "u", "v", "length", F.lit(False).alias("bridged"))
    links = materialize(links, "links")
    nodes = placed.where("spot = node_id").select("node_id", "x", "y")
    if bridge > 0:
        bridges = distant(close(nodes, "node_id", bridge), links)
        links = links.unionByName(bridges.select(F.lit(None).cast("bigint").alias("line_id"), F.lit(None).cast("int").alias("part"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("d").alias("length"), F.lit(True).alias("bridged")))
    # ids in order of x join nodes far apart; along a curve through the plane near ones have near ids
    part = lambda c: _spread(F.pmod(F.floor(F.col(c) / CELL_M) + (1 << 23), F.lit(1 << 24)).cast("bigint"))
    curve = nodes.select("node_id", F.shiftleft(part("y"), 1).bitwiseOR(part("x")).alias("along")).repartitionByRange("along", "node_id").sortWithinPartitions("along", "node_id")
    curve = materialize(curve.select("node_id", F.monotonically_increasing_id().alias("place")), "curve")
    at = lambda n: curve.select(F.col("node_id").alias(n), F.col("place").alias(f"place_{n}"))
    links = materialize(links.join(at("u"), "u").join(at("v"), "v"), "joined")
    roots = components_of_places(links.select(F.col("place_u").alias("u"), F.col("place_v").alias("v")))
    rooted = links.join(roots.select(F.col("node").alias("place_u"), "root"), "place_u")
    stay = rooted.groupBy("root").agg(F.sum("length").alias("whole")).where(F.col("whole") >= least_part).select("root")
    links = salted_join(rooted, stay, "root").select("line_id", "part", "u", "v", "length", "bridged")
    return nodes.join(links.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi"), links
