"""Queries that build a network from loose lines, on lines that each part of the tables draws in a plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfree.operators import greedy, topology

from .base import query

_X, _Y = "cast(p_partkey % 100 * 10 + p_size % 7 as double)", "cast((p_partkey - p_partkey % 100) / 100 * 10 + p_size % 5 as double)"
_STEPS = (("p_partkey * 7 % 11 - 5", "p_partkey * 5 % 13 - 6", 1.5), ("p_partkey * 3 % 7 - 3", "p_partkey * 11 % 9 - 4", 2.0))
_MX, _MY = f"{_X} + ({_STEPS[0][0]}) * cast(1.5 as double)", f"{_Y} + ({_STEPS[0][1]}) * cast(1.5 as double)"
_EX, _EY = f"{_MX} + ({_STEPS[1][0]}) * cast(2 as double)", f"{_MY} + ({_STEPS[1][1]}) * cast(2 as double)"


def _lines(d):
    at = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    part = d.part.select("p_partkey", "p_size").repartition("p_partkey")  # a file of few bytes holds many lines
    return topology.measured(part.select(F.col("p_partkey").alias("line_id"), F.array(at(_X, _Y), at(_MX, _MY), at(_EX, _EY)).alias("pts")))


_LINE = f"SELECT p_partkey AS line_id, {_X} AS ax, {_Y} AS ay, {_MX} AS bx, {_MY} AS by_, {_EX} AS ex, {_EY} AS ey FROM part"
_SEGS = f"""line AS ({_LINE}), long AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS l1, sqrt(pow(ex - bx, 2) + pow(ey - by_, 2)) AS l2 FROM line),
  segs AS (SELECT line_id, 0 AS i, ax AS x1, ay AS y1, bx AS x2, by_ AS y2, 0.0::double AS before, l1 AS len, l1 + l2 AS total FROM long WHERE l1 + l2 > 0 UNION ALL SELECT line_id, 1, bx, by_, ex, ey, l1, l2, l1 + l2 FROM long WHERE l1 + l2 > 0)"""
_T = "coalesce(greatest(0.0, least(1.0, ((e.x - s.x1) * (s.x2 - s.x1) + (e.y - s.y1) * (s.y2 - s.y1)) / nullif(s.len * s.len, 0))), 0.0)"


@query(f"""WITH {_SEGS}, ends AS (SELECT line_id, 0 AS "end", ax AS x, ay AS y FROM long WHERE l1 + l2 > 0 UNION ALL SELECT line_id, 1, ex, ey FROM long WHERE l1 + l2 > 0),
  near AS (SELECT s.line_id, e.line_id AS other, e."end", s.i, s.total, s.before + {_T} * s.len AS d, sqrt(pow(e.x - s.x1 - {_T} * (s.x2 - s.x1), 2) + pow(e.y - s.y1 - {_T} * (s.y2 - s.y1), 2)) AS off FROM segs s JOIN ends e ON e.line_id <> s.line_id AND e.x BETWEEN least(s.x1, s.x2) - 2 AND greatest(s.x1, s.x2) + 2),
  first AS (SELECT *, row_number() OVER (PARTITION BY line_id, other, "end" ORDER BY round(off, 9), i) AS rn FROM near WHERE round(off, 9) <= 1.5)
  SELECT line_id, other, "end", round(d, 4) AS d FROM first WHERE rn = 1 AND d > 1.5 AND d < total - 1.5""")
def gr19_touches(d):
    """Where lines end on others, which are cut there."""
    return topology.touches(_lines(d)).select("line_id", "other", "end", F.round("d", 4).alias("d"))


_SIDE = "(({b}.x2 - {b}.x1) * ({p}.y{k} - {b}.y1) - ({b}.y2 - {b}.y1) * ({p}.x{k} - {b}.x1))"
_A, _B, _C, _D = (_SIDE.format(b=b, p=p, k=k) for b, p, k in (("s", "o", 1), ("s", "o", 2), ("o", "s", 1), ("o", "s", 2)))


@query(f"""WITH {_SEGS} SELECT s.line_id, s.i, o.line_id AS other, o.i AS j, round(s.x1 + {_C} / ({_C} - {_D}) * (s.x2 - s.x1), 4) AS x, round(s.y1 + {_C} / ({_C} - {_D}) * (s.y2 - s.y1), 4) AS y
  FROM segs s JOIN segs o ON s.line_id < o.line_id AND least(o.x1, o.x2) <= greatest(s.x1, s.x2) AND greatest(o.x1, o.x2) >= least(s.x1, s.x2) AND {_A} * {_B} < 0 AND {_C} * {_D} < 0""")
def geo10_crossings(d):
    """Where lines cross."""
    return topology.crossings(_lines(d)).select("line_id", "i", "other", "j", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def gr19_topology(d):
    """The links of the network that the lines make, by the places of their ends."""
    nodes, links = topology.build(_lines(d).select("line_id", "pts"))
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    rows = links.join(at("u"), "u").join(at("v"), "v")
    return rows.select("line_id", "part", "bridged", *[F.round(c, 3).alias(c) for c in ("length", "u_x", "u_y", "v_x", "v_y")])


def _gaps(d):
    """Candidate joins: the free ends of different lines within 8 m, by their lines."""
    ends = _lines(d).select("line_id", F.element_at("pts", -1).alias("p")).select("line_id", "p.x", "p.y")
    return topology.close(ends, "line_id", 8.0)


@query()
def srt07_spanning_joins(d):
    """The joins that bring parts together, shortest first."""
    return greedy.spanning(_gaps(d)).select("a", "b", F.round("d", 4).alias("d"))


@query()
def gr26_limited_joins(d):
    """Joins, shortest first, two for each line at most."""
    return greedy.limited(_gaps(d), 2).select("a", "b", F.round("d", 4).alias("d"))


# the plane of the lattice: metres by the scale at its south
_PX, _PY = "(lng - 126.8) * (111320.0 * cos(radians(37.3)))", "(lat - 37.3) * 110540.0"
_POINT = f"SELECT node_id, p_size, {_PX} AS x, {_PY} AS y FROM node"
#: Two overlapping triangles beside every fifth node stand for stairs.
_CORNERS = tuple((k, f"x + {a}", f"y + {b}") for k, a, b in ((0, "p_size % 7 - 6", "-4"), (1, "12 + p_size % 5", "-3"), (2, "4", "6 + p_size % 11")))
_SHIFT = "(p_size % 4)"


def _plane(d):
    at = d.node.select("node_id", "p_size", F.expr(_PX).alias("x"), F.expr(_PY).alias("y"))
    corner = lambda x, y, more="0": F.struct(F.expr(f"{x} + {more}").alias("x"), F.expr(y).alias("y"))
    ring = lambda more: F.array(F.array(*[corner(x, y, more) for _, x, y in _CORNERS]))
    own = at.where("node_id % 5 = 0")
    shapes = own.select((F.col("node_id") * 2).alias("polygon_id"), ring("0").alias("rings")).union(own.select(F.col("node_id") * 2 + 1, ring(_SHIFT)))
    end = lambda n, i: at.select(F.col("node_id").alias(n), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    links = d.edge.join(end("u", 1), "u").join(end("v", 2), "v")
    return links.withColumn("base_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), shapes


_RING = " UNION ALL ".join(f"SELECT node_id * 2 + {s} AS polygon_id, {k} AS k, {x} + {_SHIFT if s else 0} AS x, {y} AS y FROM point WHERE node_id % 5 = 0" for s in (0, 1) for k, x, y in _CORNERS)
_LEFT, _RIGHT = ("((s.x2 - s.x1) * (r.y{0} - s.y1) - (s.y2 - s.y1) * (r.x{0} - s.x1))".format(i) for i in "ab")
_INSIDE = f"""point AS ({_POINT}), ring AS ({_RING}), side AS (SELECT p.polygon_id, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, z.x AS xz, z.y AS yz FROM ring p JOIN ring q ON q.polygon_id = p.polygon_id AND q.k = (p.k + 1) % 3 JOIN ring z ON z.polygon_id = p.polygon_id AND z.k = 0),
  seg AS (SELECT e.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS base_m FROM edge e JOIN point a ON a.node_id = e.u JOIN point b ON b.node_id = e.v),
  hit AS (SELECT s.u, s.v, r.polygon_id, ((r.xa + {_LEFT} / ({_LEFT} - {_RIGHT}) * (r.xb - r.xa) - s.x1) * (s.x2 - s.x1) + (r.ya + {_LEFT} / ({_LEFT} - {_RIGHT}) * (r.yb - r.ya) - s.y1) * (s.y2 - s.y1)) / pow(s.base_m, 2) AS t
    FROM seg s JOIN side r ON ({_LEFT} > 0) <> ({_RIGHT} > 0) AND abs(r.xz - s.x1) < 100 AND abs(r.yz - s.y1) < 100),
  turn AS (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS f FROM hit WINDOW w AS (PARTITION BY u, v, polygon_id ORDER BY t)),
  stretch AS (SELECT u, v, greatest(0.0, least(1.0, t)) AS s, greatest(0.0, least(1.0, f)) AS e FROM turn WHERE i % 2 = 1),
  fresh AS (SELECT u, v, greatest(0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY u, v ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM stretch WHERE e > s),
  cover AS (SELECT f.u, f.v, sum(n) * any_value(base_m) AS inside_m FROM fresh f JOIN seg ON seg.u = f.u AND seg.v = f.v GROUP BY f.u, f.v)"""


@query(f"WITH {_INSIDE} SELECT u, v, round(inside_m, 4) AS inside_m FROM cover WHERE inside_m > 1e-6")
def geo13_inside_metres(d):
    """How many metres of each link lie on stairs, where polygons overlap."""
    from stepfree.operators import polygons

    links, shapes = _plane(d)
    out = polygons.covered(links.select("u", "v", "x1", "y1", "x2", "y2"), shapes, ["u", "v"])
    return out.where("inside_m > 1e-6").select("u", "v", F.round("inside_m", 4).alias("inside_m"))


@query(f"""WITH {_INSIDE} SELECT s.u, s.v, CASE WHEN c.inside_m >= 3 AND s.length / s.base_m <= 1.15 AND c.inside_m / s.base_m >= 0.3 AND s.link_type NOT IN ('steps', 'overpass', 'underpass') THEN 'steps' ELSE s.link_type END AS link_type,
  CASE WHEN c.inside_m >= 3 AND s.length / s.base_m <= 1.15 AND c.inside_m / s.base_m >= 0.3 AND s.link_type NOT IN ('steps', 'overpass', 'underpass') THEN s.link_type END AS orig_link_type FROM seg s LEFT JOIN cover c ON c.u = s.u AND c.v = s.v""")
def gr33_stairs(d):
    """Links that lie on stairs become steps; what they were is kept."""
    from stepfree.operators import polygons

    links, shapes = _plane(d)
    covers = polygons.covered(links.select("u", "v", "x1", "y1", "x2", "y2"), shapes, ["u", "v"])
    return polygons.stairs(links, covers, ["u", "v"]).select("u", "v", "link_type", "orig_link_type")


_SIGHT = "SELECT a.node_id, a.x + a.p_size % 3 AS x1, a.y + a.p_size % 5 AS y1, b.x AS x2, b.y AS y2 FROM point a JOIN point b ON b.node_id = a.node_id + 81"
_WALL = "SELECT node_id AS wall_id, x + 3 AS u1, y + 5 AS v1, x + 9 + p_size % 17 AS u2, y - 4 - p_size % 6 AS v2 FROM point WHERE node_id % 11 = 0"
_WA, _WB = ("((s.x2 - s.x1) * (w.v{0} - s.y1) - (s.y2 - s.y1) * (w.u{0} - s.x1))".format(i) for i in (1, 2))
_WC, _WD = ("((w.u2 - w.u1) * (s.y{0} - w.v1) - (w.v2 - w.v1) * (s.x{0} - w.u1))".format(i) for i in (1, 2))
_SL, _SR = _LEFT, _RIGHT


@query(f"""WITH point AS ({_POINT}), ring AS ({_RING}), side AS (SELECT p.polygon_id, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, z.x AS xz, z.y AS yz FROM ring p JOIN ring q ON q.polygon_id = p.polygon_id AND q.k = (p.k + 1) % 3 JOIN ring z ON z.polygon_id = p.polygon_id AND z.k = 0),
  sight AS ({_SIGHT}), wall AS ({_WALL}),
  hit AS (SELECT s.node_id, r.polygon_id, ((r.xa + {_SL} / ({_SL} - {_SR}) * (r.xb - r.xa) - s.x1) * (s.x2 - s.x1) + (r.ya + {_SL} / ({_SL} - {_SR}) * (r.yb - r.ya) - s.y1) * (s.y2 - s.y1)) / (pow(s.x2 - s.x1, 2) + pow(s.y2 - s.y1, 2)) AS t
    FROM sight s JOIN side r ON ({_SL} > 0) <> ({_SR} > 0)),
  turn AS (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS f FROM hit WINDOW w AS (PARTITION BY node_id, polygon_id ORDER BY t)),
  stretch AS (SELECT node_id, polygon_id, greatest(0.0, least(1.0, t)) AS s, greatest(0.0, least(1.0, f)) AS e FROM turn WHERE i % 2 = 1),
  inside AS (SELECT node_id, polygon_id FROM stretch WHERE e > s GROUP BY 1, 2 HAVING min(s) > 0 AND max(e) < 1)
  SELECT node_id FROM inside UNION SELECT s.node_id FROM sight s JOIN wall w ON {_WA} * {_WB} < 0 AND {_WC} * {_WD} < 0""")
def geo18_blocked_sights(d):
    """Sight lines between nodes of the lattice that a building or a wall blocks."""
    from stepfree.operators import polygons

    _, shapes = _plane(d)
    at = d.node.select("node_id", "p_size", F.expr(_PX).alias("x"), F.expr(_PY).alias("y"))
    there = at.select((F.col("node_id") - 81).alias("node_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    sights = at.join(there, "node_id").select("node_id", F.expr("x + p_size % 3").alias("x1"), F.expr("y + p_size % 5").alias("y1"), "x2", "y2")
    walls = at.where("node_id % 11 = 0").select(F.expr("x + 3").alias("x1"), F.expr("y + 5").alias("y1"), F.expr("x + 9 + p_size % 17").alias("x2"), F.expr("y - 4 - p_size % 6").alias("y2"))
    return polygons.blocked(sights, ["node_id"], shapes, walls)
