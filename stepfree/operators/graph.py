"""The street graph: cleaning, what a profile may pass, what it costs, components and derived links."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions.geo import haversine
from stepfree.scratch import drop, materialize

SHORT_LINK_M = 15.0  # slopes of shorter links are measurement noise and never block
DERIVED_COST = 4.0
#: A stretch of ids, whose links one task joins, has 2**STRETCH_BITS nodes at most, about 100 bytes each.
STRETCH_BITS = 14
# The types of links.
LINK_TYPES = ("sidewalk", "road", "crossing", "steps", "overpass", "underpass", "ramp", "elevator", "unknown")


@dataclass(frozen=True)
class Profile:
    id: str
    max_slope: float
    speed: float
    slope_factor: float
    avoid: tuple = ()
    penalize: dict = field(default_factory=dict)
    min_width: float = 0.0
    curb_cut: bool = False
    hard_slope: float = 0.0
    over_penalty: float = 1.0
    least_confidence: float = 0.40

    @property
    def limit(self) -> float:
        return max(self.hard_slope, self.max_slope)


# The five mobility profiles.
PROFILES = {
    p.id: p
    for p in (
        Profile("wheelchair_manual", 4.0, 0.7, 0.30, ("steps", "overpass", "underpass"), {"crossing": 1.2, "ramp": 1.1, "road": 1.25, "unknown": 1.1, "alley": 1.5}, 0.9, True, 8.0, 1.0, 0.60),
        Profile("wheelchair_electric", 6.0, 1.1, 0.15, ("steps", "overpass", "underpass"), {"crossing": 1.1, "road": 1.2, "unknown": 1.1, "alley": 1.5}, 1.2, True, 10.0, 0.6, 0.55),
        Profile("crutch", 8.0, 0.6, 0.20, ("overpass",), {"steps": 3.0}, 0.8),
        Profile("visual", 12.0, 0.8, 0.05, (), {"crossing": 1.5, "overpass": 2.0, "underpass": 1.5}, least_confidence=0.70),
        Profile("walk", 20.0, 1.2, 0.05),
    )
}


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles as rows, with the slope that blocks."""
    rows = [(p.id, p.max_slope, p.limit, p.speed, list(p.avoid), p.penalize, p.min_width, p.curb_cut, p.least_confidence) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "id string, max_slope_deg double, hard_slope_deg double, speed_mps double, avoid array<string>, penalize map<string,double>, min_width_m double, requires_curb_cut boolean, derived_min_confidence double")


def normalized(edges: DataFrame) -> DataFrame:
    """Defaults for what is missing: type unknown, slope and length 0, no negative slope."""
    kind = F.when(F.col("link_type").isin(*LINK_TYPES), F.col("link_type")).otherwise("unknown")
    return edges.withColumns({"link_type": kind, "slope": F.abs(F.coalesce(F.col("slope"), F.lit(0.0))), "length": F.coalesce(F.col("length"), F.lit(0.0))})


def reclassified(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The type of the first pattern that the name matches, for roads, sidewalks and unknown links only."""
    kind = F.col("link_type")
    for pattern, name in reversed(rules):
        kind = F.when(F.col("link_name").rlike(pattern), name).otherwise(kind)
    return edges.withColumn("link_type", F.when(F.col("link_type").isin("road", "sidewalk", "unknown"), kind).otherwise(F.col("link_type")))


def _has(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def is_alley() -> Column:
    name = F.trim(F.coalesce(F.col("link_name"), F.lit("")))
    return (F.col("link_type") == "road") & ((name == "") | name.endswith("번길"))


def passable(edges: DataFrame, p: Profile, limit: float | None = None) -> Column:
    """Whether the profile may use a link; unknown widths and kerbs don't block."""
    reference = F.coalesce(_has(edges, "orig_length", None).cast("double"), F.col("length"))
    blocked = F.coalesce(_has(edges, "blocked", False), F.lit(False))
    doubtful = (F.col("topo_source") == "derived") & (F.col("confidence") < p.least_confidence)
    steep = (F.col("slope") > (p.limit if limit is None else limit)) & (reference >= SHORT_LINK_M)
    narrow = (F.col("width") < p.min_width) if p.min_width else F.lit(False)
    kerb = (F.col("link_type") == "crossing") & F.col("curb_cut").eqNullSafe(False) if p.curb_cut else F.lit(False)
    avoided = F.col("link_type").isin(*p.avoid) if p.avoid else F.lit(False)
    return ~(blocked | F.coalesce(doubtful, F.lit(False)) | avoided | steep | F.coalesce(narrow, F.lit(False)) | kerb)


def cost(p: Profile, penalty: float = 1.0) -> Column:
    """Metres, weighted by slope, type, alleys and doubt."""
    base = F.greatest(F.col("length"), F.lit(0.1)) * (1 + p.slope_factor * F.col("slope"))
    over = F.col("slope") - p.max_slope
    base = base * F.when(over > 0, 1 + p.over_penalty * over).otherwise(1.0)
    kinds = [F.lit(x) for kv in p.penalize.items() for x in kv]
    if kinds:
        base = base * F.coalesce(F.element_at(F.create_map(*kinds), F.col("link_type")), F.lit(1.0))
    base = base * F.when(is_alley(), p.penalize.get("alley", 1.0)).otherwise(1.0)
    doubt = F.when((F.col("topo_source") == "derived") & F.col("confidence").isNotNull(), 1 + DERIVED_COST * (1 - F.col("confidence"))).otherwise(1.0)
    return base * doubt * penalty


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.select("u", "v", *columns).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *columns))


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """An equi-join where ``on`` may be hot on the left and is unique on the right: left rows are dealt out by their hash."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [on, "salt"], how).drop("salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable. Rounds of large and small stars; hubs' links are dealt out, only a checksum is collected."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        least = both_ways(e).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(salted_join(both_ways(e).where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop(before, large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        last = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _joined_inside(batches):
    """For links sorted by the stretch that both ends lie in: each node with the smallest one that it is joined with inside the stretch."""
    at, up = None, {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def close():
        return pa.record_batch([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "root"])

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            if u >> STRETCH_BITS != at:
                if up:
                    yield close()
                at, up = u >> STRETCH_BITS, {}
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield close()


def components_of_places(edges: DataFrame) -> DataFrame:
    """What ``components`` gives, with few rows in its rounds where nodes that are linked mostly have ids near each other.

    The links inside a stretch of ids are joined by one task; those between stretches alone go through rounds.
    """
    stretch = lambda c: F.shiftright(c, STRETCH_BITS)
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    e = edges.where("u <> v").select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    # an end of a link between stretches is a node of its own stretch
    own = F.when(stretch("u") == stretch("v"), F.array(pair("u", "v"))).otherwise(F.array(pair("u", "u"), pair("v", "v")))
    rows = e.select(F.explode(own).alias("x")).select("x.u", "x.v").repartition(stretch("u")).sortWithinPartitions(stretch("u"))
    inside = materialize(rows.mapInArrow(_joined_inside, "node bigint, root bigint"), "inside")
    at = lambda n: inside.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    between = salted_join(salted_join(e.where(stretch("u") != stretch("v")), at("u"), "u"), at("v"), "v")
    roots = components(between.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    whole = inside.withColumnRenamed("root", "own").join(roots.select(F.col("node").alias("own"), "root"), "own", "left")
    return whole.select("node", F.coalesce("root", "own").alias("root"))


def largest_component(edges: DataFrame, p: Profile) -> DataFrame:
    """The nodes of the largest part that the profile can reach; of equal parts the one with the smallest node."""
    found = components(edges.where(passable(edges, p)))
    best = found.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1)
    return found.join(best, "root", "left_semi").select(F.col("node").alias("node_id"))


def costs_from(edges: DataFrame, source: int, p: Profile, most_rounds: int = 10_000) -> DataFrame:
    """(node, cost) of the cheapest paths from one node, by relaxing the frontier; fit for graphs beyond one machine.

    Only nodes that became cheaper in the last round are joined with their links.
    """
    arcs = materialize(both_ways(edges.where(passable(edges, p)).withColumn("c", cost(p)), "c"), "arcs")
    best = edges.sparkSession.range(1).select(F.lit(source).cast("bigint").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh"))
    for _ in range(most_rounds):
        step = best.where("fresh").join(arcs, F.col("node") == arcs.u).groupBy(F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("c")).alias("new"))
        merged = best.select("node", "cost").join(step, "node", "full_outer")
        cheaper = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        best = materialize(merged.select("node", F.when(cheaper, F.col("new")).otherwise(F.col("cost")).alias("cost"), cheaper.alias("fresh")), "costs")
        if best.where("fresh").isEmpty():
            return best.select("node", "cost")
    raise RuntimeError("costs did not settle")


def detours(edges: DataFrame, nodes: DataFrame, longest: float = 25.0, ratio: float = 1.41, excess: float = 20.0) -> DataFrame:
    """Pairs a < b that share a neighbour m, have no link of their own, and are much closer than by way of m."""
    arcs = both_ways(edges, "length")
    pairs = arcs.select(F.col("u").alias("m"), F.col("v").alias("a"), F.col("length").alias("am")).join(arcs.select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("length").alias("mb")), "m").where("a < b")
    pairs = pairs.join(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), ["a", "b"], "left_anti")
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lng").alias(f"{n}_lng"))
    pairs = pairs.join(at("a"), "a").join(at("b"), "b")
    straight = haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    pairs = pairs.select("a", "m", "b", straight.alias("straight_m"), (F.col("am") + F.col("mb")).alias("via_m"))
    return pairs.where((F.col("straight_m") > 0.5) & (F.col("straight_m") <= longest) & (F.col("via_m") / F.col("straight_m") >= ratio) & (F.col("via_m") - F.col("straight_m") < excess))


def slopes(edges: DataFrame, elevation: DataFrame) -> DataFrame:
    """Slope in degrees from the ends' elevations; links under a metre, or with an end unknown, keep theirs."""
    z = lambda n: elevation.select(F.col("node_id").alias(n), F.col("elev").alias(f"z{n}"))
    joined = edges.join(z("u"), "u", "left").join(z("v"), "v", "left")
    new = F.degrees(F.atan(F.abs(F.col("zu") - F.col("zv")) / F.col("length")))
    return joined.withColumn("slope", F.when((F.col("length") >= 1) & F.col("zu").isNotNull() & F.col("zv").isNotNull(), new).otherwise(F.col("slope"))).drop("zu", "zv")
