"""Turn-by-turn guidance: ordered folds over a route, one route at a time in a worker.

A route's rows are bounded by its length, so a group always fits; many routes spread over the cluster by their id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.geo import bearing

from . import areas

# Turn thresholds in degrees, and lengths in metres.
STRAIGHT, SLIGHT, TURN, SHARP = 20.0, 45.0, 120.0, 150.0
CARRY_M, ABSORB_M, MERGE_M = 12.0, 8.0, 15.0
LANDMARK_GAP_M, LANDMARK_WINDOW_M = 150.0, 60.0
#: Routes that begin in the same 2**STRETCH_BITS node ids look their links up together.
STRETCH_BITS = 12
SPECIAL = ("crossing", "elevator", "ramp", "steps")


def turn_between(before: float, after: float) -> float:
    return (after - before + 540) % 360 - 180


def maneuver(angle: float) -> str:
    a = abs(angle)
    if a < STRAIGHT:
        return "straight"
    side = "right" if angle > 0 else "left"
    return f"slight_{side}" if a < SLIGHT else side if a < TURN else f"sharp_{side}" if a < SHARP else "uturn"


def carried_maneuver(angle: float) -> str:
    """The maneuver of turns summed over short links: beyond half a turn the sum keeps its side, unless it leads back."""
    if abs(angle) <= 180:
        return maneuver(angle)
    if abs(turn_between(0.0, angle)) >= SHARP:
        return "uturn"
    return "sharp_right" if angle > 0 else "sharp_left"


def fold_steps(lengths, leads, kinds, trails=None) -> list[tuple[str, str | None, float]]:
    """(maneuver, kind, metres) of each step, from ``depart`` to ``arrive``.

    leads and trails are the bearings where a link begins and ends; a link without trails is straight. Special links are steps
    of their own, called by their kind, and announce no turn. A plain link under CARRY_M announces none either: its turn is added to
    the next one's. A plain link that goes straight on joins the step before if that is of its kind, or if it is under ABSORB_M;
    a special step takes up links under MERGE_M only.
    """
    steps: list[list] = []
    before, carried = None, 0.0
    for length, lead, trail, kind in zip(lengths, leads, leads if trails is None else trails, kinds, strict=True):
        special = kind in SPECIAL
        if before is None:
            move = "depart"
        else:
            carried += turn_between(before, lead)
            move = "straight" if special or length < CARRY_M else carried_maneuver(carried)
            if special or length >= CARRY_M:
                carried = 0.0
        before = trail
        last = steps[-1] if steps else None
        joins = last is not None and move == "straight" and not special and (last[1] == kind or length < ABSORB_M) and (length < MERGE_M or last[1] not in SPECIAL)
        if joins:
            last[2] += length
        else:
            steps.append([kind if special else move, kind, length])
    return [tuple(s) for s in steps] + ([("arrive", None, 0.0)] if steps else [])


def steps(links: DataFrame, key: str = "trip") -> DataFrame:
    """Steps of each route from its links (key, pos, length, bearing, link_type, and trail, the bearing at its end, if it bends)."""
    own = ["pos", "length", "bearing", "link_type", *(["trail"] if "trail" in links.columns else [])]
    kind = links.schema[key].dataType.simpleString()
    routes = links.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("links"))

    def run(batches):
        for b in batches:
            rows, sizes = [], []
            for route in b["links"].to_pylist():
                got = fold_steps(*([x[c] for x in route] for c in own[1:]))
                rows += [(i, *r) for i, r in enumerate(got)]
                sizes.append(len(got))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.float64()))]
            yield pa.record_batch([b[key].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *columns], names=[key, "idx", "maneuver", "link_type", "distance_m"])

    return routes.mapInArrow(run, f"{key} {kind}, idx int, maneuver string, link_type string, distance_m double")


def with_bearings(path_links: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of paths with length, type and bearing in the direction of travel."""
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "length", "link_type")
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lng").alias(f"{n}_lng"))
    rows = path_links.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(e, ["a", "b"]).join(at("u"), "u").join(at("v"), "v")
    return rows.withColumn("bearing", bearing(F.col("u_lat"), F.col("u_lng"), F.col("v_lat"), F.col("v_lng")))


def steps_of_routes(routes: DataFrame, edges: DataFrame, nodes: DataFrame, key: str = "trip") -> DataFrame:
    """Steps of each route (key, path), as ``steps`` gives them from the links of its path.

    Links come to a task once for all routes that begin in a stretch of nodes, and are looked up there. Of parallel links the shortest counts.
    """
    kind = routes.schema[key].dataType.simpleString()
    own = routes.select(F.col(key).alias("route"), "path", F.shiftright(F.element_at("path", 1), STRETCH_BITS).alias("area"))
    hops = own.select("area", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("u"), F.slice("path", F.lit(2), F.size("path") - 1).alias("v"))).alias("hop")).select("area", "hop.*").distinct()
    ends = F.least("u", "v"), F.greatest("u", "v")
    plain = edges.groupBy(ends[0].alias("a"), ends[1].alias("b")).agg(F.min(F.struct("length", "link_type")).alias("e")).select("a", "b", "e.length", "e.link_type")
    both = plain.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b").unionByName(plain.select(F.col("b").alias("u"), F.col("a").alias("v"), "a", "b").where("a <> b"))
    links = with_bearings(both.select("u", "v"), plain.withColumnsRenamed({"a": "u", "b": "v"}), nodes)
    near = hops.join(links, ["u", "v"]).select("area", "u", "v", "length", "link_type", "bearing")

    def prepare(held):
        u, v = (areas.column(held, c) for c in ("u", "v"))
        ids = np.unique(np.concatenate([u, v]))
        keys = np.searchsorted(ids, u) * len(ids) + np.searchsorted(ids, v)
        order = np.argsort(keys)
        kinds = pa.concat_arrays([b["link_type"] for b in held]).dictionary_encode() if held else pa.array([], pa.string()).dictionary_encode()
        names = [*kinds.dictionary.to_pylist(), None]
        codes = kinds.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        return ids, keys[order], *(areas.column(held, c)[order] for c in ("length", "bearing")), codes[order], names

    def serve(prepared, b):
        ids, keys, length, bearings, codes, names = prepared
        paths, n = b["path"].flatten().to_numpy(zero_copy_only=False), b["path"].value_lengths().to_numpy(zero_copy_only=False)
        starts = np.append(0, np.cumsum(n)).tolist()
        rows, sizes = [], []
        for i in range(b.num_rows):
            path = paths[starts[i] : starts[i + 1]]
            if len(ids) and len(path) > 1:
                at = np.minimum(np.searchsorted(ids, path), len(ids) - 1)
                known = ids[at] == path
                wanted = at[:-1] * len(ids) + at[1:]
                where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                where = where[(keys[where] == wanted) & known[:-1] & known[1:]]
            else:
                where = np.zeros(0, np.int64)
            got = fold_steps(length[where].tolist(), bearings[where].tolist(), [names[k] for k in codes[where].tolist()])
            rows += [(j, *r) for j, r in enumerate(got)]
            sizes.append(len(got))
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.string(), pa.string(), pa.float64()))]
        yield pa.record_batch([b["route"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *columns], names=[key, "idx", "maneuver", "link_type", "distance_m"])

    return areas.beside(own, near, prepare, serve, f"{key} {kind}, idx int, maneuver string, link_type string, distance_m double")


def thin(positions, tiers, offsets, ids) -> list[int]:
    """Greedy choice along a route: the next is at least the gap past the last; of those in the window after the first that
    qualifies, the best tier wins, then the smallest offset, then the earliest."""
    rows = sorted(zip(positions, tiers, offsets, ids, strict=True))
    chosen, cursor, i = [], -math.inf, 0
    while True:
        while i < len(rows) and rows[i][0] < cursor + LANDMARK_GAP_M:
            i += 1
        if i == len(rows):
            return chosen
        window = [r for r in rows[i:] if r[0] <= rows[i][0] + LANDMARK_WINDOW_M]
        best = min(window, key=lambda r: (r[1], r[2], r[0], r[3]))
        chosen.append(best[3])
        cursor = best[0]


def landmarks(candidates: DataFrame, key: str = "route_id") -> DataFrame:
    """Which candidates (key, position_m, tier, offset_m, id) guide along each route."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = thin(pdf["position_m"], pdf["tier"], pdf["offset_m"], pdf["id"])
        return pd.DataFrame({key: pdf[key].iloc[0], "idx": range(len(got)), "id": got})

    return candidates.select(key, "position_m", "tier", "offset_m", "id").groupBy(key).applyInPandas(run, f"{key} bigint, idx int, id bigint")
