import math

import pytest
from pyspark.sql import functions as F

from stepfree.functions import geo, text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_distances_bearings_and_turns(spark):
    r = one(
        spark, geo.haversine(*lit(37.39, 126.95, 37.39, 126.9511)), geo.bearing(*lit(37, 127, 38, 127)), geo.bearing(*lit(37, 127, 37, 126)), geo.turn_angle(*lit(350, 10)), geo.turn_angle(*lit(10, 350)), geo.clamp(F.lit(2.0)), geo.clamp(F.lit(None).cast("double"))
    )
    assert r[0] == pytest.approx(97.2, abs=0.5)
    assert r[1] == pytest.approx(0) and r[2] == pytest.approx(270.3, abs=0.1)
    assert (r[3], r[4], r[5], r[6]) == (20, -20, 1, None)


def test_segments_and_polylines(spark):
    pts = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((37.0, 127.0), (37.0, 127.001), (37.0, 127.001), (37.001, 127.001))])
    r = one(spark, geo.segment_distance(*lit(37.0005, 127.0005, 37, 127, 37, 127.001)), geo.segment_distance(*lit(37, 127, 37, 127.001, 37, 127.001)), geo.polyline_length(pts), geo.polyline_distance(F.lit(37.0), F.lit(127.0005), pts), F.size(geo.drop_repeats(pts)))
    assert r[0] == pytest.approx(55.27, abs=0.01)
    assert r[1] == pytest.approx(111320 * math.cos(math.radians(37)) * 0.001, abs=0.01)
    assert r[2] == pytest.approx(200, abs=1) and r[3] == pytest.approx(0, abs=1e-6) and r[4] == 3


def test_rings_crossings_tiles_and_projection(spark):
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))])
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    x, y = geo.tile(F.lit(37.39), F.lit(126.95), 14)
    east, north = geo.transverse_mercator(F.lit(38.0), F.lit(127.0))
    far, _ = geo.transverse_mercator(F.lit(38.0), F.lit(128.0))
    r = one(spark, geo.in_ring(*lit(1, 1), ring), geo.in_ring(*lit(3, 1), ring), geo.segments_cross(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), geo.segments_cross(p(0, 0), p(1, 1), p(1, 1), p(2, 0)), x, y, east, north, far)
    assert (r[0], r[1], r[2], r[3]) == (True, False, True, False)
    la = math.radians(37.39)
    assert (r[4], r[5]) == (int((126.95 + 180) / 360 * 16384), int((1 - math.log(math.tan(la) + 1 / math.cos(la)) / math.pi) / 2 * 16384))
    assert r[6] == pytest.approx(200_000, abs=1e-3) and r[7] == pytest.approx(600_000, abs=1e-3) and r[8] == pytest.approx(287_800, abs=50)


def test_names_and_flags(spark):
    r = one(
        spark, text.match_rank(F.lit("가람역"), F.lit("가람 역")), text.match_rank(F.lit("a"), F.lit("abc")), text.match_rank(F.lit("b"), F.lit("abc")), text.match_rank(F.lit("xabcx"), F.lit("abc")), text.match_rank(F.lit("xabx"), F.lit("ab")), text.match_rank(F.lit(""), F.lit("ab")),
        text.in_district(F.lit("경기 가람시 1"), F.lit("가람")), text.in_district(F.lit("전남 가람면"), F.lit("가람")), text.yes_no(F.lit(" Yes ")), text.yes_no(F.lit("없음")), text.yes_no(F.lit("?")), text.status(F.lit(None).cast("string")),
        text.number(F.lit("1.5 m")), text.number(F.lit("wide")), text.incline_degrees(F.lit("100%")), text.ends_in_consonant(F.lit("역")), text.ends_in_consonant(F.lit("대로")), text.client_tag(F.lit("a b/c!")), text.exit_number(F.lit(" 3-1번")), text.station_key(F.lit("가람 역")),
        text.split_node_id(F.lit("b"), F.lit("a")),
    )
    assert list(r)[:6] == [0, 1, 2, 3, None, None]
    assert list(r)[6:12] == [True, False, True, False, None, "unknown"]
    assert list(r)[12:14] == [1.5, None] and r[14] == pytest.approx(45)
    import hashlib

    assert list(r)[15:] == [True, False, "abc", "3-1", "가람", "S" + hashlib.sha1(b"a|b").hexdigest()[:15]]
