"""Names, flags and numbers as the source tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of administrative districts, and words that count as yes.
DISTRICT_SUFFIXES = ("시", "군", "구")
YES = ("y", "yes", "true", "1", "있음", "o", "t")
NO = ("n", "no", "false", "0", "없음", "x", "f")


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s\-_·.,()]+", "")


def match_rank(query: Column, name: Column) -> Column:
    """0 equal, 1 prefix, 2 contained, 3 the name (3 characters or more) is contained in the query, else null."""
    q, n = name_key(query), name_key(name)
    return F.when((q == "") | (n == ""), None).when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2).when((F.length(n) >= 3) & q.contains(n), 3)


def company_key(name: Column) -> Column:
    return name_key(F.regexp_replace(F.coalesce(name, F.lit("")), "㈜|\\(주\\)|주식회사|안양", ""))


def toilet_key(name: Column) -> Column:
    return name_key(F.regexp_replace(F.coalesce(name, F.lit("")), "화장실|공중|개방|장애인", ""))


def district_variants(name: Column) -> Column:
    """The name itself if it ends like a district, else the name with each suffix."""
    s = F.trim(F.coalesce(name, F.lit("")))
    ends = s.substr(F.length(s), F.lit(1)).isin(*DISTRICT_SUFFIXES)
    return F.when(s == "", F.array().cast("array<string>")).when(ends, F.array(s)).otherwise(F.array(*[F.concat(s, F.lit(x)) for x in DISTRICT_SUFFIXES]))


def in_district(address: Column, name: Column) -> Column:
    return F.exists(district_variants(name), lambda v: F.coalesce(address, F.lit("")).contains(v))


def yes_no(x: Column) -> Column:
    """True, false, or null where it is unknown."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False)


def status(x: Column) -> Column:
    return F.when(yes_no(x), "yes").when(~yes_no(x), "no").otherwise("unknown")


def number(x: Column) -> Column:
    """A number, or null for anything else."""
    return F.expr("try_cast(null as double)") if x is None else F.regexp_replace(x.cast("string"), r"[m%\s]", "").try_cast("double")


def incline_degrees(x: Column) -> Column:
    """An incline of ``p%`` or in degrees."""
    return F.when(x.endswith("%"), F.degrees(F.atan(number(x) / 100))).otherwise(number(x))


def ends_in_consonant(word: Column) -> Column:
    """Whether a Hangul word ends in a final consonant."""
    code = F.ascii(F.right(word, F.lit(1)))
    return (code >= 44032) & (code <= 55203) & ((code - 44032) % 28 != 0)


def client_tag(x: Column) -> Column:
    return F.nullif(F.left(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9_.@-]", ""), F.lit(40)), F.lit(""))


def exit_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*(\d+(?:-\d+)?)", 1), F.lit(""))


def station_key(x: Column) -> Column:
    return F.regexp_replace(name_key(x), "역$", "")


def split_node_id(a: Column, b: Column) -> Column:
    """Id of a node made by splitting a link: of its ends in string order."""
    return F.concat(F.lit("S"), F.substring(F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b))), 1, 15))


def car_door(x: Column) -> Column:
    """Car and door of a platform place like ``3-2 출입문``; null if there is none."""
    pattern = r"(\d{1,2})-(\d) 출입문"
    return F.when(x.rlike(pattern), F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("car"), F.regexp_extract(x, pattern, 2).cast("int").alias("door")))


def oriented(line: Column, start: Column) -> Column:
    """A line of points (lat, lng, ...) as it is walked from the start: reversed if its last point is closer."""
    from .geo import haversine

    away = lambda p: haversine(p["lat"], p["lng"], start["lat"], start["lng"])
    return F.when(away(F.element_at(line, -1)) < away(F.element_at(line, 1)), F.reverse(line)).otherwise(line)
