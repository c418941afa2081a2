"""How a query registers itself with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from stepfree.sources.driver import Domain, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None) -> Callable:
    """Registers f(domain) under its name; sql is DuckDB text over the domain's views."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"


def seg(lat: str, lng: str, a: str, b: str, lat0: str | None = None) -> str:
    """Distance to the segment a.lat, a.lng to b.lat, b.lng."""
    kx = f"(111320.0 * cos(radians({lat0 or f'({a}.lat + {b}.lat) / 2'})))"
    ax, ay = f"(({a}.lng - {lng}) * {kx})", f"(({a}.lat - {lat}) * 110540.0)"
    dx, dy = f"(({b}.lng - {a}.lng) * {kx})", f"(({b}.lat - {a}.lat) * 110540.0)"
    t = f"greatest(0.0, least(1.0, -({ax} * {dx} + {ay} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"
