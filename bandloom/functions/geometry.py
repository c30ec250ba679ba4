"""Column functions on rings and positions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def ring_edges(ring: Column) -> Column:
    """Edges of a ring as structs (x1, y1, x2, y2); the last one closes it."""
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p["x"].alias("x1"),
            p["y"].alias("y1"),
            F.get(ring, (i + 1) % F.size(ring))["x"].alias("x2"),
            F.get(ring, (i + 1) % F.size(ring))["y"].alias("y2"),
        ),
    )


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: does a ray to the right cross an odd number of edges?"""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"]
        return spans & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}


def signed_area(ring: Column) -> Column:
    """Twice-halved cross product sum; 0 for degenerate rings."""
    cross = F.transform(ring_edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2.0


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a ring; NULL when it has no area."""
    area6 = signed_area(ring) * 6.0

    def moment(a: str, b: str) -> Column:
        parts = F.transform(
            ring_edges(ring), lambda e: (e[a] + e[b]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])
        )
        return F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), area6)

    return moment("x1", "x2"), moment("y1", "y2")


def valid_ring(ring: Column) -> Column:
    """A usable geometry: at least three corners and some area."""
    return F.coalesce((F.size(ring) >= 3) & (F.abs(signed_area(ring)) > 0), F.lit(False))


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for p, q in zip(a, b):
        term = (p - q) * (p - q)
        total = term if total is None else total + term
    return F.sqrt(total)


def geocentric(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Cartesian position of a point on the ellipsoid.

    A straight line is never longer than the geodesic, so cells of the radius
    hold every neighbour within that geodesic distance.
    """
    e2 = WGS84_F * (2 - WGS84_F)
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1.0 - e2 * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1.0 - e2) * F.sin(phi)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Great-circle distance in metres on a sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2.0 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _vincenty(lon1, lat1, lon2, lat2):
    """Inverse geodesic on WGS84 by fixed-point iteration (Vincenty 1975)."""
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(v))) for v in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = np.radians(lon2) - np.radians(lon1)
    lam = gap.copy()
    for _ in range(200):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
        cs = su1 * su2 + cu1 * cu2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / np.where(ss == 0, 1.0, ss))
        c2a = 1 - sa**2
        c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1.0, c2a))
        c = WGS84_F / 16 * c2a * (4 + WGS84_F * (4 - 3 * c2a))
        new = gap + (1 - c) * WGS84_F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        if np.all(np.abs(new - lam) < 1e-12):
            break
        lam = new
    k = c2a * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    turn = big_b * ss * (
        c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3))
    )
    return np.where(ss == 0, 0.0, b * big_a * (sigma - turn))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Geodesic distance in metres on WGS84, computed batch by batch."""

    @F.pandas_udf("double")
    def solve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        args = [v.to_numpy(dtype=float) for v in (a, b, c, d)]
        return pd.Series(_vincenty(*args))

    return solve(lon1, lat1, lon2, lat2)
