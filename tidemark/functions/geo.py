"""Distance and containment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = EARTH_RADIUS_KM * 3.141592653589793 / 180.0


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance; the guard keeps rounding from pushing asin out of range."""
    lon1, lat1, lon2, lat2 = (F.radians(F.col(c) if isinstance(c, str) else c)
                              for c in (lon1, lat1, lon2, lat2))
    a = (F.pow(F.sin((lat2 - lat1) / 2), 2)
         + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def ring_edges(rings: Column) -> Column:
    """``array<ring>`` to ``array<struct<x1,y1,x2,y2>>``; open rings are closed."""
    def edges(ring):
        closed = F.concat(ring, F.slice(ring, 1, 1))
        heads = F.slice(closed, 1, F.size(ring))
        tails = F.slice(closed, 2, F.size(ring))
        return F.zip_with(heads, tails, lambda a, b: F.struct(
            a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return F.flatten(F.transform(rings, edges))


def inside_edges(edges: Column, lon: Column, lat: Column, others: Column | int = 0) -> Column:
    """Even-odd test, strict: a point lying on an edge is outside. ``others``: crossings of edges that were left out."""
    def on_edge(e):
        cross = (e.x2 - e.x1) * (lat - e.y1) - (e.y2 - e.y1) * (lon - e.x1)
        return ((cross == 0)
                & lon.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
                & lat.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)))

    def crossed(e):
        straddles = (e.y1 > lat) != (e.y2 > lat)
        return straddles & (lon < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1)

    # a horizontal edge never straddles, so its zero denominator must not be evaluated
    def safe_crossed(e):
        return F.when(e.y1 == e.y2, F.lit(False)).otherwise(crossed(e))

    odd = (F.size(F.filter(edges, safe_crossed)) + others) % 2 == 1
    return odd & ~F.exists(edges, on_edge)
