"""Geometry as column expressions: distances, projection, boxes, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
SQUARE_M_PER_ACRE = 4046.8564224

# Sphere, reference longitude and parallel of the model grid's conic projection.
SPHERE_M = 6371229.0
LON_0 = -97.5
LAT_0 = 38.5

# Bounds of the model grid in projected metres (xmin, ymin, xmax, ymax).
GRID_DOMAIN = (-2697520.1425219304, -1587306.1525566636, 2696479.8574780696, 1586693.8474433364)

# Footprint of the geostationary imager (min lon, min lat, max lon, max lat).
IMAGER_FOOTPRINT = (-140.7, 14.0, -49.0, 53.0)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(half))


def bbox_distance_km(lat, lon, min_lon, min_lat, max_lon, max_lat) -> Column:
    lat, lon = _col(lat), _col(lon)
    near_lon = F.least(F.greatest(lon, _col(min_lon)), _col(max_lon))
    near_lat = F.least(F.greatest(lat, _col(min_lat)), _col(max_lat))
    return haversine_km(lat, lon, near_lat, near_lon)


def bbox_radius_km(min_lon, min_lat, max_lon, max_lat) -> Column:
    return haversine_km(min_lat, min_lon, max_lat, max_lon) / 2


def project(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Longitude and latitude to grid metres on a cone tangent at one parallel."""
    n = math.sin(math.radians(LAT_0))
    scale = math.cos(math.radians(LAT_0)) * math.tan(math.pi / 4 + math.radians(LAT_0) / 2) ** n / n
    rho0 = SPHERE_M * scale / math.tan(math.pi / 4 + math.radians(LAT_0) / 2) ** n
    rho = F.lit(SPHERE_M * scale) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2), F.lit(n))
    theta = F.radians(_col(lon) - LON_0) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def unproject(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Grid metres back to longitude and latitude."""
    n = math.sin(math.radians(LAT_0))
    scale = math.cos(math.radians(LAT_0)) * math.tan(math.pi / 4 + math.radians(LAT_0) / 2) ** n / n
    rho0 = SPHERE_M * scale / math.tan(math.pi / 4 + math.radians(LAT_0) / 2) ** n
    x, down = _col(x), F.lit(rho0) - _col(y)
    rho = F.sqrt(x * x + down * down)
    lon = F.degrees(F.atan2(x, down) / n) + LON_0
    lat = F.degrees(F.atan(F.pow(F.lit(SPHERE_M * scale) / rho, F.lit(1 / n))) * 2 - math.pi / 2)
    return lon, lat


def projected_box(min_lon, min_lat, max_lon, max_lat, buffer_km: float) -> tuple[Column, Column, Column, Column]:
    """Projected corners of a lon/lat box, widened by a buffer: xmin, ymin, xmax, ymax."""
    x0, y0 = project(min_lon, min_lat)
    x1, y1 = project(max_lon, max_lat)
    pad = buffer_km * 1000.0
    return F.least(x0, x1) - pad, F.least(y0, y1) - pad, F.greatest(x0, x1) + pad, F.greatest(y0, y1) + pad


def boxes_intersect(a: tuple, b: tuple) -> Column:
    """Closed boxes (xmin, ymin, xmax, ymax) share a point."""
    axmin, aymin, axmax, aymax = (F.lit(v) if isinstance(v, (int, float)) else _col(v) for v in a)
    bxmin, bymin, bxmax, bymax = (F.lit(v) if isinstance(v, (int, float)) else _col(v) for v in b)
    return ~((axmax < bxmin) | (axmin > bxmax) | (aymax < bymin) | (aymin > bymax))


def ring_bounds(rings: Column | str) -> tuple[Column, Column, Column, Column]:
    """min lon, min lat, max lon, max lat over every ring."""
    points = F.flatten(_col(rings))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_edges(rings: Column | str) -> Column:
    """Every ring as directed edges (x1, y1, x2, y2); rings repeat their first point at the end."""

    def edges(ring: Column) -> Column:
        pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1))
        return F.transform(
            pairs,
            lambda p: F.struct(
                p["0"]["x"].alias("x1"), p["0"]["y"].alias("y1"), p["1"]["x"].alias("x2"), p["1"]["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(F.filter(_col(rings), lambda r: F.size(r) >= 2), edges))


def strictly_inside(x: Column | str, y: Column | str, edges: Column | str) -> Column:
    """Even-odd test over edges, holes included; a point on an edge is outside.

    One pass over the edges: state 0 or 1 is the parity so far, 2 means the point lies on an edge.
    """
    x, y, edges = _col(x), _col(y), _col(edges)

    def step(state: Column, e: Column) -> Column:
        low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        touches = (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        crosses = (y < high) & ((e["y2"] > e["y1"]) == (cross > 0))
        return (
            F.when((state == 2) | (y < low) | (y > high), state).when(touches, 2).when(crosses, 1 - state).otherwise(state)
        )

    return F.aggregate(edges, F.lit(0), step) == 1


def polygon_acres(rings: Column | str) -> Column:
    """Area on the sphere, holes subtracted (outer rings and holes run in opposite directions)."""

    def part(e: Column) -> Column:
        return F.radians(e["x2"] - e["x1"]) * (F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"])))

    signed = F.aggregate(ring_edges(rings), F.lit(0.0), lambda acc, e: acc + part(e))
    radius = EARTH_RADIUS_KM * 1000.0
    return F.abs(signed) * (radius * radius / 2.0 / SQUARE_M_PER_ACRE)


def in_footprint(lon: Column | str, lat: Column | str) -> Column:
    west, south, east, north = IMAGER_FOOTPRINT
    return _col(lon).between(west, east) & _col(lat).between(south, north)


def gridded_index(value: Column, low: Column, high: Column, size: int) -> Column:
    """Lattice index of a coordinate, half-even, lattice ends on the bounds."""
    position = F.rint((value - low) / (high - low) * (size - 1))
    return F.least(F.greatest(position, F.lit(0)), F.lit(size - 1)).cast("int")


# Wide envelope of the country with Alaska and Hawaii (min lon, min lat, max lon, max lat).
COUNTRY_ENVELOPE = (-170.0, 18.0, -65.0, 72.0)
