"""Coordinates: affine transforms, projections with closed forms, areas and centres of rings, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of Web Mercator, and eccentricity of WGS84 (fixed values).
SPHERE = 6378137.0
ECC = 0.0818191908426215


def affine(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(c + a x + b y, f + d x + e y) for a transform (a, b, c, d, e, f)."""
    k = [F.get(t, F.lit(i)) for i in range(6)]
    return k[2] + k[0] * x + k[1] * y, k[5] + k[3] * x + k[4] * y


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) of Web Mercator."""
    return F.degrees(x / SPHERE), F.degrees(2 * F.atan(F.exp(y / SPHERE)) - math.pi / 2)


def utm_to_wgs84(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lon, lat) of Universal Transverse Mercator on WGS84, by Krueger's series in the third flattening, to its fourth power at least."""
    f = 1 - math.sqrt(1 - ECC**2)
    n = f / (2 - f)
    a = SPHERE / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480, 4397 * n**4 / 161280 - 11 * n**5 / 504,
    )
    xi, eta = (y - F.when(south, 1e7).otherwise(0.0)) / (0.9996 * a), (x - 5e5) / (0.9996 * a)
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi0, eta0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))  # the conformal latitude, and the geographic one from it
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105, 4279 * n**4 / 630 - 332 * n**5 / 35,
    )
    lat = chi
    for j, k in enumerate(delta, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(lat)


def to_wgs84(x: Column, y: Column, crs: Column) -> tuple[Column, Column]:
    """(lon, lat) for Web Mercator, geographic and UTM coordinates (EPSG:326zz and 327zz); NULL for other systems."""
    name = F.upper(F.trim(crs))
    zone = F.when(name.rlike("^EPSG:32[67][0-9]{2}$"), F.substring(name, 9, 2).cast("int"))
    zone = F.when(zone.between(1, 60), zone)
    pick = lambda m, g, u: F.when(name == "EPSG:3857", m).when(name == "EPSG:4326", g).when(zone.isNotNull(), u)
    return tuple(pick(*c) for c in zip(mercator_to_wgs84(x, y), (x, y), utm_to_wgs84(x, y, zone, F.substring(name, 8, 1) == "7"), strict=True))


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates (standard parallel 30 degrees) in metres."""
    s0 = math.sin(math.radians(30))
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - (ECC * s0) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - ECC**2) * (s / (1 - ECC**2 * s * s) - 1 / (2 * ECC) * F.log((1 - ECC * s) / (1 + ECC * s)))
    return SPHERE * k0 * F.radians(lon), SPHERE * q / (2 * k0)


def ring_area(ring: Column) -> Column:
    """Area of a ring, array<struct<x, y>>, open or closed."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n + 1).cast("int"))
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2).otherwise(0.0)


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2), p(x1, y1))


def clamped_box(box: Column, width: float, height: float) -> Column:
    """A box of four numbers inside a tile; NULL if it has not four or no area."""
    q = [F.try_element_at(box, F.lit(i + 1)) for i in range(4)]
    inside = [F.least(F.greatest(v, F.lit(0.0)), F.lit(float(m))) for v, m in zip(q, (width, height, width, height), strict=True)]
    return F.when((F.size(box) == 4) & (inside[2] > inside[0]) & (inside[3] > inside[1]), F.array(*inside))


def yolo_box(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """Centre and size as shares of an image, clamped to it."""
    part = lambda v, m: F.least(F.greatest(v / m, F.lit(0.0)), F.lit(1.0))
    return F.struct(part(x + w / 2, width).alias("cx"), part(y + h / 2, height).alias("cy"), part(w, width).alias("w"), part(h, height).alias("h"))


def cells_of_radius(radius: Column, cell: float) -> Column:
    """A radius in cells, 1 at least, half to even."""
    return F.greatest(F.lit(1), F.bround(radius / cell).cast("int"))


def stencil_cells(radius: Column, cell: float, least: int = 10, most: int = 50) -> Column:
    """A radius in cells within the bounds of the local relief filter (fixed values)."""
    return F.least(F.greatest(cells_of_radius(radius, cell), F.lit(least)), F.lit(most))


def halo(cell: float, radii: tuple[float, ...] = (), sigma: float = 0.0, position_radii: tuple[int, ...] = ()) -> int:
    """Cells around a tile that its stencils reach: radii in metres, the others in cells; two at least, which is what curvature needs."""
    return max(2, math.ceil(max(radii, default=0.0) / cell), math.ceil(4 * sigma), *position_radii)
