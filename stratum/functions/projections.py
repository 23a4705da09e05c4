"""Projections of whole arrays, both ways, through longitude and latitude: geographic, Web Mercator and UTM on WGS84.

UTM by Krueger's series in the third flattening, as far as the sixth power of it.
"""

from __future__ import annotations

import math
import re

import numpy as np

from stratum.functions.geo import ECC, SPHERE

_F = 1 - math.sqrt(1 - ECC**2)
_N = _F / (2 - _F)
_RADIUS = SPHERE / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Krueger's coefficients, from the conformal latitude to the plane and back.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880, 49561 * _N**4 / 161280 - 179 * _N**5 / 168,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480, 4397 * _N**4 / 161280 - 11 * _N**5 / 504,
)


def _zone(crs: str) -> tuple[int, bool] | None:
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", crs.strip().upper())
    return (int(m[2]), m[1] == "7") if m and 1 <= int(m[2]) <= 60 else None


def known(crs: str | None) -> bool:
    return bool(crs) and (crs.strip().upper() in ("EPSG:4326", "EPSG:3857") or _zone(crs) is not None)


def to_lonlat(crs: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = crs.strip().upper()
    if name == "EPSG:4326":
        return x, y
    if name == "EPSG:3857":
        return np.degrees(x / SPHERE), np.degrees(2 * np.arctan(np.exp(y / SPHERE)) - math.pi / 2)
    if (found := _zone(crs)) is None:
        raise ValueError(f"unknown coordinate system {crs}")
    zone, south = found
    xi, eta = (y - (1e7 if south else 0.0)) / (0.9996 * _RADIUS), (x - 5e5) / (0.9996 * _RADIUS)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a, b = a - k * np.sin(2 * j * xi) * np.cosh(2 * j * eta), b - k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    tau = np.sin(a) / np.hypot(np.sinh(b), np.cos(a))
    t = tau
    for _ in range(6):  # the geographic latitude's tangent from the conformal one's
        s = np.sinh(ECC * np.arctanh(ECC * t / np.hypot(1, t)))
        now = t * np.hypot(1, s) - s * np.hypot(1, t)
        t = t + (tau - now) / np.hypot(1, now) * (1 + (1 - ECC**2) * t * t) / ((1 - ECC**2) * np.hypot(1, t))
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(b), np.cos(a))), np.degrees(np.arctan(t))


def from_lonlat(crs: str, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = crs.strip().upper()
    if name == "EPSG:4326":
        return lon, lat
    if name == "EPSG:3857":
        return SPHERE * np.radians(lon), SPHERE * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))
    if (found := _zone(crs)) is None:
        raise ValueError(f"unknown coordinate system {crs}")
    zone, south = found
    t, turn = np.tan(np.radians(lat)), np.radians(lon - (zone * 6 - 183))
    s = np.sinh(ECC * np.arctanh(ECC * t / np.hypot(1, t)))
    t = t * np.hypot(1, s) - s * np.hypot(1, t)
    xi, eta = np.arctan2(t, np.cos(turn)), np.arcsinh(np.sin(turn) / np.hypot(t, np.cos(turn)))
    a, b = xi, eta
    for j, k in enumerate(_ALPHA, 1):
        a, b = a + k * np.sin(2 * j * xi) * np.cosh(2 * j * eta), b + k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return 5e5 + 0.9996 * _RADIUS * b, (1e7 if south else 0.0) + 0.9996 * _RADIUS * a


def between(a: str, b: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, y) if a.strip().upper() == b.strip().upper() else from_lonlat(b, *to_lonlat(a, x, y))
