"""Geographic and UTM coordinates by Krueger's series to the fourth order (Karney 2011)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: WGS 84 and UTM
A, FLAT = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING = 0.9996, 500000.0

N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# series coefficients of the forward and the inverse projection and of the latitude
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
E2 = FLAT * (2 - FLAT)
E1 = E2**0.5


def utm_forward(lon: Column, lat: Column, zone: int = 43) -> tuple[Column, Column]:
    """Easting and northing in metres (northern hemisphere)."""
    lam, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.atanh(s * E1) * E1)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return east * (SCALE * RADIUS) + FALSE_EASTING, north * (SCALE * RADIUS)


def utm_inverse(x: Column, y: Column, zone: int = 43) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = y / (SCALE * RADIUS), (x - FALSE_EASTING) / (SCALE * RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        eta1 = eta1 - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + F.sin(chi * (2 * j)) * d
    return F.degrees(lam) + (zone * 6 - 183), F.degrees(lat)
