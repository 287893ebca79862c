"""Reference systems as Column expressions, or as floats on the driver.

EPSG:4326, 3857, 326xx and 327xx (UTM, by Krueger's series to the fourth order),
3995 and 3031 (polar stereographic, after Snyder).  Each formula is written once
over a namespace ``m`` of functions: ``pyspark.sql.functions`` for columns,
``math`` for single points.  Accuracy is under a millimetre within a zone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F

A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> tuple[float, ...]:
    """Coefficients from their polynomials in n, lowest power first."""
    return tuple(sum(c * _N ** (k + 1) for k, c in enumerate(r)) for r in rows)


# The series' coefficients.
ALPHA = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BETA = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
DELTA = _series((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
CHI = (
    E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360,
    7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520,
    7 * E2**3 / 120 + 81 * E2**4 / 1120,
    4279 * E2**4 / 161280,
)


def code(crs: str) -> int:
    """The number of an EPSG code, in whatever case and form it is written."""
    digits = str(crs).strip().upper().removeprefix("EPSG:")
    if not digits.isdigit():
        raise ValueError(f"unknown reference system {crs!r}")
    n = int(digits)
    if n in (4326, 3857, 3995, 3031) or (n // 100 in (326, 327) and 1 <= n % 100 <= 60):
        return n
    raise ValueError(f"unsupported reference system {crs!r}")


def same(a: str, b: str) -> bool:
    return code(a) == code(b)


def _mercator(m):
    def there(lon, lat):
        return A * m.radians(lon), A * m.asinh(m.tan(m.radians(lat)))

    def back(x, y):
        return m.degrees(x / A), m.degrees(m.atan(m.sinh(y / A)))

    return there, back


def _utm(n: int, m):
    zone, south = n % 100, n // 100 == 327
    middle = zone * 6 - 183
    north0 = FALSE_NORTH if south else 0.0
    c = 2 * math.sqrt(_N) / (1 + _N)

    def there(lon, lat):
        s = m.sin(m.radians(lat))
        t = m.sinh(m.atanh(s) - c * m.atanh(c * s))
        d = m.radians(lon - middle)
        xi, eta = m.atan2(t, m.cos(d)), m.atanh(m.sin(d) / m.sqrt(1 + t * t))
        x, y = eta, xi
        for k, a in enumerate(ALPHA, 1):
            x = x + a * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
            y = y + a * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
        return K0 * _RADIUS * x + FALSE_EAST, K0 * _RADIUS * y + north0

    def back(x, y):
        xi, eta = (y - north0) / (K0 * _RADIUS), (x - FALSE_EAST) / (K0 * _RADIUS)
        p, q = xi, eta
        for k, b in enumerate(BETA, 1):
            p = p - b * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
            q = q - b * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        chi = m.asin(m.sin(p) / m.cosh(q))
        lat = chi
        for k, d in enumerate(DELTA, 1):
            lat = lat + d * m.sin(2 * k * chi)
        return middle + m.degrees(m.atan2(m.sinh(q), m.cos(p))), m.degrees(lat)

    return there, back


def _polar(n: int, m):
    sign = 1.0 if n == 3995 else -1.0
    ts = math.radians(71.0)

    def reduced(lat, m):
        s = E * m.sin(lat)
        return m.tan(math.pi / 4 - lat / 2) / m.pow((1 - s) / (1 + s), E / 2)

    unit = A * math.cos(ts) / math.sqrt(1 - E2 * math.sin(ts) ** 2) / reduced(ts, math)

    def there(lon, lat):
        r = unit * reduced(m.radians(lat) * sign, m)
        return r * m.sin(m.radians(lon)), r * m.cos(m.radians(lon)) * -sign

    def back(x, y):
        chi = math.pi / 2 - 2 * m.atan(m.hypot(x, y) / unit)
        lat = chi
        for k, c in enumerate(CHI, 1):
            lat = lat + c * m.sin(2 * k * chi)
        return m.degrees(m.atan2(x, y * -sign)), m.degrees(lat) * sign

    return there, back


def _pair(crs: str, m) -> tuple[Callable, Callable]:
    n = code(crs)
    if n == 4326:
        return (lambda x, y: (x, y),) * 2
    if n == 3857:
        return _mercator(m)
    return _polar(n, m) if n in (3995, 3031) else _utm(n, m)


def forward(crs: str, m=F) -> Callable:
    """Longitude and latitude in degrees to the system's x and y."""
    return _pair(crs, m)[0]


def inverse(crs: str, m=F) -> Callable:
    return _pair(crs, m)[1]


def between(source: str, target: str, m=F) -> Callable:
    """x and y of one system to those of another."""
    if same(source, target):
        return lambda x, y: (x, y)
    back, there = inverse(source, m), forward(target, m)
    return lambda x, y: there(*back(x, y))


def suggested_grid(source: str, target: str, width: int, height: int, bounds: tuple[float, float, float, float], edge: int = 21) -> tuple[tuple[float, ...], int, int]:
    """Transform, width and height that hold a raster in another system.

    The resolution keeps the number of pixels along the diagonal; the extent is
    that of the outline's points.  A transform is (a, b, c, d, e, f) with
    x = a col + b row + c and y = d col + e row + f.
    """
    w, s, e, n = bounds
    go = between(source, target, math)
    steps = [k / (edge - 1) for k in range(edge)]
    outline = [go(w + (e - w) * t, y) for t in steps for y in (s, n)] + [go(x, s + (n - s) * t) for t in steps for x in (w, e)]
    xs, ys = [p[0] for p in outline], [p[1] for p in outline]
    (x0, y0), (x1, y1) = go(w, n), go(e, s)
    size = math.hypot(x1 - x0, y1 - y0) / math.hypot(width, height)
    cols, rows = (max(1, math.ceil((max(v) - min(v)) / size - 1e-9)) for v in (xs, ys))
    return (size, 0.0, min(xs), 0.0, -size, max(ys)), cols, rows
