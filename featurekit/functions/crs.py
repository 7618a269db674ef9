"""Coordinate reference systems by closed formulas: longitude and latitude, and transverse Mercator, Lambert conformal
conic, Lambert azimuthal equal-area, Albers and two cylindrical grids on datums that agree with WGS 84 within a metre; and
transverse Mercator grids on other datums, by a shift of seven parameters.

The formulas hold for numbers, columns and arrays. From degrees to a grid of the first kind they are column expressions;
where a grid has to be left, which would repeat long expressions within one another, they work on the flat coordinates of
Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache, cached_property
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from featurekit.functions.geometry import TYPE, map_points

#: WGS 84 (GRS 80 differs by less than 0.1 mm in these formulas) and what follows from it. Fixed values.
A, INVERSE_F = 6378137.0, 298.257223563
_F = 1 / INVERSE_F
E2 = _F * (2 - _F)
E = math.sqrt(E2)
_N = _F / (2 - _F)
K6933 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
QP = 1 - (1 - E2) / (2 * E) * math.log((1 - E) / (1 + E))
#: The series of latitude by the authalic one, in powers of the third flattening. Fixed values.
_AUTHALIC = (4 * _N / 3 + 4 * _N**2 / 45 - 16 * _N**3 / 35 - 2582 * _N**4 / 14175, 46 * _N**2 / 45 + 152 * _N**3 / 945 - 11966 * _N**4 / 14175, 3044 * _N**3 / 2835 + 3802 * _N**4 / 14175, 6059 * _N**4 / 4725)


@dataclass(frozen=True)
class Ellipsoid:
    """A figure of the Earth by its equator's radius and inverse flattening."""

    a: float
    inverse_f: float

    @cached_property
    def e2(self) -> float:
        return (2 - 1 / self.inverse_f) / self.inverse_f

    @cached_property
    def n(self) -> float:
        """The third flattening."""
        return 1 / (2 * self.inverse_f - 1)

    def series(self, name: str) -> tuple[float, ...]:
        """Coefficients of a series, by their polynomials of the third flattening."""
        return tuple(sum(c * self.n**k for k, c in enumerate(row, 1)) for row in _POLYNOMIALS[name])

    def geocentric(self, m, lon, lat) -> tuple[Any, Any, Any]:
        """Metres from the Earth's centre, of degrees on the ellipsoid."""
        lam, phi = m.radians(lon), m.radians(lat)
        r = self.a / m.sqrt(1 - m.sin(phi) * m.sin(phi) * self.e2)
        return r * m.cos(phi) * m.cos(lam), r * m.cos(phi) * m.sin(lam), r * m.sin(phi) * (1 - self.e2)

    def geodetic(self, m, x, y, z) -> tuple[Any, Any]:
        """Degrees of metres from the centre, without the height; exact to a hundredth of a millimetre near the ground."""
        b, p = self.a * math.sqrt(1 - self.e2), m.sqrt(x * x + y * y)
        t = m.atan2(z * self.a, p * b)
        up, out = z + m.sin(t) ** 3 * (b * self.e2 / (1 - self.e2)), p - m.cos(t) ** 3 * (self.a * self.e2)
        return m.degrees(m.atan2(y, x)), m.degrees(m.atan2(up, out))


#: Series of transverse Mercator forward and inverse, and of latitude by the conformal one: coefficients of the powers of
#: the third flattening. Fixed values.
_POLYNOMIALS = {
    "alpha": ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280)),
    "beta": ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280)),
    "conformal": ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630)),
}
WGS84, BESSEL, AIRY = Ellipsoid(A, INVERSE_F), Ellipsoid(6377397.155, 299.1528128), Ellipsoid(6377563.396, 299.3249646)
#: Other systems of longitude and latitude: ellipsoid, and the shift to WGS 84: metres, seconds of arc (position vector) and
#: parts in a million. Fixed values.
DATUMS: dict[int, tuple[Ellipsoid, tuple[float, ...]]] = {
    4277: (AIRY, (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)),
    4312: (BESSEL, (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)),
    4314: (BESSEL, (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
}


def shifted(x, y, z, shift: tuple[float, ...], back: bool = False) -> tuple[Any, Any, Any]:
    """Metres from the centre after a shift of seven parameters, or before it: a turn, a stretch, and a step."""
    step = shift[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in shift[3:6])
    turn = np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]) * (1 + shift[6] * 1e-6)
    if back:
        x, y, z = x - step[0], y - step[1], z - step[2]
        turn, step = np.linalg.inv(turn), (0, 0, 0)
    return tuple(x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + d for r, d in zip(turn, step, strict=True))


def code(crs: str | int | None) -> int | None:
    """The EPSG number of "EPSG:4326", 4326, "OGC:CRS84" and the like."""
    if crs is None or isinstance(crs, int):
        return crs
    text = str(crs).upper()
    if text.endswith("CRS84"):
        return 4326
    digits = text.rpartition(":")[2]
    if not digits.isdigit():
        raise ValueError(f"Unknown CRS: {crs}")
    return int(digits)


#: Systems of longitude and latitude, whose datums agree with WGS 84 within a metre. Fixed values.
GEOGRAPHIC = {4326, 4258, 4269, 4283, 4167, 7844}
#: Grids by EPSG number: kind, latitude and longitude of the origin, false easting and northing, and the scale factor or
#: the two standard parallels. Fixed values.
GRIDS: dict[int, tuple[str, float, float, float, float, tuple[float, ...]]] = {
    2154: ("lcc", 46.5, 3, 700000, 6600000, (49, 44)),
    2157: ("tm", 53.5, -8, 600000, 750000, (0.99982,)),
    2180: ("tm", 0, 19, 500000, -5300000, (0.9993,)),
    2193: ("tm", 0, 173, 1600000, 10000000, (0.9996,)),
    3005: ("aea", 45, -126, 1000000, 0, (50, 58.5)),
    3006: ("tm", 0, 15, 500000, 0, (0.9996,)),
    3034: ("lcc", 52, 10, 4000000, 2800000, (35, 65)),
    3035: ("laea", 52, 10, 4321000, 3210000, ()),
    3059: ("tm", 0, 24, 500000, -6000000, (0.9996,)),
    3067: ("tm", 0, 27, 500000, 0, (0.9996,)),
    3301: ("lcc", 57.51755393055556, 24, 500000, 6375000, (59.333333333333336, 58)),
    3338: ("aea", 50, -154, 0, 0, (55, 65)),
    3346: ("tm", 0, 24, 500000, 0, (0.9998,)),
    3347: ("lcc", 63.390675, -91.86666666666666, 6200000, 3000000, (49, 77)),
    3577: ("aea", 0, 132, 0, 0, (-18, -36)),
    3763: ("tm", 39.66825833333333, -8.133108333333334, 0, 0, (1,)),
    3765: ("tm", 0, 16.5, 500000, 0, (0.9999,)),
    3794: ("tm", 0, 15, 500000, -5000000, (0.9999,)),
    3812: ("lcc", 50.797815, 4.359215833333333, 649328, 665262, (49.833333333333336, 51.166666666666664)),
    3978: ("lcc", 49, -95, 0, 0, (49, 77)),
    5070: ("aea", 23, -96, 0, 0, (29.5, 45.5)),
}
#: UTM zones by what stands before the zone's number: the hemisphere's false northing, and the zones there are.
ZONES = {25800: (0, range(28, 39)), 26900: (0, range(1, 24)), 28300: (1e7, range(48, 59)), 32600: (0, range(1, 61)), 32700: (1e7, range(1, 61)), 7800: (1e7, range(46, 60))}


class _Columns:
    """The functions that the formulas need, over columns; over numbers the module math has the same names."""

    sin, cos, tan, asin, atan, atan2, sinh, cosh, atanh, exp, log, sqrt, radians, degrees = (staticmethod(getattr(F, n)) for n in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "atanh", "exp", "log", "sqrt", "radians", "degrees"))


class _Arrays:
    """The same over arrays."""

    sin, cos, tan, sinh, cosh, exp, log, sqrt, radians, degrees = np.sin, np.cos, np.tan, np.sinh, np.cosh, np.exp, np.log, np.sqrt, np.radians, np.degrees
    asin, atan, atan2, atanh = np.arcsin, np.arctan, np.arctan2, np.arctanh


def _isometric(m, s, e=E):
    """Isometric latitude of the sine of a latitude."""
    return m.atanh(s) - m.atanh(s * e) * e


def _series(m, angle, coefficients):
    """An angle and its correction by sines of its multiples."""
    out = angle
    for j, a in enumerate(coefficients, 1):
        out = out + m.sin(angle * (2 * j)) * a
    return out


def _from_isometric(m, psi, on=WGS84):
    """The latitude, by way of the conformal one."""
    return _series(m, m.atan(m.exp(psi)) * 2 - math.pi / 2, on.series("conformal"))


def _authalic(m, s):
    """q, of which equal areas are equal steps, of the sine of a latitude."""
    return (s / (1 - s * s * E2) - m.log((1 - s * E) / (1 + s * E)) / (2 * E)) * (1 - E2)


def _parallel(lat: float) -> float:
    """Radius of a parallel, as a part of the equator's."""
    return math.cos(math.radians(lat)) / math.sqrt(1 - E2 * math.sin(math.radians(lat)) ** 2)


@dataclass(frozen=True)
class Grid:
    """A system of metres: forward from, and inverse to, an angle from the origin's meridian and a latitude in radians."""

    lat0: float
    lon0: float
    east: float
    north: float
    rest: tuple[float, ...]
    #: The system of longitude and latitude that the grid lies on.
    base: int = 4326

    def forward(self, m, lam, lat) -> tuple[Any, Any]:
        raise NotImplementedError

    def inverse(self, m, x, y) -> tuple[Any, Any]:
        raise NotImplementedError


class TransverseMercator(Grid):
    @cached_property
    def on(self) -> Ellipsoid:
        return DATUMS[self.base][0] if self.base in DATUMS else WGS84

    @cached_property
    def scale(self) -> float:
        n = self.on.n
        return self.rest[0] * self.on.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @cached_property
    def start(self) -> float:
        """Northing of the origin's parallel without a false one."""
        return self._raw(math, 0.0, math.radians(self.lat0))[1]

    def _raw(self, m, lam, lat):
        t = m.sinh(_isometric(m, m.sin(lat), math.sqrt(self.on.e2)))
        xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / (1 + t * t) ** 0.5)
        x, y = eta, xi
        for j, a in enumerate(self.on.series("alpha"), 1):
            x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
            y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
        return x * self.scale, y * self.scale

    def forward(self, m, lam, lat):
        x, y = self._raw(m, lam, lat)
        return x, y - self.start

    def inverse(self, m, x, y):
        xi, eta = (y + self.start) / self.scale, x / self.scale
        u, v = xi, eta
        for j, b in enumerate(self.on.series("beta"), 1):
            u = u - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
            v = v - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
        return m.atan2(m.sinh(v), m.cos(u)), _from_isometric(m, m.atanh(m.sin(u) / m.cosh(v)), self.on)


class Conic(Grid):
    """What Lambert's and Albers' cones share: a radius of each parallel, and a share of the circle."""

    n: float

    def radius(self, m, lat):
        raise NotImplementedError

    def latitude(self, m, radius):
        raise NotImplementedError

    def forward(self, m, lam, lat):
        r = self.radius(m, lat)
        return m.sin(lam * self.n) * r, m.cos(lam * self.n) * -r + self.radius(math, math.radians(self.lat0))

    def inverse(self, m, x, y):
        sign = math.copysign(1, self.n)
        down = self.radius(math, math.radians(self.lat0)) - y
        return m.atan2(x * sign, down * sign) / self.n, self.latitude(m, m.sqrt(x * x + down * down) * sign)


class LambertConic(Conic):
    @cached_property
    def n(self) -> float:
        (a, b), psi = self.rest, lambda lat: _isometric(math, math.sin(math.radians(lat)))
        return (math.log(_parallel(a)) - math.log(_parallel(b))) / (psi(b) - psi(a))

    @cached_property
    def scale(self) -> float:
        a = self.rest[0]
        return A * _parallel(a) / self.n * math.exp(self.n * _isometric(math, math.sin(math.radians(a))))

    def radius(self, m, lat):
        return m.exp(_isometric(m, m.sin(lat)) * -self.n) * self.scale

    def latitude(self, m, radius):
        return _from_isometric(m, m.log(radius / self.scale) / -self.n)


class Albers(Conic):
    @cached_property
    def n(self) -> float:
        a, b = self.rest
        return (_parallel(a) ** 2 - _parallel(b) ** 2) / (_authalic(math, math.sin(math.radians(b))) - _authalic(math, math.sin(math.radians(a))))

    @cached_property
    def c(self) -> float:
        a = self.rest[0]
        return _parallel(a) ** 2 + self.n * _authalic(math, math.sin(math.radians(a)))

    def radius(self, m, lat):
        return m.sqrt(_authalic(m, m.sin(lat)) * -self.n + self.c) * (A / self.n)

    def latitude(self, m, radius):
        return _series(m, m.asin((radius * radius * -((self.n / A) ** 2) + self.c) / (self.n * QP)), _AUTHALIC)


class LambertAzimuthal(Grid):
    @cached_property
    def turn(self) -> tuple[float, float, float, float]:
        """Radius of the sphere of equal area, sine and cosine of the origin's authalic latitude, and the stretch there."""
        beta = math.asin(_authalic(math, math.sin(math.radians(self.lat0))) / QP)
        r = A * math.sqrt(QP / 2)
        return r, math.sin(beta), math.cos(beta), A * _parallel(self.lat0) / (r * math.cos(beta))

    def forward(self, m, lam, lat):
        r, s, c, d = self.turn
        beta = m.asin(_authalic(m, m.sin(lat)) / QP)
        up, side = m.sin(beta), m.cos(beta) * m.cos(lam)
        b = m.sqrt(2 / (up * s + side * c + 1)) * r
        return b * m.cos(beta) * m.sin(lam) * d, b * (up * c - side * s) / d

    def inverse(self, m, x, y):
        r, s, c, d = self.turn
        away = m.sqrt((x / d) * (x / d) + (y * d) * (y * d) + 1e-12)  # never zero, a thousandth of a millimetre off
        angle = m.asin(away / (2 * r)) * 2
        beta = m.asin(m.cos(angle) * s + y * d * m.sin(angle) * c / away)
        return m.atan2(x * m.sin(angle), away * m.cos(angle) * (d * c) - y * m.sin(angle) * (d * d * s)), _series(m, beta, _AUTHALIC)


class WebMercator(Grid):
    def forward(self, m, lam, lat):
        return lam * A, m.log(m.tan(lat / 2 + math.pi / 4)) * A

    def inverse(self, m, x, y):
        return x / A, m.atan(m.exp(y / A)) * 2 - math.pi / 2


class EqualAreaCylinder(Grid):
    def forward(self, m, lam, lat):
        return lam * (A * K6933), _authalic(m, m.sin(lat)) * (A / (2 * K6933))

    def inverse(self, m, x, y):
        return x / (A * K6933), _series(m, m.asin(y * (2 * K6933 / A) / QP), _AUTHALIC)


#: Transverse Mercator grids on other datums: that datum, and what ``GRIDS`` has. Fixed values.
SHIFTED: dict[int, tuple[int, float, float, float, float, tuple[float, ...]]] = {
    27700: (4277, 49, -2, 400000, -100000, (0.9996012717,)),
    31254: (4312, 0, 10 + 1 / 3, 0, -5000000, (1,)),
    31255: (4312, 0, 13 + 1 / 3, 0, -5000000, (1,)),
    31256: (4312, 0, 16 + 1 / 3, 0, -5000000, (1,)),
    31257: (4312, 0, 10 + 1 / 3, 150000, -5000000, (1,)),
    31258: (4312, 0, 13 + 1 / 3, 450000, -5000000, (1,)),
    31259: (4312, 0, 16 + 1 / 3, 750000, -5000000, (1,)),
    31466: (4314, 0, 6, 2500000, 0, (1,)),
    31467: (4314, 0, 9, 3500000, 0, (1,)),
    31468: (4314, 0, 12, 4500000, 0, (1,)),
    31469: (4314, 0, 15, 5500000, 0, (1,)),
}
KINDS = {"tm": TransverseMercator, "lcc": LambertConic, "aea": Albers, "laea": LambertAzimuthal}


@cache
def grid(epsg: int) -> Grid | None:
    """The grid of a number, from the table or by a rule; None for none."""
    if epsg in GRIDS:
        kind, *numbers = GRIDS[epsg]
        return KINDS[kind](*numbers)
    if epsg in SHIFTED:
        base, *numbers = SHIFTED[epsg]
        return TransverseMercator(*numbers, base)
    if epsg in (3857, 6933):
        return (WebMercator if epsg == 3857 else EqualAreaCylinder)(0, 0, 0, 0, ())
    for base, (north, zones) in ZONES.items():
        if epsg - base in zones:
            return TransverseMercator(0, (epsg - base) * 6 - 183, 500000, north, (0.9996,))
    if 3942 <= epsg <= 3950:  # nine conic zones of one degree
        lat = epsg - 3900
        return LambertConic(lat, 3, 1700000, (lat - 41) * 1000000 + 200000, (lat - 0.75, lat + 0.75))
    return None


def is_degrees(epsg: int | None) -> bool:
    return epsg in GEOGRAPHIC or epsg in DATUMS


def is_metric(crs: str | int) -> bool:
    return not is_degrees(code(crs))


def supported(crs: str | int) -> bool:
    c = code(crs)
    return is_degrees(c) or c is not None and grid(c) is not None


def _datum(epsg: int) -> int:
    """The system of longitude and latitude of other datums; 4326 stands for all that agree with it."""
    base = epsg if is_degrees(epsg) else grid(epsg).base
    return base if base in DATUMS else 4326


def _between(m, a: int, b: int, lon, lat):
    """Degrees on the datum of b, of degrees on that of a."""
    a, b = _datum(a), _datum(b)
    if a == b:
        return lon, lat
    on, shift = DATUMS.get(a, (WGS84, None))
    place = on.geocentric(m, lon, lat)
    if shift:
        place = shifted(*place, shift)
    on, shift = DATUMS.get(b, (WGS84, None))
    return on.geodetic(m, *(shifted(*place, shift, back=True) if shift else place))


def converted(m, a: int, b: int, x, y):
    """x and y of one system in another."""
    return forward(m, b, *_between(m, a, b, *inverse(m, a, x, y)))


def forward(m, epsg: int, lon, lat):
    """x and y of degrees."""
    if is_degrees(epsg):
        return lon, lat
    of = grid(epsg)
    x, y = of.forward(m, m.radians(lon - of.lon0), m.radians(lat))
    return x + of.east, y + of.north


def inverse(m, epsg: int, x, y):
    """Degrees of x and y."""
    if is_degrees(epsg):
        return x, y
    of = grid(epsg)
    lam, lat = of.inverse(m, x - of.east, y - of.north)
    return m.degrees(lam) + of.lon0, m.degrees(lat)


def _codes(source: str | int, target: str | int) -> tuple[int, int]:
    a, b = code(source), code(target)
    for c in (a, b):
        if not supported(c):
            raise ValueError(f"No formula for EPSG:{c}")
    return a, b


def _relisted(like: pa.Array, values: pa.Array) -> pa.Array:
    """Other values in the lists of an array."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(like))


def _moved(a: int, b: int):
    """A function of Arrow batches of geometries that takes every vertex from one system to another."""

    @arrow_udf(TYPE)
    def move(shapes: pa.Array) -> pa.Array:
        levels = [shapes.field("parts")]
        for _ in range(3):
            levels.append(pc.list_flatten(levels[-1]))
        flat = np.array(pc.list_flatten(levels[-1]).to_numpy(zero_copy_only=False), float)
        dims = pc.list_value_length(levels[-1]).to_numpy(zero_copy_only=False)
        at = np.cumsum(dims) - dims
        with np.errstate(all="ignore"):
            flat[at], flat[at + 1] = converted(_Arrays, a, b, flat[at], flat[at + 1])
        out = pa.array(flat)
        for like in reversed(levels):
            out = _relisted(like, out)
        return pa.StructArray.from_arrays([shapes.field("type"), out], ["type", "parts"], mask=pc.is_null(shapes))

    return move


def reproject(g: Column, source: str | int, target: str | int) -> Column:
    """Every vertex in the target system; further coordinates stay. Another datum's height above its ellipsoid counts as
    nought."""
    a, b = _codes(source, target)
    if a == b:
        return g
    if _datum(a) != _datum(b) or not (is_degrees(a) or is_degrees(b) and isinstance(grid(a), (WebMercator, EqualAreaCylinder))):
        return _moved(a, b)(g)

    def move(p: Column) -> Column:
        x, y = converted(_Columns, a, b, p[0], p[1])
        return F.concat(F.array(x, y), F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))))

    return map_points(g, move)


def reproject_box(box: tuple[float, float, float, float], source: str | int, target: str | int) -> tuple[float, float, float, float]:
    """The box of a box's four corners in the target system."""
    a, b = _codes(source, target)
    corners = [converted(math, a, b, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    return min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)
