"""Coordinate systems: local/celestial/uvw rotations, direction cosines, times.

All functions map Columns (or floats) to tuples of Columns, so a whole chain of
rotations stays one projection.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fringelake.functions.cplx import Cx, turns
from fringelake.model import SPEED_OF_LIGHT

Scalar = Column | float

#: Modified Julian Date of 1970-01-01 and the GMST polynomial (fixed values).
MJD_UNIX_EPOCH = 40587.0
GMST_AT_J2000_DEG = 280.46061837
GMST_RATE_DEG_PER_DAY = 360.98564736629
MJD_J2000 = 51544.5


def as_col(value: Scalar) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def xyz_at_latitude(x: Scalar, y: Scalar, z: Scalar, lat: Scalar):
    """Rotate local east/north/up positions to celestial x,y,z."""
    x, y, z = as_col(x), as_col(y), as_col(z)
    tilt = F.lit(math.pi / 2) - as_col(lat)
    s, c = F.sin(tilt), F.cos(tilt)
    return x, y * c - z * s, y * s + z * c


def xyz_to_uvw(x: Scalar, y: Scalar, z: Scalar, ha: Scalar, dec: Scalar):
    """Celestial positions to (u,v,w) for a phase centre at (ha, dec)."""
    x, y, z, ha, dec = map(as_col, (x, y, z, ha, dec))
    u = x * F.cos(ha) - y * F.sin(ha)
    toward = x * F.sin(ha) + y * F.cos(ha)
    return (u,
            z * F.cos(dec) + toward * F.sin(dec),
            z * F.sin(dec) - toward * F.cos(dec))


def uvw_to_xyz(u: Scalar, v: Scalar, w: Scalar, ha: Scalar, dec: Scalar):
    """Inverse of :func:`xyz_to_uvw`."""
    u, v, w, ha, dec = map(as_col, (u, v, w, ha, dec))
    toward = v * F.sin(dec) - w * F.cos(dec)
    z = v * F.cos(dec) + w * F.sin(dec)
    return (u * F.cos(ha) + toward * F.sin(ha),
            toward * F.cos(ha) - u * F.sin(ha),
            z)


def uv_to_hour_angle(x: Column, y: Column, u: Column, toward: Column) -> Column:
    """Hour angle at which a baseline (x,y) projects to ``u``; ``toward`` is the
    component along the meridian (v0)."""
    return F.asin((x * toward - y * u) / (x * x + y * y))


def radec_to_lmn(ra: Scalar, dec: Scalar, ra0: Scalar, dec0: Scalar):
    """Direction cosines (l, m, n-1) of a position relative to a phase centre."""
    ra, dec, ra0, dec0 = map(as_col, (ra, dec, ra0, dec0))
    d = ra - ra0
    l = F.cos(dec) * F.sin(d)
    m = F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(d)
    n = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(d)
    return l, m, n - 1.0


def lmn_value(position: tuple[float, float], centre: tuple[float, float]) -> tuple[float, float]:
    """(l, m) of one (ra, dec) seen from another, as numbers."""
    d = position[0] - centre[0]
    (sp, cp), (sc, cc) = ((math.sin(p[1]), math.cos(p[1])) for p in (position, centre))
    return cp * math.sin(d), sp * cc - cp * sc * math.cos(d)


def rotation_matrix(centre: tuple[float, float], new: tuple[float, float]) -> np.ndarray:
    """Rows: unit u, v, w of one phase centre expressed at another."""
    def axes(ra: float, dec: float) -> np.ndarray:
        (sh, ch), (sd, cd) = ((math.sin(x), math.cos(x)) for x in (-ra, dec))
        return np.array([[ch, -sh, 0], [sh * sd, ch * sd, cd], [-sh * cd, -ch * cd, sd]])
    return axes(*centre) @ axes(*new).T


def sphere_to_cosines(lon: Column, lat: Column):
    """Unit vector of a (longitude, latitude) pair, x pointing east."""
    return F.sin(lon) * F.cos(lat), F.cos(lon) * F.cos(lat), F.sin(lat)


def point_phasor(u: Column, v: Column, w: Column, l: Scalar, m: Scalar) -> Cx:
    """Visibility of a unit point source at direction cosines (l, m)."""
    l, m = as_col(l), as_col(m)
    n = F.sqrt(F.lit(1.0) - l * l - m * m) - 1.0
    return turns(-(u * l + v * m + w * n))


def shift_phasor(u: Column, v: Column, dl: Scalar, dm: Scalar) -> Cx:
    return turns(-(u * as_col(dl) + v * as_col(dm)))


def metres_to_wavelengths(length: Column, freq: Column) -> Column:
    return length * freq / F.lit(SPEED_OF_LIGHT)


def wavelengths_to_metres(length: Column, freq: Column) -> Column:
    return length / freq * F.lit(SPEED_OF_LIGHT)


def w_far_field(l: Column, m: Column, w: Scalar) -> Cx:
    """Fresnel pattern exp(2 pi i w (1 - sqrt(1 - l^2 - m^2)))."""
    r2 = l * l + m * m
    ok = F.when(r2 < 1.0, r2).otherwise(
        F.raise_error(F.lit("direction cosines beyond the horizon")))
    return turns(as_col(w) * (F.lit(1.0) - F.sqrt(F.lit(1.0) - ok)))


def recentre_phasor(l: Column, m: Column, w: Scalar, dl: float, dm: float) -> Cx:
    """Image-space ramp that centres a w-kernel whose peak moved by (dl,dm)*w."""
    return turns(-(as_col(w) * (F.lit(float(dl)) * l + F.lit(float(dm)) * m)))


def kernel_transform(dl: float, dm: float) -> np.ndarray:
    """2x2 matrix that keeps w-kernel coordinates as constant as possible under
    a phase-centre shift of (dl, dm)."""
    r2 = dl * dl + dm * dm
    dn = math.sqrt(1 - r2)
    f = (dn - 1) / r2 if r2 else 0.0
    cross = dl * dm * f
    return np.array([[dn - dm * dm * f, cross], [cross, dn - dl * dl * f]])


def coordinate(index: Column, n: int) -> Column:
    """Centred coordinate (i - n//2) / n of a pixel index."""
    return (index - F.lit(n // 2)) / F.lit(float(n))


def kernel_coordinates(y: Column, x: Column, n: int, theta: float,
                       dl: float = 0.0, dm: float = 0.0, transform=None):
    """(l, m) of far-field pixel (y, x)."""
    l, m = (coordinate(i, n) * F.lit(float(theta)) for i in (x, y))
    if transform is not None:
        t = np.asarray(transform, dtype=float)
        l, m = (l * float(t[0, 0]) + m * float(t[1, 0]),
                l * float(t[0, 1]) + m * float(t[1, 1]))
    return l + float(dl), m + float(dm)


def lambda_bounds(lo: Column, hi: Column, f_min: Column, f_max: Column):
    """Range in wavelengths of lengths in [lo, hi] over a frequency range: each
    bound takes the frequency that pushes it outwards."""
    low = metres_to_wavelengths(lo, F.when(lo < 0, f_max).otherwise(f_min))
    high = metres_to_wavelengths(hi, F.when(hi < 0, f_min).otherwise(f_max))
    return low, high


def mjd_to_timestamp(mjd: Column) -> Column:
    return F.timestamp_seconds((mjd - MJD_UNIX_EPOCH) * 86400.0)


def hour_angle_seconds(ha: Column) -> Column:
    """Hour angle in radians to seconds of a day."""
    return ha * F.lit(43200.0 / math.pi)


def zenith_ra(mjd: Column, longitude: Scalar) -> Column:
    """Right ascension (radians, in [0, 2 pi)) that transits at a site."""
    deg = GMST_AT_J2000_DEG + (mjd - MJD_J2000) * GMST_RATE_DEG_PER_DAY
    return F.pmod(F.radians(deg) + as_col(longitude), F.lit(2 * math.pi))


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at zero."""
    a = F.lit(math.pi) * x
    return F.when(x == 0, 1.0).otherwise(F.sin(a) / F.nullif(a, F.lit(0.0)))


def recommended_kernel_size(w: Column, theta: float, eps: float) -> Column:
    """Pixels a w-kernel needs to span for an error below ``eps``."""
    aw = F.abs(w)
    return F.lit(2.0 * theta) * F.sqrt(
        F.pow(aw * theta / 2.0, F.lit(2.0))
        + F.pow(aw, F.lit(1.5)) * theta / (2.0 * math.pi * eps))


def recommended_kernel_error(size: float, w: float, theta: float) -> float:
    """Error left by a w-kernel of ``size`` pixels (the size rule solved for
    eps); infinite where the support is below the geometric minimum."""
    spare = (size / (2.0 * theta)) ** 2 - (abs(w) * theta / 2.0) ** 2
    return math.inf if spare <= 0 else abs(w) ** 1.5 * theta / (2 * math.pi) / spare
