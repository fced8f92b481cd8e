"""Sensor classes, path lengths, derived coordinates and light acceptance."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K


def tube_type(cable: Column) -> Column:
    """0 = 17 inch, 1 = 20 inch, 2 = outer detector, 3 = 5 inch."""
    return (
        F.when(cable < K.N_ID17, 0).when(cable < K.N_ID, 1).when(cable < K.N_OD_END, 2).otherwise(3)
    )


def is_inner(cable: Column) -> Column:
    return cable < K.N_ID


def area(cable: Column) -> Column:
    return F.when(cable < K.N_ID17, K.AREA_17).otherwise(K.AREA_20)


def sphere_point(i: int, n: int, radius: float) -> tuple[float, float, float]:
    """Point ``i`` of ``n`` on an evenly covered (Fibonacci) sphere."""
    cz = 1.0 - (2.0 * i + 1.0) / n
    rho = math.sqrt(1.0 - cz * cz)
    phi = (i + 0.5) * (math.pi * (1.0 + math.sqrt(5.0)))
    return radius * rho * math.cos(phi), radius * rho * math.sin(phi), radius * cz


def sensors(spark: SparkSession, n: int = K.N_CABLES) -> DataFrame:
    """Generated geometry: inner sensors on the 850 cm sphere, outer ones at 900 cm; one row per cable.

    Used where no geometry file is given. It has ``n`` rows; the planner knows its size. The positions are constants worked out once by the C library:
    the JVM's sine and cosine differ in the last digit for some of them, and a hit that lies on an edge of a bin then moves to the next one.
    """
    at = [sphere_point(i, K.N_ID, K.R_PMT) if i < K.N_ID else sphere_point(i - K.N_ID, max(n - K.N_ID, 1), 900.0) for i in range(n)]
    return spark.createDataFrame(pa.table({"cable": pa.array(range(n), pa.int64()),
                                           **{c: pa.array([p[k] for p in at], pa.float64()) for k, c in enumerate(("px", "py", "pz"))}}))


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def path_lengths(r: tuple, p: tuple) -> tuple[Column, Column, Column]:
    """``(d_ls, d_bo, d)``: path inside and outside the 650 cm sphere from point ``r`` to sensor ``p``."""
    rx, ry, rz = [c if isinstance(c, Column) else F.lit(float(c)) for c in r]
    dx, dy, dz = p[0] - rx, p[1] - ry, p[2] - rz
    d = norm(dx, dy, dz)
    rr = rx * rx + ry * ry + rz * rz
    ur = (dx * rx + dy * ry + dz * rz) / F.greatest(d, F.lit(1e-6))
    leave = F.sqrt(F.greatest(ur * ur - (rr - K.R_LS ** 2), F.lit(0.0))) - ur
    d_ls = F.when(rr >= K.R_LS ** 2, 0.0).otherwise(F.least(F.greatest(leave, F.lit(0.0)), d))
    return d_ls, d - d_ls, d


def time_of_flight(r: tuple, p: tuple, v_ls: float, v_bo: float | None = None) -> Column:
    d_ls, d_bo, d = path_lengths(r, p)
    return d / v_ls if v_bo is None else d_ls / v_ls + d_bo / v_bo


def rho(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def azimuth_deg(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def cos_theta(x: Column, y: Column, z: Column) -> Column:
    r = norm(x, y, z)
    return F.when(r > 0, z / r)


def polar_deg(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.acos(cos_theta(x, y, z)))


def rho2_scaled(x: Column, y: Column, radius: float = K.R_LS) -> Column:
    return (x * x + y * y) / (radius * radius)


def acceptance(r: tuple, p: tuple, cable: Column, attenuation: float = K.ATTENUATION_CM) -> Column:
    """Relative light collection of a sensor at ``p`` (axis toward the centre) for a point source at ``r``."""
    rx, ry, rz = [c if isinstance(c, Column) else F.lit(float(c)) for c in r]
    dx, dy, dz = p[0] - rx, p[1] - ry, p[2] - rz
    d = norm(dx, dy, dz)
    pn = norm(*p)
    cos = (dx * p[0] + dy * p[1] + dz * p[2]) / (d * pn)
    cos = F.least(F.greatest(cos, F.lit(0.0)), F.lit(1.0))
    return area(cable) * (0.1 + 0.9 * cos) * F.exp(-d / attenuation) / (d * d)


def relative_light(r: tuple, p: tuple, cable: Column, attenuation: float = K.ATTENUATION_CM) -> Column:
    """:func:`acceptance` relative to a source at the centre."""
    return acceptance(r, p, cable, attenuation) / acceptance((0.0, 0.0, 0.0), p, cable, attenuation)


def default_eta(cable: Column) -> Column:
    return F.when(cable < K.N_ID17, K.ETA_17).otherwise(K.ETA_20)
