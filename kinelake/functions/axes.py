"""Column expressions on three-axis samples (ax, ay, az in g)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from kinelake.operators.windows import KEY, ordered

AX, AY, AZ = F.col, F.col, F.col


def magnitude(x: str = "ax", y: str = "ay", z: str = "az") -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def z_angle(x: str = "ax", y: str = "ay", z: str = "az") -> Column:
    """Degrees above the plane of x and y; 90 where that part is zero."""
    return F.degrees(F.atan2(F.col(z), F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))))


def arm_angle(axis: str = "ax") -> Column:
    return F.degrees(F.asin(F.try_divide(F.col(axis), magnitude())))


def enmo(take_abs: bool = False, trim_zero: bool = True) -> Column:
    v = magnitude() - 1
    v = F.abs(v) if take_abs else v
    return F.greatest(v, F.lit(0.0)) if trim_zero else v


def calibrated(axis: str, offset: Column, scale: Column) -> Column:
    return (F.col(axis) + offset) * scale


def physical(raw: Column, digital_min: float, digital_max: float, physical_min: float, physical_max: float) -> Column:
    """Converter counts on their physical scale."""
    return (raw - digital_min) / (digital_max - digital_min) * (physical_max - physical_min) + physical_min


def absolute_difference(value: str) -> Column:
    """|x - previous x| along the recording, 0 at its start."""
    return F.coalesce(F.abs(F.col(value) - F.lag(value).over(ordered(None))), F.lit(0.0))


def gradient(value: str, dt: float) -> Column:
    """Second-order differences, one-sided at the ends."""
    by = ordered(None)
    x, a, b = F.col(value), F.lag(value).over(by), F.lead(value).over(by)
    a2, b2 = F.lag(value, 2).over(by), F.lead(value, 2).over(by)
    inner = (b - a) / (2 * dt)
    return F.coalesce(inner, F.when(a.isNull(), (-3 * x + 4 * b - b2) / (2 * dt)).otherwise((3 * x - 4 * a + a2) / (2 * dt)))


def cumulative_trapezoid(value: str, dt: float) -> Column:
    """Running integral from 0; take it in two steps, as window functions don't nest."""
    return F.sum(value).over(ordered(None).rowsBetween(Window.unboundedPreceding, 0)) * dt


def trapezoid_part(value: str) -> Column:
    return F.coalesce((F.col(value) + F.lag(value).over(ordered(None))) / 2, F.lit(0.0))


def detrended(value: str) -> Column:
    """The residual of a straight line through the whole recording."""
    whole = Window.partitionBy(KEY)
    at = F.col("sample_idx").cast("double")
    return F.col(value) - (F.regr_intercept(F.col(value), at).over(whole) + F.regr_slope(F.col(value), at).over(whole) * at)


def levelled(v: str, ap: str, ml: str, mean_v: Column, mean_ap: Column, mean_ml: Column) -> tuple[Column, Column, Column]:
    """Vertical, forward and lateral acceleration with the mean tilt rotated out.

    Where a mean exceeds 1 g the angle is unknown and the axes stay.
    """
    known = (F.abs(mean_ap) <= 1) & (F.abs(mean_ml) <= 1)
    sa, sm = mean_ap, mean_ml
    ca, cm = F.sqrt(1 - F.when(known, sa * sa).otherwise(0.0)), F.sqrt(1 - F.when(known, sm * sm).otherwise(0.0))
    sign = F.signum(mean_v)
    new_ap = F.col(ap) * ca - sign * F.col(v) * sa
    part = sign * F.col(ap) * sa + F.col(v) * ca
    new_ml = F.col(ml) * cm - sign * part * sm
    new_v = sign * F.col(ml) * sm + part * cm
    return F.when(known, new_v).otherwise(F.col(v)), F.when(known, new_ap).otherwise(F.col(ap)), F.when(known, new_ml).otherwise(F.col(ml))
