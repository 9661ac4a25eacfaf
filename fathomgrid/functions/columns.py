"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """True for values that are neither missing, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def missing_to_null(c: Column, fill: float) -> Column:
    """The one missing-value rule: fill values and NaN become NULL at load time."""
    return F.nullif(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(fill)))


def polynomial(x: Column, coefficients) -> Column:
    """Horner evaluation, lowest order first."""
    value = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(float(c))
    return value


# One-atmosphere equation of state of sea water (UNESCO 1983, Technical
# Papers in Marine Science 44); lowest order first, in powers of temperature.
PURE_WATER = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
SALT_1 = (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
SALT_1_5 = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
SALT_2 = 4.8314e-4


def sigma0(salinity: Column, temperature: Column) -> Column:
    """Potential density anomaly (kg/m3) of practical salinity and potential temperature.

    This is the 1983 equation of state at surface pressure; it differs by up to about
    0.0014 kg/m3 (upper 70 m, tropical Pacific) from the newer standard based on
    absolute salinity, whose regional salinity atlas is not available here.
    Missing or negative salinity gives NULL.
    """
    s = F.when(salinity >= 0, salinity)
    return (polynomial(temperature, PURE_WATER)
            + polynomial(temperature, SALT_1) * s
            + polynomial(temperature, SALT_1_5) * s * F.sqrt(s)
            + F.lit(SALT_2) * s * s
            - F.lit(1000.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL if either is constant.

    (The built-in aggregate raises a division error for constant input in ANSI mode.)
    """
    spread = F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(spread))


def turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive when p lies left of the directed line from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def layer_mid(k: Column, dz: float) -> Column:
    """Depth (negative down) of the middle of layer k."""
    return -(k * F.lit(float(dz)) + F.lit(float(dz) / 2))


def interface(k: Column, dz: float) -> Column:
    """Depth (negative down) of interface k; 0 is the surface."""
    return F.lit(0.0) - k * F.lit(float(dz))


def histogram_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of v among `bins` equal bins on [lo, hi]; NULL outside.

    Bins are half open, the last one is closed. The floor of the scaled value can be
    off by one where v sits on an edge, so it is corrected against the edges
    lo + i * step themselves.
    """
    step = (hi - lo) / F.lit(float(bins))
    guess = F.least(F.floor(F.try_divide(v - lo, step)), F.lit(bins - 1)).cast("int")
    low = v < guess * step + lo
    high = (guess < bins - 1) & (v >= (guess + 1) * step + lo)
    exact = guess + F.when(low, -1).when(high, 1).otherwise(0)
    return F.when((v >= lo) & (v <= hi),
                  F.when(lo == hi, F.lit(bins - 1)).otherwise(exact))
