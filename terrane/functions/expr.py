"""Scalar expressions as pure column functions."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: GRS 80, zone of the Swedish national grid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN, SCALE, FALSE_EASTING, FALSE_NORTHING = 15.0, 0.9996, 500000.0, 0.0
#: Fixed value: keeps similarities positive.
FLOOR = 1e-6


def taxon_number(identifier: Column, strict: bool = False) -> Column:
    """Trailing digits of an identifier, or NULL; ``strict`` wants them after ``:Taxon:``."""
    return F.nullif(F.regexp_extract(identifier, r":Taxon:(\d+)$" if strict else r"(\d+)$", 1), F.lit(""))


def to_double(c: Column) -> Column:
    """NULL where the text is no number."""
    return c.try_cast("double")


def canonical_id(c: Column) -> Column:
    """``007`` and `` 5 `` become 7 and 5; NULL stays; anything else that is no integer raises."""
    return c.cast("bigint").cast("string")


def known(c: Column) -> Column:
    """NULL for the markers of a missing value, '' and 'NA'."""
    return F.when(c.isin("", "NA"), None).otherwise(c)


def locality_key(locality_id: Column, locality: Column, lat: Column, lon: Column) -> Column:
    """The id, else the name, else a key of rounded coordinates (half up on the decimal, not on the binary value)."""
    return F.coalesce(F.nullif(locality_id, F.lit("")), F.nullif(locality, F.lit("")), F.format_string("cell_%.3f_%.3f", lat, lon))


@F.pandas_udf(T.StringType())
def locality_key_exact(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """The coordinate key rounded on the exact binary value."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else f"cell_{a:.3f}_{b:.3f}" for a, b in zip(lat, lon)], dtype=object)


@F.pandas_udf(T.StringType())
def nfc(c: pd.Series) -> pd.Series:
    import unicodedata

    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def file_name(c: Column, normalise: bool = True) -> Column:
    """A name that is safe for files; NULL becomes ``unknown``."""
    c = nfc(c) if normalise else c
    return F.coalesce(F.regexp_replace(F.replace(strip(c), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9_\-.åäöÅÄÖ]", ""), F.lit("unknown"))


def label_name(c: Column, longest: int = 120) -> Column:
    """Letters, digits, ``_`` and ``-`` stay, others become ``_``."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), 1, longest)


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def split_ids(c: Column) -> Column:
    """Words of a list; a blank list has none."""
    return F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")


def join_ids(ids: Column) -> Column:
    return F.array_join(F.sort_array(ids), " ")


def grid_index(c: Column, size: float) -> Column:
    """Index of the square on one axis; a missing coordinate counts as -1."""
    return F.floor(F.coalesce(F.nanvl(c, F.lit(-1.0)), F.lit(-1.0)) / F.lit(float(size))).cast("bigint")


def cell_name(gx: Column, gy: Column) -> Column:
    return F.concat(F.lit("gx"), gx.cast("string"), F.lit("_gy"), gy.cast("string"))


def cell_rectangle(gx: Column, gy: Column, size: float) -> list[Column]:
    return [(gx * size).alias("x0"), (gy * size).alias("y0"), F.lit(float(size)).alias("width"), F.lit(float(size)).alias("height")]


def share_of_total(value: Column, *by: str) -> Column:
    """Value over its group's sum; groups that sum to nothing are divided by 1."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return value / F.when(total < 1e-12, 1.0).otherwise(total)


def kernel(d: Column, mode: str, scale_i: Column | None = None, scale_j: Column | None = None, beta: float = 1.0) -> Column:
    """Similarity of a distance: ``adaptive`` (Gaussian of both ends' scales), ``reciprocal`` or ``exp``."""
    if mode == "adaptive":
        return F.exp(-d * d / (F.lit(2.0) * scale_i * scale_j)) + F.lit(FLOOR)
    if mode == "reciprocal":
        return F.lit(1.0) / (F.lit(1.0) + d) + F.lit(FLOOR)
    if mode == "exp":
        return F.exp(-F.lit(float(beta)) * d) + F.lit(FLOOR)
    raise ValueError(f"unknown kernel {mode!r}")


def sorensen(a: Column, b: Column, c: Column) -> list[Column]:
    """Dissimilarity of two sets that share ``a`` and own ``b`` and ``c``, and its turnover and nestedness parts."""
    a, b, c = (x.cast("double") for x in (a, b, c))
    least = F.least(b, c)
    sor = F.when(2 * a + b + c > 0, (b + c) / (2 * a + b + c)).otherwise(0.0)
    sim = F.when(a + least > 0, least / (a + least)).otherwise(0.0)
    return [sor.alias("beta_sor"), sim.alias("beta_turnover"), (sor - sim).alias("beta_nestedness")]


def r_squared(f: Column, k: Column, n: Column) -> Column:
    r = f * (k - 1) / (n - k)
    return r / (1 + r)


def normal_interval(mean: Column, sd: Column, n: Column) -> list[Column]:
    half = F.when(n > 1, 1.96 * sd / F.sqrt(n.cast("double")))
    return [(mean - half).alias("ci_low"), (mean + half).alias("ci_high")]


def volcano(q: Column) -> Column:
    return -F.log10(F.least(F.greatest(q, F.lit(1e-300)), F.lit(1.0)))


@functools.cache
def tail_series(terms: int = 24) -> tuple[float, list[float]]:
    """(least t, coefficients) of log(erfc(x) / t) + x * x by powers of u, where t = 2 / (2 + x) and u runs over t from -1 to 1.

    Fitted at Chebyshev's points up to x = 26, beyond which the tail is no number of this size.
    """
    low = 2 / (2 + 26.0)
    u = np.cos(np.pi * (np.arange(400) + 0.5) / 400)
    t = low + (1 - low) * (u + 1) / 2
    x = 2 / t - 2
    y = [math.log(math.erfc(v) / s) + v * v for v, s in zip(x, t)]
    return low, np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(u, y, terms)).tolist()


def normal_tail(z: Column | str) -> Column:
    """Two-sided tail of the normal distribution, to about ten digits; NULL where ``z`` is."""
    z = F.col(z) if isinstance(z, str) else z
    low, coefficients = tail_series()
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(2.0) / (F.lit(2.0) + x)
    u = (t - low) * (2 / (1 - low)) - 1
    power = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        power = power * u + c
    return F.when(x < 26, t * F.exp(power - x * x)).when(x.isNotNull(), 0.0)


@functools.lru_cache(256)
def _rank_sums(m: int, n: int) -> tuple[list[int], int]:
    """Ways of every lower value of U (up to half of ``m * n``) for ``m`` of ``m + n`` untied ranks, added up, and all ways."""
    ways = [1] + [0] * (m * n // 2)
    for i in range(1, m + 1):
        for u in range(len(ways) - 1, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, len(ways)):
            ways[u] += ways[u - i]
    return list(itertools.accumulate(ways)), math.comb(m + n, m)


@F.pandas_udf(T.DoubleType())
def exact_rank_tail(n_in: pd.Series, n_out: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided exact tail of U of untied values; NULL where ``u`` is."""

    def tail(a, b, u):
        if pd.isna(u):
            return None
        below, every = _rank_sums(int(min(a, b)), int(max(a, b)))
        return min(1.0, 2 * below[round(min(u, a * b - u))] / every)

    return pd.Series([tail(*r) for r in zip(n_in, n_out, u)], dtype="float64")


def _series() -> tuple:
    f = FLATTENING
    n = f / (2 - f)
    e2 = f * (2 - f)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return math.sqrt(e2), radius, forward, back


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Northing and easting of geographic coordinates in degrees, by the Krueger series."""
    e, radius, forward, _ = _series()
    phi, lam = F.radians(lat), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(forward, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return SCALE * radius * north + FALSE_NORTHING, SCALE * radius * east + FALSE_EASTING


def unproject(north: Column, east: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees; the conformal latitude is inverted by iteration."""
    e, radius, _, back = _series()
    xi, eta = (north - FALSE_NORTHING) / (SCALE * radius), (east - FALSE_EASTING) / (SCALE * radius)
    x, y = xi, eta
    for k, b in enumerate(back, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.asin(F.sin(x) / F.cosh(y))
    lam = F.atan2(F.sinh(y), F.cos(x))
    phi = conformal
    for _ in range(5):
        phi = F.asin(F.tanh(F.atanh(F.sin(conformal)) + e * F.atanh(e * F.sin(phi))))
    return F.degrees(phi), F.degrees(lam) + MERIDIAN
