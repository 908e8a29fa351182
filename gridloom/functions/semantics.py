"""Scalar rules that every operator shares: missing is NULL, divisions are guarded, randomness is a hash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MASKED_CLASSES = (0, 1, 3, 8, 9, 10, 11)
CLOUD_CLASSES = (1, 3, 8, 9, 10, 11)
LEAST_DENOMINATOR = 1e-3
FEET_PER_METRE = 3.28084


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str, nodata: float | None = None) -> Column:
    """NaN, infinities and the nodata value become NULL."""
    c = as_col(c)
    ok = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(ok if nodata is None else ok & (c != nodata), c)


def safe_div(num: Column, den: Column, floor: float = LEAST_DENOMINATOR) -> Column:
    """num / den where den exceeds ``floor``, else NULL."""
    return F.when(den > floor, num / den)


def clip(c: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL, which least and greatest alone would lose."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with a negative zero made plain."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def hash_int(*parts: Column | str | int) -> Column:
    """A 32-bit number from the MD5 of the parts joined by underscores: the same in any engine and partitioning."""
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("_", *cols).cast("binary")), 1, 8), 16, 10).cast("long")


def scale_reflectance(value: Column, baseline: Column) -> Column:
    """Digital numbers to reflectance; processing baselines from 4.0 on carry an offset of 1000."""
    return (value - F.when(baseline >= 4.0, 1000.0).otherwise(0.0)) / 10000.0


def mask_class(value: Column, scl: Column, masked: Iterable[int] = MASKED_CLASSES) -> Column:
    """The value, NULL where the scene class is masked; the row stays."""
    return F.when(~scl.isin(*masked), value)


def canopy_bin(pct: Column) -> Column:
    """0 up to 0, 21 from 100 on, 1 to 20 for five-point steps between, -1 where missing."""
    step = 1 + F.least(F.greatest(F.floor(pct / 5.0), F.lit(0)), F.lit(19))
    return F.when(pct.isNull() | F.isnan(pct), -1).when(pct <= 0, 0).when(pct >= 100, 21).otherwise(step).cast("int")


def floor_bin(v: Column, width: float, top: int) -> Column:
    return F.least(F.greatest(F.floor(v / width), F.lit(0)), F.lit(top)).cast("int")


def bin_left_closed(v: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value: 0 below the first."""
    return F.when(v.isNotNull(), sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int")


def bin_right_closed(v: Column, edges: list[float], top: int | None = None) -> Column:
    """Bin i holds (edges[i], edges[i + 1]]; values out of range go to the end bins when ``top`` is given."""
    n = sum((F.when(v > e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    if top is not None:
        n = F.least(F.greatest(n, F.lit(0)), F.lit(top))
    return F.when(v.isNotNull(), n).cast("int")


def cut_right_closed(v: Column, edges: list[float]) -> Column:
    """As :func:`bin_right_closed`, but the lowest edge and anything out of range fall in no bin."""
    return F.when((v > edges[0]) & (v <= edges[-1]), bin_right_closed(v, edges))


def quantise(v: Column, lo: float, hi: float, levels: int) -> Column:
    """Grey level by rounding half to even."""
    return F.rint(clip((v - lo) / (hi - lo), 0.0, 1.0) * (levels - 1)).cast("int")


def change_class(before: Column, after: Column, lo: float, hi: float) -> Column:
    """loss / stable / gain with strict bounds; a change of exactly ``lo`` or ``hi`` stays NULL."""
    d = after - before
    return F.when(d < lo, "loss").when((d > lo) & (d < hi), "stable").when(d > hi, "gain")
