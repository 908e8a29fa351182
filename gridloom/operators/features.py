"""Seasonal features: overlapping month windows in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import DELTAS, WINDOWS


def seasonal_quantiles(df: DataFrame, bands: list[str], windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Median and interquartile range of each band in each window of months, by cell.

    Windows overlap, so they are conditional aggregates over one scan and one shuffle; one percentile call gives the
    three quantiles.
    """
    windows = windows or WINDOWS
    month = F.month("obs_date")
    aggs, out = [], []
    for b in bands:
        for w, (lo, hi) in windows.items():
            aggs.append(F.percentile(F.when(month.between(lo, hi), F.col(b)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{b}_{w}"))
            q = F.col(f"{b}_{w}")
            out += [q[1].alias(f"{b}_{w}_median"), (q[2] - q[0]).alias(f"{b}_{w}_iqr")]
    return df.groupBy("y", "x").agg(*aggs).select("y", "x", *out)


def month_deltas(df: DataFrame, bands: list[str]) -> DataFrame:
    """Differences of medians between pairs of months."""
    month = F.month("obs_date")
    med = lambda b, months: F.median(F.when(month.isin(*months), F.col(b)))
    return df.groupBy("y", "x").agg(*[(med(b, new) - med(b, old)).alias(f"{b}_{name}") for b in bands for name, (new, old) in DELTAS.items()])


def ten_statistics(df: DataFrame, band: str, by: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """mean, max, min, std, amp, cv, p25, p50, p75 and iqr of a band (population spread)."""
    q = df.groupBy(*by).agg(F.avg(band).alias("mean"), F.max(band).alias("max"), F.min(band).alias("min"), F.stddev_pop(band).alias("std"), F.percentile(band, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*by, "mean", "max", "min", "std", (F.col("max") - F.col("min")).alias("amp"), (F.col("std") / F.greatest("mean", F.lit(1e-6))).alias("cv"), F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def to_long(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "band", "value")


def to_wide(df: DataFrame, ids: list[str], columns: list[str], how=F.first) -> DataFrame:
    """Long to wide with the columns stated, so no pass is spent on finding them."""
    return df.groupBy(*ids).pivot("band", columns).agg(how("value"))


def missing_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of NULLs by column, from one aggregate over all columns."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.unpivot([], columns, "band", "missing")


def complete(df: DataFrame, columns: list[str]) -> Column:
    """Whether every feature of a row is there."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
