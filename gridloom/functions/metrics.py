"""Accuracy measures as aggregate columns; a registry takes the place of user-defined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bias(p: Column, y: Column) -> Column:
    return F.avg(p - y)


def mae(p: Column, y: Column) -> Column:
    return F.avg(F.abs(p - y))


def rmse(p: Column, y: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def r2(p: Column, y: Column) -> Column:
    both = F.when(p.isNotNull() & y.isNotNull(), y)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.count(both) * F.var_pop(both))


def pearson(a: Column, b: Column) -> Column:
    """Correlation, NULL where either side is constant (the built-in one fails there)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


#: Measures by name, (prediction, truth) to an aggregate column.
METRICS = {"bias": bias, "mae": mae, "rmse": rmse, "r2": r2}


def weighted_rmse(p: Column, y: Column, w: Column) -> Column:
    return F.sqrt(F.sum(w * (p - y) * (p - y)) / F.sum(w))


def weighted_r2(p: Column, y: Column, w: Column) -> Column:
    return 1 - F.try_divide(F.sum(w * (y - p) * (y - p)), F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w))


def weighted_auc(df: DataFrame, by: list[str], truth: str, score: str, weight: str) -> DataFrame:
    """(by, auc): ties get half credit, NULL where one class has no weight.

    Weights are first summed per distinct score, so the window runs over scores and not over rows.
    """
    w = F.col(weight)
    per = df.where(w > 0).groupBy(*by, score).agg(F.sum(F.when(F.col(truth) == 1, w).otherwise(0)).alias("wp"), F.sum(F.when(F.col(truth) == 0, w).otherwise(0)).alias("wn"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("below", F.coalesce(F.sum("wn").over(before), F.lit(0)))
    area = F.try_divide(F.sum(F.col("wp") * (F.col("below") + 0.5 * F.col("wn"))), F.sum("wp") * F.sum("wn"))
    return ranked.groupBy(*by).agg(area.alias("auc"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation with average ranks, ranked over distinct values and their counts."""

    def ranks(c: str) -> DataFrame:
        per = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return per.select(c, (before + (F.col("n") + 1) / 2.0).alias(f"rank_{c}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"))
