"""Spatial block bootstrap: paired resamples as hash-drawn multinomial counts, joined after pre-aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import hash_int


def block_draws(blocks: DataFrame, n_blocks: int, reps: int, seed: int) -> DataFrame:
    """(rep, block_id, w): how often each of ``n_blocks`` blocks is drawn in each replicate; each sums to ``n_blocks``.

    ``blocks``: (block_id, b) with b from 0. The draws come from two ranges, so they spread over tasks and never touch
    the data; the same seed gives the same resamples to every metric and feature set.
    """
    spark = blocks.sparkSession
    draws = spark.range(reps).select(F.col("id").alias("rep")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    drawn = draws.groupBy("rep", (hash_int("rep", "j", seed) % n_blocks).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    return drawn.join(blocks, "b").select("rep", "block_id", "w")


def numbered_blocks(df: DataFrame) -> DataFrame:
    """(block_id, b): blocks numbered by name."""
    return df.select("block_id").distinct().withColumn("b", (F.row_number().over(Window.orderBy("block_id")) - 1).cast("long"))


def interval(score: str, by: list[str], alpha: float = 0.05) -> list[Column]:
    return [F.percentile(score, F.lit(alpha / 2)).alias("ci_low"), F.percentile(score, F.lit(1 - alpha / 2)).alias("ci_high")]


def paired_differences(scores: DataFrame, points: DataFrame, reference: str, sign: int = 1, alpha: float = 0.05) -> DataFrame:
    """(feature_set, diff, ci_low, ci_high, p_not_better) against ``reference``.

    ``points`` (feature_set, score) has the scores on all rows: ``diff`` is their difference. Interval and p come from
    ``scores`` (rep, feature_set, score). Ties count as not better; ``sign`` -1 where lower is better.
    """
    mine = lambda by: F.max(F.when(F.col("feature_set") == reference, F.col("score"))).over(Window.partitionBy(*by))
    others = F.col("feature_set") != reference
    point = points.withColumn("diff", F.col("score") - mine([])).where(others).select("feature_set", "diff")
    drawn = scores.withColumn("d", F.col("score") - mine(["rep"])).where(others)
    spread = drawn.groupBy("feature_set").agg(*interval("d", [], alpha), F.avg((sign * F.col("d") <= 0).cast("int")).alias("p_not_better"))
    return point.join(spread, "feature_set")


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``df`` with ``significant``: p at most the largest p(k) with p(k) n / k <= alpha.

    Ranks are taken over distinct p-values and their counts: the ordered window sees those, not the rows.
    """
    per = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("m"))
    k = F.sum("m").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("m").over(Window.partitionBy())
    cut = per.withColumns({"k": k, "n": n}).agg(F.max(F.when(F.col(p) * F.col("n") / F.col("k") <= alpha, F.col(p))).alias("p_cut"))
    return df.join(F.broadcast(cut)).withColumn("significant", F.coalesce(F.col(p) <= F.col("p_cut"), F.lit(False))).drop("p_cut")
