"""From catalog and scenes to masked, scaled, merged observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import BANDS
from ..functions.semantics import CLOUD_CLASSES, MASKED_CLASSES, mask_class, scale_reflectance


def latest_items(catalog: DataFrame, most_cloud: float = 80.0) -> DataFrame:
    """One item for each day and tile below the cloud limit: the newest baseline, ties to the smallest id.

    The winner is an aggregate (partial before the shuffle), not a sorted window.
    """
    kept = catalog.where(F.col("cloud_cover") < most_cloud).withColumn("obs_date", F.to_date("datetime"))
    best = F.min(F.struct((-F.col("baseline")).alias("b"), "id", "cloud_cover"))
    return kept.groupBy("obs_date", "tile").agg(best.alias("best")).select("obs_date", "tile", F.col("best.id").alias("id"), (-F.col("best.b")).alias("baseline"), F.col("best.cloud_cover").alias("cloud_cover"))


def missing_months(obs: DataFrame, year: int) -> DataFrame:
    """Months of ``year`` without an observation."""
    spark = obs.sparkSession
    done = obs.where(F.year("obs_date") == year).select(F.month("obs_date").alias("month")).distinct()
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month")).join(done, "month", "left_anti")


def mask_scale(obs: DataFrame, bands: tuple[str, ...] = BANDS, masked: tuple[int, ...] = MASKED_CLASSES) -> DataFrame:
    """Reflectance with masked classes as NULL."""
    return obs.withColumns({b: scale_reflectance(mask_class(F.col(b), F.col("scl"), masked), F.col("baseline")) for b in bands})


def cloud_fraction(obs: DataFrame, cloudy: tuple[int, ...] = CLOUD_CLASSES) -> DataFrame:
    """Per day: observed cells (class other than 0), cloudy ones, and their fraction; days without any are dropped."""
    seen, cloud = F.col("scl") != 0, F.col("scl").isin(*cloudy)
    out = obs.groupBy("obs_date").agg(F.count_if(seen).alias("observed"), F.count_if(cloud & seen).alias("cloudy"))
    return out.where("observed > 0").withColumn("cloud_fraction", F.col("cloudy") / F.col("observed"))


def day_merge(obs: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Median over the tiles of a day for each cell and band."""
    return obs.groupBy("y", "x", "obs_date").agg(*[F.median(b).alias(b) for b in bands])


def best_scene(obs: DataFrame) -> DataFrame:
    """The day with the largest share of valid cells, ties to the earliest."""
    share = obs.groupBy("obs_date").agg(F.avg((~F.col("scl").isin(*MASKED_CLASSES)).cast("int")).alias("valid"))
    return share.agg(F.min(F.struct((-F.col("valid")).alias("v"), "obs_date")).alias("s")).select("s.obs_date", (-F.col("s.v")).alias("valid"))


def drop_sparse_scenes(obs: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Days whose valid share is at least the rounded quantile of all days' shares."""
    share = obs.groupBy("obs_date").agg(F.avg((~F.col("scl").isin(*MASKED_CLASSES)).cast("int")).alias("valid"))
    limit = share.agg(F.round(F.percentile("valid", F.lit(quantile)), 2).alias("limit"))
    return share.join(F.broadcast(limit)).where("valid >= limit").select("obs_date", "valid")


def nearest_baseline(obs: DataFrame) -> DataFrame:
    """Observations numbered within their cell by date; ties by every other column that tells rows apart."""
    order = Window.partitionBy("y", "x").orderBy("obs_date", "tile", "baseline", "scl", *BANDS)
    return obs.withColumn("nth", F.row_number().over(order))
