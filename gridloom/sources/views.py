"""Gridded relations over the star-schema tables: the same projections an image archive would be loaded into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(c):
    return c.cast("int")


def observations(spark: SparkSession, sf_dir: str, size: int = 40) -> DataFrame:
    """(y, x, obs_date, tile, baseline, scl, ten bands as digital numbers)."""
    c = F.col
    q, p, s, o = c("l_quantity").cast("double"), c("l_partkey"), c("l_suppkey"), c("l_orderkey")
    bands = {"B02": 800 + 30 * q, "B03": 900 + 35 * q, "B04": 1000 + 40 * q, "B05": 1100 + 7 * (p % 100), "B06": 1800 + 11 * (s % 50), "B07": 2000 + 9 * (p % 80), "B08": 2500 + 30 * (p % 100), "B8A": 2600 + 25 * (o % 90), "B11": 1500 + 30 * (s % 50), "B12": 900 + 20 * q}
    return table(spark, sf_dir, "lineitem").select(
        _int(o % size).alias("y"), _int(p % size).alias("x"), F.to_date("l_shipdate").alias("obs_date"), c("l_returnflag").alias("tile"),
        ((2 * 2 + c("l_linenumber")).cast("double") / 2).alias("baseline"), _int((s + c("l_linenumber")) % 12).alias("scl"), *[v.cast("double").alias(k) for k, v in bands.items()],
    )


def grid(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """(y, x, lidar, pred, other, height, code): one row a cell; lidar and pred have missing cells."""
    c = F.col
    n = F.count(F.lit(1))
    part = lambda name, by: F.sum(F.round(c(name) * 100).cast("long")) * by / n
    cells = table(spark, sf_dir, "lineitem").groupBy(_int(c("l_orderkey") % size).alias("y"), _int(c("l_partkey") % size).alias("x")).agg(part("l_discount", 10.0).alias("d"), part("l_tax", 12.0).alias("t"), (F.sum(F.round(c("l_quantity")).cast("long")) * 0.4 / n).alias("height"))
    lidar = F.when(c("d") < 30, 0.0).otherwise(c("d"))
    y, x = c("y"), c("x")
    return cells.select(
        "y", "x", F.when((y * 7 + x * 3) % 41 != 0, lidar).alias("lidar"), F.when((y * 5 + x * 11) % 53 != 0, 0.6 * lidar + 0.4 * c("t")).alias("pred"),
        c("t").alias("other"), "height", ((y + 3 * x) % 9).cast("int").alias("code"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, block_id, y_true, lidar, feature_set, y_pred): three prediction columns in long form."""
    g = grid(spark, sf_dir).where("lidar IS NOT NULL AND pred IS NOT NULL")
    wide = g.select("y", "x", F.concat_ws("_", F.expr("y div 10"), F.expr("x div 10")).alias("block_id"), (F.col("lidar") > 50).cast("int").alias("y_true"), "lidar", F.col("pred").alias("all_vars"), F.col("other").alias("deltas_only"), (0.5 * F.col("lidar") + 0.5 * F.col("other")).alias("medians"))
    return wide.unpivot(["y", "x", "block_id", "y_true", "lidar"], ["all_vars", "deltas_only", "medians"], "feature_set", "y_pred")


def zone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, zone_name, borough, y, x, coverage): cells of each zone with a coverage fraction in quarters."""
    c = F.col
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = table(spark, sf_dir, "lineitem").join(s, c("l_suppkey") == c("s_suppkey")).select(c("s_nationkey").alias("zone_id"), _int(c("l_orderkey") % 100).alias("y"), _int(c("l_partkey") % 100).alias("x")).where("(y + x) % 25 = zone_id").distinct()
    named = pairs.join(n, c("zone_id") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey"))
    return named.select("zone_id", c("n_name").alias("zone_name"), c("r_name").alias("borough"), "y", "x", (((c("y") + 2 * c("x")) % 4 + 1) / 4.0).alias("coverage"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, datetime, tile, baseline, cloud_cover): an image catalog out of the event stream and its JSON properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("datetime"), F.concat(F.lit("18T"), F.upper(F.substring("event_type", 1, 2))).alias("tile"),
        (3.0 + (F.col("user_id") % 4) * 0.5).alias("baseline"), (F.col("event_id") % 101).cast("double").alias("cloud_cover"), k.alias("k"),
    )
