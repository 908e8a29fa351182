"""Rasters as Parquet partitioned by tile rows, with windowed reads that prune partitions; CSV as the plain format."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder. Where none is set: a temporary one in local mode, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_raster(cells: DataFrame, value: str, tile: int, path: str | None = None, mode: str = "overwrite") -> str:
    """Cells under ``path`` by tile row; dynamic overwrite replaces only the tile rows that are written."""
    path = path or scratch(cells.sparkSession, "raster")
    rows = cells.select("y", "x", value, F.expr(f"int(y div {tile})").alias("tile_row"))
    rows.repartition("tile_row").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tile_row").option("compression", "zstd").parquet(path)
    return path


def read_raster(spark: SparkSession, path: str, value: str, nodata: float | None = None, ys: tuple[int, int] | None = None, xs: tuple[int, int] | None = None, tile: int = 10, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A window of a raster, decoded: nodata to NULL, then value * scale + offset. Tile rows outside are never opened."""
    df = spark.read.schema(f"y int, x int, {value} double, tile_row int").parquet(path)
    if ys:
        df = df.where(F.col("tile_row").between(ys[0] // tile, ys[1] // tile) & F.col("y").between(*ys))
    if xs:
        df = df.where(F.col("x").between(*xs))
    v = F.nullif(F.col(value), F.lit(nodata)) if nodata is not None else F.col(value)
    return df.select("y", "x", (v * scale + offset).alias(value))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
