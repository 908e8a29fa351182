"""Spatial blocks, splits, folds and samples; randomness is a hash of the key and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import hash_int
from .grids import block


def usable_blocks(df: DataFrame, value: str, size: int, height: int, width: int, least_share: float = 0.1) -> DataFrame:
    """(block_row, block_col, n_valid) of whole blocks with enough valid cells."""
    out = df.groupBy(block("y", size).alias("block_row"), block("x", size).alias("block_col")).agg(F.count(value).alias("n_valid"))
    return out.where((F.col("n_valid") >= least_share * size * size) & (F.col("block_row") < height // size) & (F.col("block_col") < width // size))


def _key(seed: int):
    return hash_int("block_row", "block_col", seed)


def split_blocks(blocks: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """label 1 for max(1, round-half-even(share * n)) blocks drawn by hash, 0 for the others."""
    number = F.row_number().over(Window.orderBy(_key(seed), "block_row", "block_col"))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return blocks.select("block_row", "block_col", (number <= F.greatest(F.lit(1), F.bround(total * share, 0))).cast("int").alias("label"))


def fold_blocks(blocks: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    number = F.row_number().over(Window.orderBy(_key(seed), "block_row", "block_col")) - 1
    return blocks.select("block_row", "block_col", (number % k).cast("int").alias("fold"))


def sample_per_block(df: DataFrame, value: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` valid cells of each block without replacement."""
    cells = df.where(F.col(value).isNotNull()).withColumns({"block_row": block("y", size), "block_col": block("x", size)})
    rank = F.row_number().over(Window.partitionBy("block_row", "block_col").orderBy(hash_int("y", "x", seed), "y", "x"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= n)


def stratified_sample(df: DataFrame, value: str, size: int, n: int, bins, n_bins: int, seed: int = 42) -> DataFrame:
    """Per block at most max(1, n // n_bins) cells of each bin, then others by hash up to ``n``."""
    cells = df.where(F.col(value).isNotNull()).withColumns({"block_row": block("y", size), "block_col": block("x", size), "bin": bins, "h": hash_int("y", "x", seed)})
    per = max(1, n // n_bins)
    within = F.row_number().over(Window.partitionBy("block_row", "block_col", "bin").orderBy("h", "y", "x"))
    first = cells.withColumn("extra", (within > per).cast("int"))
    rank = F.row_number().over(Window.partitionBy("block_row", "block_col").orderBy("extra", "h", "y", "x"))
    return first.withColumn("rank", rank).where(F.col("rank") <= n)


def hash_sample(df: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes: a sample without replacement."""
    return df.withColumn("h", hash_int(*key, seed)).orderBy("h", *key).limit(n)
