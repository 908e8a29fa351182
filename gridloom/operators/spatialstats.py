"""Local and global spatial association over cells and offset neighbourhoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import offsets, scatter

# Fixed values.
QUADRANTS = {1: "HH", 2: "LH", 3: "LL", 4: "HL"}


def edges(cells: DataFrame, band: float) -> DataFrame:
    """(y, x, ny, nx): ordered pairs of cells within ``band`` cells of each other."""
    near = scatter(cells, offsets(band), {}).select((F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx"), "y", "x")
    return near.join(cells.select("y", "x"), ["y", "x"])


def lags(cells: DataFrame, value: str, band: float) -> DataFrame:
    """(y, x, value, lag, n_neighbours) of cells that have a neighbour; weights are row-standardised."""
    known = cells.where(F.col(value).isNotNull()).select("y", "x", value)
    near = scatter(known, offsets(band), {"v": F.col(value)}).groupBy("y", "x").agg(F.avg("v").alias("lag"), F.count("v").alias("n_neighbours"))
    return known.join(near, ["y", "x"])


def local_moran(cells: DataFrame, value: str, band: float = 1.5) -> DataFrame:
    """(y, x, n_neighbours, local_i, quadrant): (n - 1) z lag(z) / sum(z^2); islands are dropped first."""
    near = lags(cells, value, band)
    total = near.agg(F.avg(value).alias("mu"), F.count(F.lit(1)).alias("n"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    z, lag = F.col(value) - F.col("mu"), F.col("lag") - F.col("mu")
    q = F.when((z > 0) & (lag > 0), 1).when((z <= 0) & (lag > 0), 2).when((z <= 0) & (lag <= 0), 3).otherwise(4)
    return near.join(F.broadcast(total)).select("y", "x", "n_neighbours", ((F.col("n") - 1) * z * lag / F.col("ss")).alias("local_i"), q.alias("quadrant"))


def global_moran(cells: DataFrame, value: str, band: float = 1.5) -> DataFrame:
    near = lags(cells, value, band)
    total = near.agg(F.avg(value).alias("mu"))
    z, lag = F.col(value) - F.col("mu"), F.col("lag") - F.col("mu")
    return near.join(F.broadcast(total)).agg((F.sum(z * lag) / F.sum(z * z)).alias("moran_i"), F.count(F.lit(1)).alias("n"))


def correlogram(cells: DataFrame, value: str, distances: list[int]) -> DataFrame:
    """(distance, n_pairs, covariance, autocorrelation): pairs of cells a given number of rows or columns apart."""
    known = cells.where(F.col(value).isNotNull()).select("y", "x", F.col(value).alias("a"))
    total = known.agg(F.avg("a").alias("mu"), F.var_pop("a").alias("v"))
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(p).alias("p"), F.lit(q).alias("q")) for d in distances for p, q in ((d, 0), (0, d))])
    moved = known.select("y", "x", "a", F.explode(steps).alias("s")).select((F.col("y") + F.col("s.p")).alias("y"), (F.col("x") + F.col("s.q")).alias("x"), "a", F.col("s.d").alias("distance"))
    pairs = moved.join(known.select("y", "x", F.col("a").alias("b")), ["y", "x"]).join(F.broadcast(total))
    cov = F.avg((F.col("a") - F.col("mu")) * (F.col("b") - F.col("mu")))
    return pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("n_pairs"), cov.alias("covariance"), (cov / F.first("v")).alias("autocorrelation"))


def permutation_p(cells: DataFrame, value: str, band: float = 1.5, permutations: int = 9999, seed: int = 42) -> DataFrame:
    """(y, x, local_i, p): conditional permutation pseudo p-values of local Moran.

    A cell's neighbour values are replaced by draws without replacement from all other cells' values, which are sent to
    every task; each cell seeds its own generator, so results do not depend on partitioning.
    """
    near = lags(cells, value, band)
    total = near.agg(F.avg(value).alias("mu"), F.count(F.lit(1)).alias("n"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss")).first()
    mu, n, ss = total["mu"], total["n"], total["ss"]
    known = near.select("y", "x", value).toPandas().sort_values(["y", "x"])
    place = lambda t: t["y"].to_numpy(np.int64) * 2**32 + t["x"].to_numpy(np.int64)
    sent = cells.sparkSession.sparkContext.broadcast((place(known), known[value].to_numpy(np.float64) - (mu or 0.0)))

    def run(batches):
        places, pool = sent.value
        for pdf in batches:
            z, lag = pdf[value].to_numpy() - mu, pdf["lag"].to_numpy() - mu
            i_obs = (n - 1) * z * lag / ss
            p = np.empty(len(pdf))
            for r, (y, x, k, own) in enumerate(zip(pdf["y"], pdf["x"], pdf["n_neighbours"], np.searchsorted(places, place(pdf)))):
                rng = np.random.default_rng((seed, int(y), int(x)))
                taken, drawn = np.full((permutations, 1), own), np.zeros(permutations)
                for j in range(int(k)):  # a number among the cells not taken yet, counted on past those that are
                    one = rng.integers(0, len(pool) - 1 - j, permutations)
                    for i in range(j + 1):
                        one += one >= taken[:, i]
                    drawn += pool[one]
                    taken = np.sort(np.column_stack([taken, one]), axis=1)
                sim = (n - 1) * z[r] * (drawn / k) / ss
                larger = int((sim >= i_obs[r]).sum())
                p[r] = (min(larger, permutations - larger) + 1) / (permutations + 1)
            yield pdf[["y", "x"]].assign(local_i=i_obs, p=p)

    return near.mapInPandas(run, "y int, x int, local_i double, p double")
