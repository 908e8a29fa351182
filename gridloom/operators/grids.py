"""Raster operations as relations on (y, x): coarsening, neighbourhoods, morphology, texture, resampling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block(c: str, n: int) -> Column:
    return F.expr(f"int({c} div {n})")


def coarsen(df: DataFrame, factor: int, columns: list[str], least_cover: float = 0.75) -> DataFrame:
    """Means over factor x factor cells where enough of them are valid in the first column; edges may be ragged."""
    need = least_cover * factor * factor
    first = columns[0]
    out = df.groupBy(block("y", factor).alias("y"), block("x", factor).alias("x")).agg(*[F.avg(c).alias(c) for c in columns], F.count(first).alias("n_valid"))
    return out.where(F.col("n_valid") >= need)


def dense(df: DataFrame, height: int, width: int) -> DataFrame:
    """Every cell of the grid, missing ones with NULLs. The cell list comes from two ranges, not from the data."""
    spark = df.sparkSession
    ys = spark.range(height).select(F.col("id").cast("int").alias("y"))
    cells = ys.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return cells.join(df, ["y", "x"], "left")


def offsets(radius: float, centre: bool = False) -> list[tuple[int, int]]:
    r = int(radius)
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if (centre or (a, b) != (0, 0)) and a * a + b * b <= radius * radius]


def square(radius: int, centre: bool = False) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if centre or (a, b) != (0, 0)]


def scatter(df: DataFrame, steps: Iterable[tuple[int, int]], values: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` dealt to the cells that they are a neighbour of: (y, x, dy, dx, values).

    Aggregating these by (y, x) is a neighbourhood operator with one shuffle and no self-join.
    """
    shifts = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])
    out = df.select("y", "x", *[v.alias(k) for k, v in values.items()], F.explode(shifts).alias("s"))
    return out.select((F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"), F.col("s.dy").alias("dy"), F.col("s.dx").alias("dx"), *values)


def neighbour_mean(df: DataFrame, value: str, radius: int = 2) -> DataFrame:
    """Mean of the valid neighbours of each cell in a square window, without the cell itself."""
    near = scatter(df.where(F.col(value).isNotNull()), square(radius), {"v": F.col(value)}).groupBy("y", "x").agg(F.avg("v").alias("neighbour_mean"), F.count("v").alias("n_neighbours"))
    return df.select("y", "x", value).join(near, ["y", "x"], "left")


# Fixed values.
SOBEL = {(-1, -1): (-1, -1), (-1, 0): (0, -2), (-1, 1): (1, -1), (0, -1): (-2, 0), (0, 1): (2, 0), (1, -1): (-1, 1), (1, 0): (0, 2), (1, 1): (1, 1)}


def sobel(df: DataFrame, value: str) -> DataFrame:
    """0.5 |gx| + 0.5 |gy| for cells with all eight neighbours."""
    weight = lambda i: sum((F.when((F.col("dy") == a) & (F.col("dx") == b), float(w[i])).otherwise(0.0) for (a, b), w in SOBEL.items()), F.lit(0.0))
    near = scatter(df.where(F.col(value).isNotNull()), SOBEL, {"v": F.col(value)})
    g = near.groupBy("y", "x").agg(F.sum(F.col("v") * weight(0)).alias("gx"), F.sum(F.col("v") * weight(1)).alias("gy"), F.count(F.lit(1)).alias("n"))
    return g.where("n = 8").select("y", "x", (0.5 * F.abs("gx") + 0.5 * F.abs("gy")).alias("gradient"))


CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def dilate(cells: DataFrame, height: int, width: int, times: int = 1) -> DataFrame:
    """Cells (y, x) grown by a cross, within the grid."""
    for _ in range(times):
        cells = scatter(cells, CROSS, {}).select("y", "x").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()
    return cells


def erode(cells: DataFrame, times: int = 1) -> DataFrame:
    """Cells whose whole cross is set; beyond the grid nothing is."""
    for _ in range(times):
        cells = scatter(cells, CROSS, {}).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("y", "x")
    return cells


def bilinear_double(df: DataFrame, value: str) -> DataFrame:
    """A grid of half the cell size, bilinear between cell centres; NULL where one of the four sources is missing."""
    parts = []
    for dy in (0, 1):
        for dx in (0, 1):
            # the fine cell (2y + dy, 2x + dx) lies a quarter towards the neighbour on that side
            for sy in (0, 1):
                for sx in (0, 1):
                    parts.append((dy, dx, sy * (1 if dy else -1), sx * (1 if dx else -1), (0.25 if sy else 0.75) * (0.25 if sx else 0.75)))
    table = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(p).alias("py"), F.lit(q).alias("px"), F.lit(w).alias("w")) for a, b, p, q, w in parts])
    dealt = df.where(F.col(value).isNotNull()).select("y", "x", F.col(value).alias("v"), F.explode(table).alias("t"))
    fine = dealt.select((2 * (F.col("y") - F.col("t.py")) + F.col("t.dy")).alias("y"), (2 * (F.col("x") - F.col("t.px")) + F.col("t.dx")).alias("x"), F.col("v"), F.col("t.w").alias("w"))
    return fine.groupBy("y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("value"), F.count(F.lit(1)).alias("n")).where("n = 4").select("y", "x", "value")


def overlap_resample(df: DataFrame, value: str, source: float, target: float) -> DataFrame:
    """Area-weighted means of cells of size ``source`` on a grid of size ``target``."""
    ratio = source / target

    def spans(c: str, out: str) -> Column:
        lo, hi = F.col(c) * ratio, (F.col(c) + 1) * ratio
        steps = F.sequence(F.floor(lo), F.greatest(F.ceil(hi) - 1, F.floor(lo)))
        return F.filter(F.transform(steps, lambda i: F.struct(i.cast("int").alias(out), (F.least(hi, i + 1.0) - F.greatest(lo, i.cast("double"))).alias("w"))), lambda s: s["w"] > 1e-9)

    dealt = df.where(F.col(value).isNotNull()).select(F.explode(spans("y", "i")).alias("a"), "x", F.col(value).alias("v")).select("a", "v", F.explode(spans("x", "i")).alias("b"))
    w = F.col("a.w") * F.col("b.w")
    return dealt.groupBy(F.col("a.i").alias("y"), F.col("b.i").alias("x")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("value"), F.sum(w).alias("area"))


def texture(df: DataFrame, level: str, height: int, width: int) -> DataFrame:
    """Co-occurrence measures of each 3 x 3 window, averaged over four angles at distance 1.

    The window must be fully valid (reflected at the border). Pairs of a window are counted both ways and normalised
    per angle. A uniform window gives contrast 0, dissimilarity 0, homogeneity 1, energy 1, entropy 0, variance 0.
    """
    cells = df.where(F.col(level).isNotNull())
    # each cell reaches the windows that hold it; reflection repeats border cells (index -1 is 0, index n is n - 1)
    def places(c: str, n: int) -> Column:
        at = F.col(c)
        inner = [F.struct((at - d).alias("w"), F.lit(d).alias("d")) for d in (-1, 0, 1)]
        return F.filter(F.concat(F.array(*inner), F.when(at == 0, F.array(F.struct(F.lit(0).alias("w"), F.lit(-1).alias("d")))).otherwise(F.array()), F.when(at == n - 1, F.array(F.struct(F.lit(n - 1).alias("w"), F.lit(1).alias("d")))).otherwise(F.array())), lambda s: (s["w"] >= 0) & (s["w"] < n))

    spread = cells.select(F.col(level).cast("int").alias("g"), F.explode(places("y", height)).alias("a"), "x").select("g", "a", F.explode(places("x", width)).alias("b"))
    windows = spread.groupBy(F.col("a.w").alias("y"), F.col("b.w").alias("x")).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when((F.col("a.d") == p) & (F.col("b.d") == q), F.col("g"))).alias(f"g{p + 1}{q + 1}") for p in (-1, 0, 1) for q in (-1, 0, 1)]).where("n = 9")
    angles = []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        pairs = [F.struct(F.col(f"g{p}{q}").alias("i"), F.col(f"g{p + dy}{q + dx}").alias("j")) for p in range(3) for q in range(3) if 0 <= p + dy < 3 and 0 <= q + dx < 3]
        angles.append(F.struct(F.array(*pairs).alias("pairs")))
    dealt = windows.select("y", "x", F.posexplode(F.array(*angles)).alias("angle", "s")).select("y", "x", "angle", F.explode(F.concat("s.pairs", F.transform("s.pairs", lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))))).alias("p"))
    counted = dealt.groupBy("y", "x", "angle", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    # an angle has 12 ordered pairs along an axis and 8 along a diagonal
    p = F.col("n") / F.when(F.col("angle") % 2 == 0, 12.0).otherwise(8.0)
    d = F.col("i") - F.col("j")
    per = counted.groupBy("y", "x", "angle").agg(
        F.sum(d * d * p).alias("contrast"), F.sum(F.abs(d) * p).alias("dissimilarity"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * p).alias("energy"),
        (-F.sum(p * F.log2(p))).alias("entropy"), (F.sum(F.col("i") * F.col("i") * p) - F.sum(F.col("i") * p) * F.sum(F.col("i") * p)).alias("variance"),
    )
    return per.groupBy("y", "x").agg(*[F.avg(c).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "entropy", "variance")])
