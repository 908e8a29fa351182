"""Queries over the 100 x 100 grid: resampling, overlays, bins, neighbourhoods, zones, change."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import semantics as S
from ..functions.semantics import FEET_PER_METRE, rounded
from ..operators import grids, spatialstats
from ..sources import views
from .registry import query
from .relations import r6, sql

c = F.col
N = 100


def r(*cols):
    return [rounded(x).alias(x) for x in cols]


def valid(spark, d):
    return views.grid(spark, d).where("lidar IS NOT NULL AND pred IS NOT NULL")


# ---- resampling ----------------------------------------------------------------------------------------------------


@query(sql("SELECT y // 10 AS y, x // 10 AS x, " + r6("100.0::DOUBLE * avg(CASE WHEN code = 0 THEN NULL WHEN code IN (1, 2) THEN 1 ELSE 0 END)", "pct") + ", count(CASE WHEN code <> 0 THEN 1 END) AS n FROM grid GROUP BY 1, 2"))
def class_fraction_resample(spark, d):
    member = F.when(c("code") == 0, None).when(c("code").isin(1, 2), 1).otherwise(0)
    return views.grid(spark, d).groupBy(grids.block("y", 10).alias("y"), grids.block("x", 10).alias("x")).agg(rounded(100.0 * F.avg(member)).alias("pct"), F.count(member).alias("n"))


_bands = "SELECT y, x, CASE WHEN height < 0.5 THEN 0 WHEN height < 2.5 THEN 1 WHEN height < 5.0 THEN 2 ELSE 3 END AS b FROM grid WHERE code <> 0"


@query(sql("SELECT * FROM (SELECT y // 10 AS y, x // 10 AS x, " + ", ".join(r6(f"100.0::DOUBLE * avg((b = {i})::INTEGER)", f"band{i}") for i in range(4)) + ", " + r6("count(*) / 100.0::DOUBLE", "coverage") + " FROM hb GROUP BY 1, 2) WHERE coverage >= 0.8", hb=_bands))
def height_band_fractions(spark, d):
    b = views.grid(spark, d).where("code <> 0").withColumn("b", S.bin_left_closed(c("height"), [0.5, 2.5, 5.0]))
    out = b.groupBy(grids.block("y", 10).alias("y"), grids.block("x", 10).alias("x")).agg(*[rounded(100.0 * F.avg((c("b") == i).cast("int"))).alias(f"band{i}") for i in range(4)], rounded(F.count(F.lit(1)) / 100.0).alias("coverage"))
    return out.where("coverage >= 0.8D")


# Class name, land-cover code, height from (included), height to (not included); None where open.
RULES = [
    ("tree_under_2.5m", 1, None, 2.5),
    ("tree_2.5_5m", 1, 2.5, 5.0),
    ("tree_5m_plus", 1, 5.0, None),
    ("lawn", 2, None, 0.5),
    ("shrub", 2, 0.5, 2.5),
    ("grass_shrub_2.5m_plus", 2, 2.5, None),
    ("bare_soil", 3, None, None),
    ("water", 4, None, None),
    ("building_under_15m", 5, None, 15.0),
    ("building_15m_plus", 5, 15.0, None),
    ("road", 6, None, None),
    ("other_impervious", 7, None, None),
    ("railroad", 8, None, None),
]
_heights = "SELECT y, x, code, CASE WHEN (y + x) % 17 <> 0 THEN height END AS h FROM grid WHERE code <> 0"


def classified(spark, d):
    """Cells with ``pos`` (from 1) and ``name`` of the last rule that holds for them, NULL where none does."""
    g = views.grid(spark, d).where("code <> 0").withColumn("h", F.when((c("y") + c("x")) % 17 != 0, c("height")))
    rules = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(RULES, 1)], "pos int, name string, rule_code int, lo double, hi double"))
    hit = (c("code") == c("rule_code")) & (c("lo").isNull() | (c("h") >= c("lo"))) & (c("hi").isNull() | (c("h") < c("hi")))
    found = g.join(rules, hit, "left").groupBy("y", "x").agg(F.max(F.struct("pos", "name")).alias("best"), F.first("code").alias("code"), F.first("h").alias("h"))
    return found.select("y", "x", "code", "h", c("best.pos").alias("pos"), c("best.name").alias("name"))


# written from the classes' definition, not from the table above
_classified = """SELECT y, x, code, h, CASE
  WHEN code = 1 AND h < 2.5 THEN 'tree_under_2.5m' WHEN code = 1 AND h < 5 THEN 'tree_2.5_5m' WHEN code = 1 AND h >= 5 THEN 'tree_5m_plus'
  WHEN code = 2 AND h < 0.5 THEN 'lawn' WHEN code = 2 AND h < 2.5 THEN 'shrub' WHEN code = 2 AND h >= 2.5 THEN 'grass_shrub_2.5m_plus'
  WHEN code = 3 THEN 'bare_soil' WHEN code = 4 THEN 'water'
  WHEN code = 5 AND h < 15 THEN 'building_under_15m' WHEN code = 5 AND h >= 15 THEN 'building_15m_plus'
  WHEN code = 6 THEN 'road' WHEN code = 7 THEN 'other_impervious' WHEN code = 8 THEN 'railroad' END AS name FROM hts"""
_order = (
    "'tree_under_2.5m', 'tree_2.5_5m', 'tree_5m_plus', 'lawn', 'shrub', 'grass_shrub_2.5m_plus', 'bare_soil', 'water', "
    "'building_under_15m', 'building_15m_plus', 'road', 'other_impervious', 'railroad'"
)
_fractions = ", ".join(r6(f"avg(coalesce((list_position([{_order}], name) = {i})::INTEGER, 0))", f"class_{i}") for i in range(1, 14))


@query(sql("SELECT y, x, name FROM cls", hts=_heights, cls=_classified))
def rule_table_classify(spark, d):
    return classified(spark, d).select("y", "x", "name")


@query(sql("SELECT y // 10 AS y, x // 10 AS x, count(*) AS n, count(name) AS n_valid, " + _fractions + " FROM cls GROUP BY 1, 2", hts=_heights, cls=_classified))
def landcover_height_fractions(spark, d):
    share = [rounded(F.avg(F.coalesce((c("pos") == i).cast("int"), F.lit(0)))).alias(f"class_{i}") for i in range(1, len(RULES) + 1)]
    coarse = classified(spark, d).groupBy(grids.block("y", 10).alias("y"), grids.block("x", 10).alias("x"))
    return coarse.agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("n_valid"), *share)


@query(sql("SELECT y, x, code FROM (SELECT y // 5 AS y, x // 5 AS x, code, row_number() OVER (PARTITION BY y // 5, x // 5 ORDER BY count(*) DESC, code) AS k FROM grid GROUP BY y // 5, x // 5, code) WHERE k = 1"))
def mode_resample(spark, d):
    per = views.grid(spark, d).groupBy(grids.block("y", 5).alias("y"), grids.block("x", 5).alias("x"), "code").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("y", "x").agg(F.min(F.struct((-c("n")).alias("n"), "code")).alias("b")).select("y", "x", c("b.code").alias("code"))


@query(sql("SELECT y // 8 AS y, x // 8 AS x, " + r6("avg(pred)", "pred") + ", count(pred) AS n_valid FROM grid GROUP BY 1, 2 HAVING count(pred) >= 48"))
def coarsen_mean_coverage(spark, d):
    return grids.coarsen(views.grid(spark, d), 8, ["pred"]).select("y", "x", *r("pred"), "n_valid")


_dense = "SELECT a.y::INTEGER AS y, b.x::INTEGER AS x, lidar, pred FROM (SELECT unnest(range(100)) AS y) a, (SELECT unnest(range(100)) AS x) b LEFT JOIN grid g ON g.y = a.y AND g.x = b.x"


@query(sql("SELECT y // 8 AS y, x // 8 AS x, " + r6("avg((pred IS NOT NULL)::INTEGER)", "coverage") + " FROM dn GROUP BY 1, 2", dn=_dense))
def coverage_fraction(spark, d):
    g = grids.dense(views.grid(spark, d), N, N)
    return g.groupBy(grids.block("y", 8).alias("y"), grids.block("x", 8).alias("x")).agg(rounded(F.avg(c("pred").isNotNull().cast("int"))).alias("coverage"))


@query(sql(" UNION ALL ".join(f"SELECT {f} AS factor, count(*) AS n, " + r6("sqrt(avg((p - l) * (p - l)))", "rmse") + ", " + r6("avg(p - l)", "bias") + f" FROM (SELECT avg(pred) AS p, avg(lidar) AS l FROM valid GROUP BY y // {f}, x // {f} HAVING count(*) >= {0.75 * f * f})" for f in (2, 5, 10))))
def multi_scale_rollup(spark, d):
    v, out = valid(spark, d), None
    for f in (2, 5, 10):
        one = grids.coarsen(v, f, ["pred", "lidar"]).agg(F.count(F.lit(1)).alias("n"), rounded(metrics.rmse(c("pred"), c("lidar"))).alias("rmse"), rounded(metrics.bias(c("pred"), c("lidar"))).alias("bias")).select(F.lit(f).alias("factor"), "n", "rmse", "bias")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT y, x, round(avg(value), 9) + 0.0::DOUBLE AS value FROM (SELECT 2 * (y - py) + dy AS y, 2 * (x - px) + dx AS x, sum(v * w) AS value, count(*) AS n FROM (SELECT y, x, pred AS v FROM grid WHERE pred IS NOT NULL), k GROUP BY 1, 2 HAVING count(*) = 4) GROUP BY y, x",
    k="SELECT a.d AS dy, b.d AS dx, a.p AS py, b.p AS px, a.w * b.w AS w FROM one a, one b", one="SELECT * FROM (VALUES (0, 0, 0.75::DOUBLE), (0, -1, 0.25::DOUBLE), (1, 0, 0.75::DOUBLE), (1, 1, 0.25::DOUBLE)) t(d, p, w)"))
def bilinear_resample(spark, d):
    return grids.bilinear_double(views.grid(spark, d), "pred").select("y", "x", rounded("value", 9).alias("value"))  # sixteenths end in a 5 at the seventh digit


@query(sql("SELECT ty AS y, tx AS x, " + r6("sum(pred * wy * wx) / sum(wy * wx)", "value") + ", " + r6("sum(wy * wx)", "area") + " FROM grid JOIN ov a ON a.s = grid.y JOIN (SELECT s, t AS tx, w AS wx FROM ov) b ON b.s = grid.x, LATERAL (SELECT a.t AS ty, a.w AS wy) WHERE pred IS NOT NULL GROUP BY 1, 2",
    ov="SELECT s, t, least((s + 1) * 0.75::DOUBLE, t + 1.0::DOUBLE) - greatest(s * 0.75::DOUBLE, t::DOUBLE) AS w FROM (SELECT unnest(range(100))::INTEGER AS s), (SELECT unnest(range(80))::INTEGER AS t) WHERE least((s + 1) * 0.75::DOUBLE, t + 1.0::DOUBLE) - greatest(s * 0.75::DOUBLE, t::DOUBLE) > 0.000000001"))
def overlap_weighted_resample(spark, d):
    return grids.overlap_resample(views.grid(spark, d), "pred", 1.5, 2.0).select("y", "x", *r("value", "area"))


# ---- overlays and accuracy -----------------------------------------------------------------------------------------


@query(sql("SELECT y, x, " + r6("pred - lidar", "resid") + " FROM valid"))
def overlay_residual(spark, d):
    g = views.grid(spark, d)
    p, t = g.where("pred IS NOT NULL").select("y", "x", "pred"), g.where("lidar IS NOT NULL").select("y", "x", "lidar")
    return p.join(t, ["y", "x"]).select("y", "x", rounded(c("pred") - c("lidar")).alias("resid"))


@query(sql("SELECT y, x, 3 AS n_layers FROM valid WHERE other > 20"))
def common_valid_overlay(spark, d):
    g = views.grid(spark, d)
    layers = [g.where("lidar IS NOT NULL"), g.where("pred IS NOT NULL"), g.where("other > 20")]
    union = layers[0].select("y", "x")
    for x in layers[1:]:
        union = union.union(x.select("y", "x"))
    return union.groupBy("y", "x").agg(F.count(F.lit(1)).cast("int").alias("n_layers")).where("n_layers = 3")


@query(sql("SELECT count(*) AS n, count_if(a.y IS NULL OR b.y IS NULL)::BIGINT AS unmatched FROM (SELECT y, x FROM grid WHERE lidar IS NOT NULL) a FULL JOIN (SELECT y, x FROM grid WHERE pred IS NOT NULL) b ON a.y = b.y AND a.x = b.x"))
def exact_align_check(spark, d):
    g = views.grid(spark, d)
    a, b = g.where("lidar IS NOT NULL").select("y", "x", F.lit(1).alias("a")), g.where("pred IS NOT NULL").select("y", "x", F.lit(1).alias("b"))
    return a.join(b, ["y", "x"], "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("a").isNull() | c("b").isNull()).alias("unmatched"))


_ACC = {"bias": "avg(pred - lidar)", "mae": "avg(abs(pred - lidar))", "rmse": "sqrt(avg((pred - lidar) * (pred - lidar)))", "r2": "1 - sum((lidar - pred) * (lidar - pred)) / (count(*) * var_pop(lidar))"}


@query(sql("SELECT count(*) AS n, " + ", ".join(r6(e, k) for k, e in _ACC.items()) + " FROM valid"))
def accuracy_metrics(spark, d):
    return valid(spark, d).agg(F.count(F.lit(1)).alias("n"), *[rounded(f(c("pred"), c("lidar"))).alias(k) for k, f in metrics.METRICS.items()])


@query(sql(" UNION ALL ".join(f"SELECT {f} AS factor, " + r6("sqrt(b * b + (q - b * b) * iv)", "rmse_independent") + f" FROM (SELECT avg(1.0::DOUBLE / n) AS iv, (SELECT avg(pred - lidar) FROM valid) AS b, (SELECT avg((pred - lidar) * (pred - lidar)) FROM valid) AS q FROM (SELECT count(*) AS n FROM valid GROUP BY y // {f}, x // {f}))" for f in (2, 5, 10))))
def rmse_independent_curve(spark, d):
    v, out = valid(spark, d), None
    total = v.agg(metrics.bias(c("pred"), c("lidar")).alias("b"), F.avg((c("pred") - c("lidar")) * (c("pred") - c("lidar"))).alias("q"))
    for f in (2, 5, 10):
        inv = v.groupBy(grids.block("y", f).alias("p"), grids.block("x", f).alias("q2")).agg(F.count(F.lit(1)).alias("n")).agg(F.avg(1.0 / c("n")).alias("iv"))
        one = F.broadcast(total).join(inv).select(F.lit(f).alias("factor"), rounded(F.sqrt(c("b") * c("b") + (c("q") - c("b") * c("b")) * c("iv"))).alias("rmse_independent"))
        out = one if out is None else out.unionByName(one)
    return out


_cbin = "CASE WHEN lidar <= 0 THEN 0 WHEN lidar >= 100 THEN 21 ELSE 1 + least(greatest(floor(lidar / 5.0), 0), 19) END::INTEGER"


@query(sql("SELECT y, x, bin, " + r6("e - avg(e) OVER (PARTITION BY bin)", "resid_adj") + " FROM (SELECT y, x, pred - lidar AS e, " + _cbin + " AS bin FROM valid)"))
def canopy_bias_adjust(spark, d):
    v = valid(spark, d).select("y", "x", S.canopy_bin(c("lidar")).alias("bin"), (c("pred") - c("lidar")).alias("e"))
    per = v.groupBy("bin").agg(F.avg("e").alias("m"))  # at most 23 bins
    return v.join(F.broadcast(per), "bin").select("y", "x", "bin", rounded(c("e") - c("m")).alias("resid_adj"))


@query(sql("SELECT bin, count(*) AS n, " + r6("min(lidar)", "min_canopy") + ", " + r6("max(lidar)", "max_canopy") + ", " + r6("avg(pred - lidar)", "mean_resid") + " FROM (SELECT *, " + _cbin + " AS bin FROM valid) GROUP BY bin"))
def bias_table(spark, d):
    return valid(spark, d).groupBy(S.canopy_bin(c("lidar")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.min("lidar")).alias("min_canopy"), rounded(F.max("lidar")).alias("max_canopy"), rounded(F.avg(c("pred") - c("lidar"))).alias("mean_resid"))


_cut = "CASE WHEN lidar > 0 AND lidar <= 100 THEN ceil(lidar / 10.0) - 1 END::INTEGER"


@query(sql("SELECT b::INTEGER AS bin, count(e) AS n, " + r6("avg(e)", "mean_bias") + ", " + r6("sqrt(avg(e * e))", "rmse") + ", " + r6("100.0::DOUBLE * count(e) / (SELECT count(*) FROM valid)", "pct") + " FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT pred - lidar AS e, " + _cut + " AS bin FROM valid) ON b = bin GROUP BY b"))
def residual_bins(spark, d):
    v = valid(spark, d).select((c("pred") - c("lidar")).alias("e"), S.cut_right_closed(c("lidar"), [10.0 * i for i in range(11)]).alias("bin"))
    per = v.groupBy("bin").agg(F.count("e").alias("n"), F.avg("e").alias("mean_bias"), F.sqrt(F.avg(c("e") * c("e"))).alias("rmse"))
    total = v.agg(F.count(F.lit(1)).alias("total"))
    bins = spark.range(10).select(c("id").cast("int").alias("bin"))
    return bins.join(per, "bin", "left").join(F.broadcast(total)).select("bin", F.coalesce("n", F.lit(0)).alias("n"), *r("mean_bias", "rmse"), rounded(100.0 * F.coalesce("n", F.lit(0)) / c("total")).alias("pct"))


_band = "CASE WHEN other >= 0 AND other < 5 THEN 0 WHEN other >= 5 AND other < 20 THEN 1 WHEN other >= 20 AND other < 40 THEN 2 WHEN other >= 40 AND other < 60 THEN 3 END"


@query(sql("SELECT band, bin, count(*) AS n, " + r6("quantile_cont(e, 0.5)", "median") + ", " + r6("quantile_cont(e, 0.25)", "p25") + ", " + r6("quantile_cont(e, 0.75)", "p75") + f" FROM (SELECT {_band} AS band, least(floor(lidar / 10), 9)::INTEGER AS bin, pred - lidar AS e FROM valid) WHERE band IS NOT NULL GROUP BY band, bin"))
def median_iqr_bins(spark, d):
    band = F.when((c("other") >= 0) & (c("other") < 60), S.bin_left_closed(c("other"), [5.0, 20.0, 40.0]))
    v = valid(spark, d).select(band.alias("band"), S.floor_bin(c("lidar"), 10.0, 9).alias("bin"), (c("pred") - c("lidar")).alias("e")).where("band IS NOT NULL")
    q = v.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("e", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("band", "bin", "n", rounded(c("q")[1]).alias("median"), rounded(c("q")[0]).alias("p25"), rounded(c("q")[2]).alias("p75"))


@query(sql(f"SELECT band, count(*) AS n, " + r6("avg(pred - lidar)", "bias") + f" FROM (SELECT *, {_band} AS band FROM valid) WHERE band IS NOT NULL GROUP BY band"))
def residual_bins_by_cover(spark, d):
    band = F.when((c("other") >= 0) & (c("other") < 60), S.bin_left_closed(c("other"), [5.0, 20.0, 40.0]))
    return valid(spark, d).withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), rounded(metrics.bias(c("pred"), c("lidar"))).alias("bias"))


@query(sql("SELECT " + r6("1.4826::DOUBLE * (SELECT median(abs(v - m)) FROM e, mm)", "mad_sd") + ", " + r6("(SELECT (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349::DOUBLE FROM e WHERE y % 20 = 0 AND x % 20 = 0)", "iqr_sd"), e="SELECT y, x, pred - lidar AS v FROM valid", mm="SELECT median(v) AS m FROM e"))
def robust_stats(spark, d):
    e = valid(spark, d).select("y", "x", (c("pred") - c("lidar")).alias("v"))
    m = e.agg(F.median("v").alias("m"))
    mad = e.join(F.broadcast(m)).agg((1.4826 * F.median(F.abs(c("v") - c("m")))).alias("mad_sd"))
    iqr = e.where("pmod(y, 20) = 0 AND pmod(x, 20) = 0").agg(((F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))) / 1.349).alias("iqr_sd"))
    return mad.join(F.broadcast(iqr)).select(*r("mad_sd", "iqr_sd"))


@query(sql("SELECT " + ", ".join(r6(e, k) for k, e in {"nse": "1 - sum((lidar - pred) * (lidar - pred)) / (count(*) * var_pop(lidar))", "ccc": "2 * covar_pop(lidar, pred) / (var_pop(lidar) + var_pop(pred) + (avg(lidar) - avg(pred)) * (avg(lidar) - avg(pred)))", "rma_slope": "sign(corr(lidar, pred)) * stddev_pop(pred) / stddev_pop(lidar)", "rma_intercept": "avg(pred) - sign(corr(lidar, pred)) * stddev_pop(pred) / stddev_pop(lidar) * avg(lidar)", "pearson": "corr(lidar, pred)", "ols_slope": "regr_slope(pred, lidar)", "ols_intercept": "regr_intercept(pred, lidar)"}.items()) + " FROM valid"))
def agreement_indices(spark, d):
    l, p = c("lidar"), c("pred")
    slope = F.signum(F.corr(l, p)) * F.stddev_pop(p) / F.stddev_pop(l)
    return valid(spark, d).agg(rounded(metrics.r2(p, l)).alias("nse"), rounded(2 * F.covar_pop(l, p) / (F.var_pop(l) + F.var_pop(p) + (F.avg(l) - F.avg(p)) * (F.avg(l) - F.avg(p)))).alias("ccc"), rounded(slope).alias("rma_slope"), rounded(F.avg(p) - slope * F.avg(l)).alias("rma_intercept"), rounded(F.corr(l, p)).alias("pearson"), rounded(F.regr_slope(p, l)).alias("ols_slope"), rounded(F.regr_intercept(p, l)).alias("ols_intercept"))


_rank = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE"


@query(sql("SELECT " + r6("corr(a, b)", "spearman") + f" FROM (SELECT {_rank('lidar')} AS a, {_rank('pred')} AS b FROM valid)"))
def spearman(spark, d):
    return metrics.spearman(valid(spark, d).select("lidar", "pred"), "lidar", "pred").select(*r("spearman"))


@query(sql("SELECT bin, count(*) AS n, count_if(sign(pred - 30) = sign(lidar - 30))::BIGINT AS agree FROM (SELECT *, least(floor(abs(lidar - 30) / 10), 9)::INTEGER AS bin FROM valid) GROUP BY bin HAVING count(*) >= 30"))
def sign_agreement_curve(spark, d):
    v = valid(spark, d).withColumn("bin", S.floor_bin(F.abs(c("lidar") - 30), 10.0, 9))
    return v.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum(c("pred") - 30) == F.signum(c("lidar") - 30)).alias("agree")).where("n >= 30")


_edges = ", ".join(str(i / 10) for i in range(11))


@query(sql("SELECT bin, count(*) AS n, " + r6("median(pred)", "median") + ", " + r6("avg(pred - lidar)", "bias") + ", " + r6("covar_pop(pred, lidar) / nullif(stddev_pop(pred) * stddev_pop(lidar), 0)", "pearson") + " FROM (SELECT v.*, (SELECT count(*) FROM (SELECT DISTINCT unnest(e) AS q FROM ed) WHERE q <= v.lidar)::INTEGER AS bin FROM valid v) GROUP BY bin HAVING count(*) >= 30", ed=f"SELECT quantile_cont(lidar, [{_edges}]) AS e FROM valid"))
def binned_response_curve(spark, d):
    v = valid(spark, d)
    ed = v.agg(F.array_distinct(F.percentile("lidar", F.array(*[F.lit(i / 10) for i in range(11)]))).alias("e"))
    b = v.join(F.broadcast(ed)).withColumn("bin", F.size(F.filter("e", lambda q: q <= c("lidar"))))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), rounded(F.median("pred")).alias("median"), rounded(metrics.bias(c("pred"), c("lidar"))).alias("bias"), rounded(metrics.pearson(c("pred"), c("lidar"))).alias("pearson")).where("n >= 30")


# ---- change --------------------------------------------------------------------------------------------------------

_chg = lambda a, b: f"CASE WHEN {b} - {a} < -5 THEN 'loss' WHEN {b} - {a} > -5 AND {b} - {a} < 5 THEN 'stable' WHEN {b} - {a} > 5 THEN 'gain' END"


@query(sql("SELECT actual, coalesce(count_if(p = 'loss'), 0)::BIGINT AS loss, count_if(p = 'stable')::BIGINT AS stable, count_if(p = 'gain')::BIGINT AS gain FROM (SELECT " + _chg("other", "lidar") + " AS actual, " + _chg("other", "pred") + " AS p FROM valid) WHERE actual IS NOT NULL AND p IS NOT NULL GROUP BY actual"))
def change_classify_confusion(spark, d):
    v = valid(spark, d).select(S.change_class(c("other"), c("lidar"), -5, 5).alias("actual"), S.change_class(c("other"), c("pred"), -5, 5).alias("p")).where("actual IS NOT NULL AND p IS NOT NULL")
    return v.groupBy("actual").agg(*[F.count_if(c("p") == k).alias(k) for k in ("loss", "stable", "gain")])


_cat = "CASE WHEN lidar > 40 AND other > 40 THEN 1 WHEN lidar > 40 THEN 2 WHEN other > 40 THEN 3 ELSE 0 END"


@query(sql(f"SELECT {_cat} AS category, count(*) AS n, " + r6("avg(pred)", "mean_pred") + " FROM valid GROUP BY 1"))
def persistence_crosstab(spark, d):
    cat = F.when((c("lidar") > 40) & (c("other") > 40), 1).when(c("lidar") > 40, 2).when(c("other") > 40, 3).otherwise(0)
    return valid(spark, d).groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("pred")).alias("mean_pred"))


@query(sql("SELECT " + r6("avg(CASE WHEN other > 40 THEN (lidar > 40)::INTEGER END)", "p_given") + ", " + r6("avg((lidar > 40)::INTEGER)", "p_chance") + " FROM valid"))
def overlap_vs_chance(spark, d):
    hit = (c("lidar") > 40).cast("int")
    return valid(spark, d).agg(rounded(F.avg(F.when(c("other") > 40, hit))).alias("p_given"), rounded(F.avg(hit)).alias("p_chance"))


@query(sql("SELECT " + ", ".join(r6(e, k) for k, e in {"bias": "avg(e)", "median": "median(e)", "std": "stddev_pop(e)", "p_low": "quantile_cont(e, 0.025)", "p_high": "quantile_cont(e, 0.975)", "share_zero": "avg((pred = 0)::INTEGER)", "flip_rate": "avg((sign(pred - other) <> sign(lidar - other))::INTEGER)"}.items()) + ", count(*) AS n FROM (SELECT *, pred - lidar AS e FROM valid) WHERE abs(lidar - other) < 10"))
def change_conditionals(spark, d):
    e = valid(spark, d).where(F.abs(c("lidar") - c("other")) < 10).withColumn("e", c("pred") - c("lidar"))
    flip = (F.signum(c("pred") - c("other")) != F.signum(c("lidar") - c("other"))).cast("int")
    return e.agg(*[rounded(x).alias(k) for k, x in {"bias": F.avg("e"), "median": F.median("e"), "std": F.stddev_pop("e"), "p_low": F.percentile("e", F.lit(0.025)), "p_high": F.percentile("e", F.lit(0.975)), "share_zero": F.avg((c("pred") == 0).cast("int")), "flip_rate": F.avg(flip)}.items()], F.count(F.lit(1)).alias("n"))


@query(sql("SELECT y // 10 AS y, x // 10 AS x, count(*) AS n, " + r6("sum(pred) / count(*) - sum(other) / count(*)", "change") + " FROM valid GROUP BY 1, 2"))
def common_denominator_diff(spark, d):
    return valid(spark, d).groupBy(grids.block("y", 10).alias("y"), grids.block("x", 10).alias("x")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("pred") / F.count(F.lit(1)) - F.sum("other") / F.count(F.lit(1))).alias("change"))


# ---- distributions -------------------------------------------------------------------------------------------------


@query(sql("SELECT " + r6("100.0::DOUBLE * count(pred) / count(*)", "pred_pct") + ", " + r6("100.0::DOUBLE * count(lidar) / count(*)", "lidar_pct") + ", count_if(pred IS NOT NULL AND lidar IS NOT NULL)::BIGINT AS both FROM dn", dn=_dense))
def coverage_stats(spark, d):
    return grids.dense(views.grid(spark, d), N, N).agg(rounded(100.0 * F.count("pred") / F.count(F.lit(1))).alias("pred_pct"), rounded(100.0 * F.count("lidar") / F.count(F.lit(1))).alias("lidar_pct"), F.count_if(c("pred").isNotNull() & c("lidar").isNotNull()).alias("both"))


@query(sql("SELECT count(pred) AS n, " + ", ".join(r6(e, k) for k, e in {"mean": "avg(pred)", "std": "stddev_samp(pred)", "min": "min(pred)", "p25": "quantile_cont(pred, 0.25)", "p50": "quantile_cont(pred, 0.5)", "p75": "quantile_cont(pred, 0.75)", "max": "max(pred)", "below10": "avg((pred < 10)::INTEGER)"}.items()) + " FROM grid WHERE pred IS NOT NULL"))
def distribution_summary(spark, d):
    q = lambda p: F.percentile("pred", F.lit(p))
    return views.grid(spark, d).where("pred IS NOT NULL").agg(F.count("pred").alias("n"), *[rounded(e).alias(k) for k, e in {"mean": F.avg("pred"), "std": F.stddev_samp("pred"), "min": F.min("pred"), "p25": q(0.25), "p50": q(0.5), "p75": q(0.75), "max": F.max("pred"), "below10": F.avg((c("pred") < 10).cast("int"))}.items()])


@query(sql("SELECT i::INTEGER AS i, " + r6("-b + i * 2 * b / 7", "edge") + " FROM (SELECT quantile_cont(abs(pred - lidar), 0.98) AS b FROM valid), (SELECT unnest(range(8)) AS i)"))
def plot_limits(spark, d):
    b = valid(spark, d).agg(F.percentile(F.abs(c("pred") - c("lidar")), F.lit(0.98)).alias("b"))
    return b.select("b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("i", rounded(-c("b") + c("i") * 2 * c("b") / 7).alias("edge"))


@query(sql("SELECT " + r6("lo - 0.05::DOUBLE * (hi - lo)", "low") + ", " + r6("hi + 0.05::DOUBLE * (hi - lo)", "high") + " FROM (SELECT least(min(pred), min(lidar)) AS lo, greatest(max(pred), max(lidar)) AS hi FROM grid)"))
def shared_axis_limits(spark, d):
    g = views.grid(spark, d)
    u = g.select(c("pred").alias("v")).union(g.select("lidar")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return u.select(rounded(c("lo") - 0.05 * (c("hi") - c("lo"))).alias("low"), rounded(c("hi") + 0.05 * (c("hi") - c("lo"))).alias("high"))


@query(sql("SELECT b AS bin, count(*) AS n, " + r6("count(*) / ((SELECT count(*) FROM inside) * w)", "density") + " FROM (SELECT least(floor((pred - lo) / w), 59)::INTEGER AS b, w FROM inside) GROUP BY b, w", lim="SELECT quantile_cont(pred, 0.005) AS lo, quantile_cont(pred, 0.995) AS hi FROM grid", inside="SELECT pred, lo, (hi - lo) / 60 AS w FROM grid, lim WHERE pred >= lo AND pred <= hi"))
def density_histogram(spark, d):
    g = views.grid(spark, d).where("pred IS NOT NULL")
    lim = g.agg(F.percentile("pred", F.lit(0.005)).alias("lo"), F.percentile("pred", F.lit(0.995)).alias("hi"))
    inside = g.join(F.broadcast(lim)).where("pred >= lo AND pred <= hi").withColumn("w", (c("hi") - c("lo")) / 60)
    per = inside.groupBy(F.least(F.floor((c("pred") - c("lo")) / c("w")), F.lit(59)).cast("int").alias("bin"), "w").agg(F.count(F.lit(1)).alias("n"))
    return per.select("bin", "n", rounded(c("n") / (F.sum("n").over(Window.partitionBy()) * c("w"))).alias("density"))


@query(sql("SELECT k, count(*) AS n, " + r6("avg(lidar)", "lidar_mean") + ", " + r6("avg(pred)", "pred_mean") + " FROM (SELECT *, CASE WHEN lidar = 0 THEN '0% canopy' WHEN lidar > 60 THEN '>60% canopy' END AS k FROM valid) WHERE k IS NOT NULL GROUP BY k"))
def class_shift_pivot(spark, d):
    k = F.when(c("lidar") == 0, "0% canopy").when(c("lidar") > 60, ">60% canopy")
    return valid(spark, d).withColumn("k", k).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("lidar")).alias("lidar_mean"), rounded(F.avg("pred")).alias("pred_mean"))


# ---- neighbourhoods ------------------------------------------------------------------------------------------------

_sq = lambda rad: f"SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range(-{rad}, {rad} + 1)) AS d) a, (SELECT unnest(range(-{rad}, {rad} + 1)) AS d) b"


@query(sql("SELECT g.y, g.x, " + r6("avg(h.pred)", "neighbour_mean") + ", count(h.pred) AS n_neighbours FROM grid g, off JOIN grid h ON h.y = g.y + dy AND h.x = g.x + dx WHERE (dy <> 0 OR dx <> 0) AND h.pred IS NOT NULL GROUP BY g.y, g.x", off=_sq(2)))
def neighbour_mean_5x5(spark, d):
    return grids.neighbour_mean(views.grid(spark, d), "pred").where("n_neighbours > 0").select("y", "x", *r("neighbour_mean"), "n_neighbours")


_sobel = " UNION ALL ".join(f"SELECT {a} AS dy, {b} AS dx, {w[0]} AS wx, {w[1]} AS wy" for (a, b), w in grids.SOBEL.items())


@query(sql("SELECT y, x, " + r6("0.5::DOUBLE * abs(gx) + 0.5::DOUBLE * abs(gy)", "gradient") + " FROM (SELECT h.y - dy AS y, h.x - dx AS x, sum(h.pred * wx) AS gx, sum(h.pred * wy) AS gy FROM off JOIN grid h ON true WHERE h.pred IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 8)", off=_sobel))
def sobel_gradient(spark, d):
    return grids.sobel(views.grid(spark, d), "pred").select("y", "x", *r("gradient"))


_cross = "SELECT * FROM (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)"
_er = lambda src: f"SELECT s.y - dy AS y, s.x - dx AS x FROM {src} s, cr GROUP BY 1, 2 HAVING count(*) = 5"
_di = lambda src: f"SELECT DISTINCT s.y - dy AS y, s.x - dx AS x FROM {src} s, cr WHERE s.y - dy BETWEEN 0 AND 99 AND s.x - dx BETWEEN 0 AND 99"


@query(sql("SELECT y, x, 'eroded' AS step FROM e2 UNION ALL SELECT y, x, 'dilated' FROM d2", cr=_cross, m="SELECT y, x FROM grid WHERE pred > 12", e1=_er("m"), e2=_er("e1"), d1=_di("e2"), d2=_di("d1")))
def erode_dilate(spark, d):
    e = grids.erode(views.grid(spark, d).where("pred > 12").select("y", "x"), 2)
    g = grids.dilate(e, N, N, 2)
    return e.withColumn("step", F.lit("eroded")).unionByName(g.withColumn("step", F.lit("dilated")))


@query(sql("SELECT count(*) AS n, count(d2.y) AS near, " + r6("avg((d2.y IS NOT NULL)::INTEGER)", "share") + " FROM m LEFT JOIN d2 ON m.y = d2.y AND m.x = d2.x", cr=_cross, m="SELECT y, x FROM grid WHERE pred > 20 AND pred < 25", h="SELECT y, x FROM grid WHERE pred > 60", d1=_di("h"), d2=_di("d1")))
def near_cluster_share(spark, d):
    g = views.grid(spark, d)
    near = grids.dilate(g.where("pred > 60").select("y", "x"), N, N, 2).withColumn("hit", F.lit(1))
    return g.where("pred > 20 AND pred < 25").select("y", "x").join(near, ["y", "x"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("near"), rounded(F.avg(c("hit").isNotNull().cast("int"))).alias("share"))


_lv = "SELECT y, x, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, pred / 80.0::DOUBLE)) * 7, 0)::INTEGER AS g FROM grid WHERE pred IS NOT NULL"
_win = "SELECT c.y, c.x, o.dy, o.dx, l.g FROM (SELECT y, x FROM lv) c, off o JOIN lv l ON l.y = least(greatest(c.y + o.dy, 0), 99) AND l.x = least(greatest(c.x + o.dx, 0), 99)"
_ang = "SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) t(angle, ay, ax)"
_pairs = "SELECT a.y, a.x, angle, a.g AS i, b.g AS j FROM full_win a, ang JOIN full_win b ON b.y = a.y AND b.x = a.x AND b.dy = a.dy + ay AND b.dx = a.dx + ax"
_TEX = {"contrast": "sum((i - j) * (i - j) * p)", "dissimilarity": "sum(abs(i - j) * p)", "homogeneity": "sum(p / (1 + (i - j) * (i - j)))", "energy": "sum(p * p)", "entropy": "-sum(p * log2(p))", "variance": "sum(i * i * p) - sum(i * p) * sum(i * p)"}


@query(sql("SELECT y, x, " + ", ".join(f"round(avg({k}), 9) + 0.0::DOUBLE AS {k}" for k in _TEX) + " FROM per GROUP BY y, x", off=_sq(1), lv=_lv, win=_win, ang=_ang, full_win="SELECT * FROM win WHERE (y, x) IN (SELECT (y, x) FROM win GROUP BY y, x HAVING count(*) = 9)", pairs=_pairs, sym="SELECT y, x, angle, i, j FROM pairs UNION ALL SELECT y, x, angle, j, i FROM pairs", prob="SELECT y, x, angle, i, j, count(*) / CASE WHEN angle % 2 = 0 THEN 12.0::DOUBLE ELSE 8.0::DOUBLE END AS p FROM sym GROUP BY y, x, angle, i, j", per="SELECT y, x, angle, " + ", ".join(f"{e} AS {k}" for k, e in _TEX.items()) + " FROM prob GROUP BY y, x, angle"))
def glcm_texture(spark, d):
    g = views.grid(spark, d).where("pred IS NOT NULL").select("y", "x", S.quantise(c("pred"), 0.0, 80.0, 8).alias("level"))
    t = grids.texture(g, "level", N, N)
    return t.select("y", "x", *[rounded(x, 9).alias(x) for x in t.columns[2:]])


@query(sql("SELECT ty AS y, tx AS x, count(*) AS n, count_if(y // 25 <> ty OR x // 25 <> tx)::BIGINT AS halo FROM grid, (SELECT unnest(range(4))::INTEGER AS ty), (SELECT unnest(range(4))::INTEGER AS tx) WHERE y >= ty * 25 - 1 AND y < ty * 25 + 26 AND x >= tx * 25 - 1 AND x < tx * 25 + 26 GROUP BY ty, tx"))
def halo_check(spark, d):
    near = lambda v: F.filter(F.array(F.expr(f"int(({v} - 1) div 25)"), F.expr(f"int({v} div 25)"), F.expr(f"int(({v} + 1) div 25)")), lambda t: t < 4)
    tiles = views.grid(spark, d).select("y", "x", F.explode(F.array_distinct(near("y"))).alias("ty")).select("y", "x", "ty", F.explode(F.array_distinct(near("x"))).alias("tx"))
    return tiles.groupBy(c("ty").alias("y_"), c("tx").alias("x_")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.expr("y div 25") != c("ty")) | (F.expr("x div 25") != c("tx"))).alias("halo")).select(c("y_").alias("y"), c("x_").alias("x"), "n", "halo")


# ---- spatial statistics --------------------------------------------------------------------------------------------

_nb = "SELECT dy, dx FROM (" + _sq(1) + ") WHERE dy <> 0 OR dx <> 0"
_co = "SELECT y // 5 AS y, x // 5 AS x, avg(pred - lidar) AS e FROM valid GROUP BY 1, 2 HAVING count(*) >= 18.75"
_lag = "SELECT a.y, a.x, a.e, avg(b.e) AS lag, count(*) AS n_neighbours FROM co a, nb JOIN co b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x, a.e"
_tot = "SELECT avg(e) AS mu, count(*) AS n, var_pop(e) * count(*) AS ss FROM lagged"
_moran = "SELECT y, x, n_neighbours, (n - 1) * (e - mu) * (lag - mu) / ss AS local_i, CASE WHEN e - mu > 0 AND lag - mu > 0 THEN 1 WHEN e - mu <= 0 AND lag - mu > 0 THEN 2 WHEN e - mu <= 0 AND lag - mu <= 0 THEN 3 ELSE 4 END AS quadrant FROM lagged, tot"
LISA = {"nb": _nb, "co": _co, "lagged": _lag, "tot": _tot}


def residual_blocks(spark, d):
    g = valid(spark, d).withColumn("e", c("pred") - c("lidar"))
    return grids.coarsen(g, 5, ["e"]).select("y", "x", "e")


@query(sql("SELECT a.y, a.x, b.y AS ny, b.x AS nx FROM co a, nb JOIN co b ON b.y = a.y + dy AND b.x = a.x + dx", nb=_nb, co=_co))
def distance_band_edges(spark, d):
    return spatialstats.edges(residual_blocks(spark, d), 1.5).select("y", "x", "ny", "nx")


@query(sql("SELECT y, x, n_neighbours, " + r6("local_i", "local_i") + ", quadrant FROM moran", **LISA, moran=_moran))
def local_moran(spark, d):
    return spatialstats.local_moran(residual_blocks(spark, d), "e").select("y", "x", "n_neighbours", *r("local_i"), "quadrant")


@query(sql("SELECT " + r6("sum((e - mu) * (lag - mu)) / sum((e - mu) * (e - mu))", "moran_i") + ", count(*) AS n FROM lagged, tot", **LISA))
def global_moran(spark, d):
    return spatialstats.global_moran(residual_blocks(spark, d), "e").select(*r("moran_i"), "n")


@query(sql("SELECT distance, count(*) AS n_pairs, " + r6("avg((a.e - mu) * (b.e - mu))", "covariance") + ", " + r6("avg((a.e - mu) * (b.e - mu)) / (SELECT var_pop(e) FROM co)", "autocorrelation") + " FROM co a, st JOIN co b ON b.y = a.y + p AND b.x = a.x + q, (SELECT avg(e) AS mu FROM co) GROUP BY distance", co=_co, st="SELECT * FROM (VALUES (1, 1, 0), (1, 0, 1), (2, 2, 0), (2, 0, 2), (4, 4, 0), (4, 0, 4)) t(distance, p, q)"))
def correlogram(spark, d):
    return spatialstats.correlogram(residual_blocks(spark, d), "e", [1, 2, 4]).select("distance", "n_pairs", *r("covariance", "autocorrelation"))


@query(sql("SELECT g.y, g.x, " + r6("g.pred", "a") + ", " + r6("h.pred", "b") + " FROM (SELECT *, ('0x' || substr(md5(y || '_' || x || '_7'), 1, 8))::BIGINT AS h FROM grid WHERE pred IS NOT NULL) g JOIN grid h ON h.y = g.y + g.h % 7 - 3 AND h.x = g.x + (g.h // 7) % 7 - 3 WHERE h.pred IS NOT NULL"))
def random_pair_lag(spark, d):
    g = views.grid(spark, d).where("pred IS NOT NULL").select("y", "x", c("pred").alias("a"))
    h = S.hash_int("y", "x", 7)
    moved = g.select("y", "x", "a", (c("y") + (h % 7).cast("int") - 3).alias("ny"), (c("x") + (F.floor(h / 7) % 7).cast("int") - 3).alias("nx"))
    return moved.join(g.select(c("y").alias("ny"), c("x").alias("nx"), c("a").alias("b")), ["ny", "nx"]).select("y", "x", *r("a", "b"))


@query(sql("SELECT quadrant, count(*) AS n, " + r6("avg(local_i)", "mean_i") + ", " + r6("count(*) / sum(count(*)) OVER ()", "share") + " FROM moran GROUP BY quadrant", **LISA, moran=_moran))
def cluster_summary(spark, d):
    per = spatialstats.local_moran(residual_blocks(spark, d), "e").groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.avg("local_i").alias("mean_i"))
    return per.select("quadrant", "n", *r("mean_i"), rounded(c("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query(sql("SELECT a.y::INTEGER AS y, b.x::INTEGER AS x, coalesce(quadrant, 255)::INTEGER AS value FROM (SELECT unnest(range(20)) AS y) a, (SELECT unnest(range(20)) AS x) b LEFT JOIN moran m ON m.y = a.y AND m.x = b.x", **LISA, moran=_moran))
def cells_to_raster(spark, d):
    m = spatialstats.local_moran(residual_blocks(spark, d), "e").select("y", "x", "quadrant")
    return grids.dense(m, 20, 20).select("y", "x", F.coalesce("quadrant", F.lit(255)).alias("value"))


@query(sql("SELECT y, x, quadrant, " + r6("local_i", "local_i") + ", CASE WHEN abs(local_i) > 0.5 THEN quadrant ELSE 0 END AS cluster FROM moran WHERE n_neighbours >= 3", nb=_nb, co=_co.replace("avg(pred - lidar)", "avg(e)").replace("FROM valid", "FROM adj"), lagged=_lag, tot=_tot, moran=_moran, adj="SELECT y, x, e - avg(e) OVER (PARTITION BY bin) AS e FROM (SELECT y, x, pred - lidar AS e, " + _cbin + " AS bin FROM valid)"))
def hotspot_pipeline(spark, d):
    v = valid(spark, d).withColumns({"e": c("pred") - c("lidar"), "bin": S.canopy_bin(c("lidar"))})
    per = v.groupBy("bin").agg(F.avg("e").alias("m"))
    adj = v.join(F.broadcast(per), "bin").withColumn("e", c("e") - c("m"))
    m = spatialstats.local_moran(grids.coarsen(adj, 5, ["e"]), "e").where("n_neighbours >= 3")
    return m.select("y", "x", "quadrant", *r("local_i"), F.when(F.abs("local_i") > 0.5, c("quadrant")).otherwise(0).alias("cluster"))


# ---- scalars -------------------------------------------------------------------------------------------------------


@query(sql("SELECT y, x, (y // 10) || '_' || (x // 10) AS block_id, ((y // 10) * 11 + x // 10)::INTEGER AS block_key, (y * 100 + x)::INTEGER AS flat, 580000 + (x + 0.5::DOUBLE) * 10 AS east, 4520000 - (y + 0.5::DOUBLE) * 10 AS north, (580000 + x * 10 < 580500 AND 580000 + (x + 1) * 10 > 580200)::BOOLEAN AS in_tile FROM grid"))
def cell_keys_and_labels(spark, d):
    return views.grid(spark, d).select("y", "x", F.concat_ws("_", F.expr("y div 10"), F.expr("x div 10")).alias("block_id"), F.expr("int((y div 10) * 11 + x div 10)").alias("block_key"), (c("y") * 100 + c("x")).alias("flat"), (580000 + (c("x") + 0.5) * 10).alias("east"), (4520000 - (c("y") + 0.5) * 10).alias("north"), ((580000 + c("x") * 10 < 580500) & (580000 + (c("x") + 1) * 10 > 580200)).alias("in_tile"))


@query(sql("SELECT y, x, " + r6("CASE WHEN height - 5 < 0 THEN 0 ELSE height - 5 END * 3.28084::DOUBLE", "feet") + ", (lidar > 0)::INTEGER AS canopy_binary, lidar IS NOT NULL AND pred IS NOT NULL AS complete, " + r6("CASE WHEN (SELECT max(pred) FROM grid) <= 1 THEN pred * 100 ELSE pred END", "pct") + " FROM grid"))
def unit_and_validity(spark, d):
    g = views.grid(spark, d)
    top = g.agg(F.max("pred").alias("top"))
    h = c("height") - 5
    return g.join(F.broadcast(top)).select("y", "x", rounded(F.when(h < 0, 0.0).otherwise(h) * FEET_PER_METRE).alias("feet"), (c("lidar") > 0).cast("int").alias("canopy_binary"), (c("lidar").isNotNull() & c("pred").isNotNull()).alias("complete"), rounded(F.when(c("top") <= 1, c("pred") * 100).otherwise(c("pred"))).alias("pct"))


@query(sql("SELECT y, x, least(floor(lidar / 10), 9)::INTEGER AS floor_bin, CASE WHEN ratio > 0.6 THEN 7 WHEN ratio > 0.5 THEN 7 WHEN ratio > 0.4 THEN 6 WHEN ratio > 0.3 THEN 5 WHEN ratio > 0.2 THEN 4 WHEN ratio > 0.15 THEN 3 WHEN ratio > 0.1 THEN 2 WHEN ratio > 0.01 THEN 1 ELSE 0 END::INTEGER AS right_bin FROM (SELECT *, CASE WHEN lidar + other > 0 THEN other / (lidar + other) END AS ratio FROM grid WHERE lidar IS NOT NULL) WHERE ratio <= 0.6"))
def fixed_edge_bins(spark, d):
    ratio = F.when(c("lidar") + c("other") > 0, c("other") / (c("lidar") + c("other")))
    g = views.grid(spark, d).where("lidar IS NOT NULL").withColumn("ratio", ratio).where("ratio <= 0.6D")
    return g.select("y", "x", S.floor_bin(c("lidar"), 10.0, 9).alias("floor_bin"), S.bin_right_closed(c("ratio"), [0.0, 0.01, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.60], 7).alias("right_bin"))


@query(sql("SELECT y, x, a || b AS step, " + r6("a * 25.0::DOUBLE", "lo") + " FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT y, x FROM grid)"))
def window_cross_join(spark, d):
    r4 = lambda n: spark.range(4).select(c("id").alias(n))
    g = views.grid(spark, d).select("y", "x")
    return g.crossJoin(r4("a").crossJoin(r4("b"))).select("y", "x", F.concat(c("a").cast("string"), c("b").cast("string")).alias("step"), rounded(c("a") * 25.0).alias("lo"))


@query(sql("SELECT y, x, " + r6("gr_lidar", "lidar") + ", label FROM (SELECT g.y, g.x, g.lidar AS gr_lidar, (b.h % 3)::INTEGER AS label FROM grid g JOIN (SELECT DISTINCT y // 10 AS br, x // 10 AS bc, ('0x' || substr(md5((y // 10) || '_' || (x // 10) || '_1'), 1, 8))::BIGINT AS h FROM grid) b ON g.y // 10 = br AND g.x // 10 = bc WHERE g.lidar IS NOT NULL)"))
def block_broadcast_join(spark, d):
    g = views.grid(spark, d).withColumns({"br": grids.block("y", 10), "bc": grids.block("x", 10)})
    blocks = g.select("br", "bc").distinct().withColumn("label", (S.hash_int("br", "bc", 1) % 3).cast("int"))
    return g.where("lidar IS NOT NULL").join(blocks, ["br", "bc"]).select("y", "x", *r("lidar"), "label")


@query(sql("SELECT g.y, g.x, " + r6("g.pred", "pred") + ", " + r6("b.p", "coarse") + " FROM valid g JOIN (SELECT y // 4 AS k1, x // 4 AS k2, avg(pred) AS p FROM valid GROUP BY 1, 2) b ON g.y // 4 = k1 AND g.x // 4 = k2"))
def cell_attribute_joins(spark, d):
    v = valid(spark, d).withColumns({"by": grids.block("y", 4), "bx": grids.block("x", 4)})
    coarse = v.groupBy("by", "bx").agg(F.avg("pred").alias("coarse"))
    return v.join(coarse, ["by", "bx"]).select("y", "x", *r("pred", "coarse"))


# ---- zones ---------------------------------------------------------------------------------------------------------

_zj = "zone_cells z JOIN grid g ON z.y = g.y AND z.x = g.x"


def zones(spark, d):
    return views.zone_cells(spark, d).join(views.grid(spark, d), ["y", "x"])


@query(sql("SELECT zone_id, zone_name, count(*) AS n, " + r6("sum(pred * coverage) / sum(coverage)", "mean") + f" FROM {_zj} WHERE coverage >= 0.5 AND pred IS NOT NULL GROUP BY zone_id, zone_name"))
def zonal_mean(spark, d):
    z = zones(spark, d).where("coverage >= 0.5D AND pred IS NOT NULL")
    return z.groupBy("zone_id", "zone_name").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(c("pred") * c("coverage")) / F.sum("coverage")).alias("mean"))


@query(sql(f"SELECT zone_id, code FROM (SELECT zone_id, code, row_number() OVER (PARTITION BY zone_id ORDER BY sum(coverage) DESC, code) AS k FROM {_zj} GROUP BY zone_id, code) WHERE k = 1"))
def zonal_mode(spark, d):
    per = zones(spark, d).groupBy("zone_id", "code").agg(F.sum("coverage").alias("w"))
    return per.groupBy("zone_id").agg(F.min(F.struct((-c("w")).alias("w"), "code")).alias("b")).select("zone_id", c("b.code").alias("code"))


@query(sql("SELECT coalesce(borough, 'city') AS area, count(*) AS n, " + r6("sum(pred * coverage) / sum(coverage)", "mean") + f" FROM {_zj} WHERE pred IS NOT NULL GROUP BY ROLLUP (borough)"))
def borough_city_rollup(spark, d):
    z = zones(spark, d).where("pred IS NOT NULL")
    return z.rollup("borough").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(c("pred") * c("coverage")) / F.sum("coverage")).alias("mean")).select(F.coalesce("borough", F.lit("city")).alias("area"), "n", "mean")


_zc = f"SELECT zone_id, sum((pred - other) * coverage) / sum(coverage) AS dp, sum((lidar - other) * coverage) / sum(coverage) AS dl, count(pred) / count(*) AS cov FROM {_zj} GROUP BY zone_id"


@query(sql("SELECT count(*) AS n, count_if(sign(dp) = sign(dl))::BIGINT AS right_direction, " + r6("median(dp)", "median_pred") + ", " + r6("median(dl)", "median_lidar") + ", " + r6("sqrt(avg((dp - dl) * (dp - dl)))", "rmse") + ", " + r6("max(abs(dp))", "largest") + " FROM zc WHERE cov >= 0.8", zc=_zc))
def zone_change(spark, d):
    w = c("coverage")
    part = lambda v: F.sum((c(v) - c("other")) * w) / F.sum(w)
    z = zones(spark, d).groupBy("zone_id").agg(part("pred").alias("dp"), part("lidar").alias("dl"), (F.count("pred") / F.count(F.lit(1))).alias("cov")).where("cov >= 0.8D")
    return z.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("dp") == F.signum("dl")).alias("right_direction"), rounded(F.median("dp")).alias("median_pred"), rounded(F.median("dl")).alias("median_lidar"), rounded(F.sqrt(F.avg((c("dp") - c("dl")) * (c("dp") - c("dl"))))).alias("rmse"), rounded(F.max(F.abs("dp"))).alias("largest"))


@query(sql("SELECT code, feature_set, count(*) AS n, " + r6("avg(lidar)", "mean") + ", count(DISTINCT block_id) AS n_blocks, " + r6("avg((pred = 0)::INTEGER)", "share_zero") + " FROM (SELECT v.*, (y // 10) || '_' || (x // 10) AS block_id, CASE WHEN abs(pred - lidar) < 10 THEN 'stable' ELSE 'changed' END AS feature_set FROM valid v) GROUP BY code, feature_set"))
def stable_pixel_summary(spark, d):
    v = valid(spark, d).withColumns({"block_id": F.concat_ws("_", F.expr("y div 10"), F.expr("x div 10")), "feature_set": F.when(F.abs(c("pred") - c("lidar")) < 10, "stable").otherwise("changed")})
    return v.groupBy("code", "feature_set").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("lidar")).alias("mean"), F.countDistinct("block_id").alias("n_blocks"), rounded(F.avg((c("pred") == 0).cast("int"))).alias("share_zero"))


@query(sql("SELECT code, least(floor(other / 20), 4)::INTEGER AS bin, count(*) AS n, " + r6("median(pred - lidar)", "median") + " FROM valid WHERE code <> 0 GROUP BY 1, 2"))
def landcover_confusion(spark, d):
    return valid(spark, d).where("code <> 0").groupBy("code", S.floor_bin(c("other"), 20.0, 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.median(c("pred") - c("lidar"))).alias("median"))


@query(sql("SELECT gradient, bin, count(*) AS n, " + r6("avg(e)", "bias") + " FROM (SELECT 'A' AS gradient, least(floor(height / 4), 4)::INTEGER AS bin, pred - lidar AS e FROM valid WHERE lidar < 20 UNION ALL SELECT 'B', least(floor(height / 4), 4)::INTEGER, pred - lidar FROM valid WHERE other < 20) GROUP BY gradient, bin"))
def gradient_ab_bins(spark, d):
    v = valid(spark, d)
    part = lambda name, cond: v.where(cond).select(F.lit(name).alias("gradient"), S.floor_bin(c("height"), 4.0, 4).alias("bin"), (c("pred") - c("lidar")).alias("e"))
    return part("A", "lidar < 20").union(part("B", "other < 20")).groupBy("gradient", "bin").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("e")).alias("bias"))
