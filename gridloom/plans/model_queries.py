"""Queries on splits, scores, bootstraps and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import semantics as S
from ..functions.semantics import rounded
from ..operators import grids, inference, learning, registration, sampling, spatialstats
from ..sources import archive, views
from .registry import query
from .relations import r6, sql

c = F.col
REPS = 1000
FOLDS = 5


def r(*cols):
    return [rounded(x).alias(x) for x in cols]


def h(*parts: str) -> str:
    """The DuckDB form of semantics.hash_int."""
    return "('0x' || substr(md5(" + " || '_' || ".join(parts) + "), 1, 8))::BIGINT"


# ---- splits and samples --------------------------------------------------------------------------------------------

USABLE = "SELECT y // 10 AS block_row, x // 10 AS block_col, count(lidar) AS n_valid FROM grid WHERE y < 100 AND x < 100 GROUP BY 1, 2 HAVING count(lidar) >= 10"


def usable(spark, d):
    return sampling.usable_blocks(views.grid(spark, d), "lidar", 10, 100, 100)


@query(sql("SELECT block_row, block_col, n_valid FROM us", us=USABLE))
def block_usable(spark, d):
    return usable(spark, d)


@query(sql("SELECT block_row, block_col, (row_number() OVER (ORDER BY " + h("block_row", "block_col", "'42'") + ", block_row, block_col) <= greatest(1, round_even((SELECT count(*) FROM us) * 0.3, 0)))::INTEGER AS label FROM us", us=USABLE))
def train_test_split(spark, d):
    return sampling.split_blocks(usable(spark, d))


@query(sql("SELECT block_row, block_col, ((row_number() OVER (ORDER BY " + h("block_row", "block_col", "'42'") + ", block_row, block_col) - 1) % 5)::INTEGER AS fold FROM us", us=USABLE))
def fold_assign(spark, d):
    return sampling.fold_blocks(usable(spark, d))


@query(sql("SELECT y, x, block_row, block_col, " + r6("lidar", "lidar") + " FROM (SELECT *, y // 10 AS block_row, x // 10 AS block_col, row_number() OVER (PARTITION BY y // 10, x // 10 ORDER BY " + h("y", "x", "'42'") + ", y, x) AS k FROM grid WHERE lidar IS NOT NULL) WHERE k <= 20"))
def block_sample(spark, d):
    return sampling.sample_per_block(views.grid(spark, d), "lidar", 10, 20).select("y", "x", "block_row", "block_col", *r("lidar"))


@query(sql("SELECT y, x, block_row, block_col, bin FROM (SELECT *, row_number() OVER (PARTITION BY block_row, block_col ORDER BY extra, hh, y, x) AS k FROM (SELECT *, (row_number() OVER (PARTITION BY block_row, block_col, bin ORDER BY hh, y, x) > 2)::INTEGER AS extra FROM (SELECT y, x, y // 10 AS block_row, x // 10 AS block_col, least(floor(lidar / 10), 9)::INTEGER AS bin, " + h("y", "x", "'42'") + " AS hh FROM grid WHERE lidar IS NOT NULL))) WHERE k <= 25"))
def stratified_block_sample(spark, d):
    out = sampling.stratified_sample(views.grid(spark, d), "lidar", 10, 25, S.floor_bin(c("lidar"), 10.0, 9), 11)
    return out.select("y", "x", "block_row", "block_col", "bin")


# ---- scores --------------------------------------------------------------------------------------------------------


@query(sql("SELECT feature_set, thr, count(*) AS n, " + r6("avg((sign(y_pred - 40) = sign(lidar - 40))::INTEGER)", "correct") + " FROM preds, (SELECT unnest(range(0, 60, 5)) AS thr) WHERE abs(y_pred - 40) > thr GROUP BY feature_set, thr HAVING count(*) >= 10"))
def threshold_sweep(spark, d):
    p = views.predictions(spark, d).withColumn("thr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(55).cast("long"), F.lit(5).cast("long")))).where(F.abs(c("y_pred") - 40) > c("thr"))
    return p.groupBy("feature_set", "thr").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg((F.signum(c("y_pred") - 40) == F.signum(c("lidar") - 40)).cast("int"))).alias("correct")).where("n >= 10")


_pr = "SELECT feature_set, y_pred, sum(sum(y_true)) OVER w AS tp, sum(count(*)) OVER w AS k, sum(sum(y_true)) OVER (PARTITION BY feature_set) AS pos FROM preds GROUP BY feature_set, y_pred WINDOW w AS (PARTITION BY feature_set ORDER BY y_pred DESC)"


@query(sql("SELECT feature_set, " + r6("max(y_pred)", "threshold") + " FROM pr WHERE tp / pos >= 0.93::DOUBLE GROUP BY feature_set", pr=_pr))
def recall_threshold(spark, d):
    per = views.predictions(spark, d).groupBy("feature_set", "y_pred").agg(F.sum("y_true").alias("t"), F.count(F.lit(1)).alias("m"))
    down = Window.partitionBy("feature_set").orderBy(F.desc("y_pred")).rowsBetween(Window.unboundedPreceding, 0)
    pr = per.withColumns({"tp": F.sum("t").over(down), "pos": F.sum("t").over(Window.partitionBy("feature_set"))})
    return pr.where("tp / pos >= 0.93D").groupBy("feature_set").agg(rounded(F.max("y_pred")).alias("threshold"))


@query(sql("SELECT feature_set, y_true AS class, count(*) AS support, " + r6("avg(((y_pred > 40)::INTEGER = y_true)::INTEGER)", "recall") + ", " + r6("count_if((y_pred > 40)::INTEGER = y_true) / max(predicted)", "precision") + " FROM (SELECT *, count(*) FILTER (true) OVER (PARTITION BY feature_set, (y_pred > 40)::INTEGER) AS np FROM preds) JOIN (SELECT feature_set, (y_pred > 40)::INTEGER AS y_true, count(*) AS predicted FROM preds GROUP BY 1, 2) USING (feature_set, y_true) GROUP BY feature_set, y_true"))
def classification_report(spark, d):
    per = views.predictions(spark, d).groupBy("feature_set", "y_true", (c("y_pred") > 40).cast("int").alias("said")).agg(F.count(F.lit(1)).alias("n"))
    support = F.sum("n").over(Window.partitionBy("feature_set", "y_true"))
    said = F.sum("n").over(Window.partitionBy("feature_set", "said"))
    both = per.withColumns({"support": support, "predicted": said}).where("said = y_true")
    return both.select("feature_set", c("y_true").alias("class"), "support", rounded(c("n") / c("support")).alias("recall"), rounded(c("n") / c("predicted")).alias("precision"))


W = "1 + (y + x) % 3"


@query(sql("SELECT feature_set, " + r6("sum(wp * (below + 0.5 * wn)) / (sum(wp) * sum(wn))", "auc") + " FROM (SELECT *, coalesce(sum(wn) OVER (PARTITION BY feature_set ORDER BY y_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM (SELECT feature_set, y_pred, sum(CASE WHEN y_true = 1 THEN 1 + (y + x) % 3 ELSE 0 END)::DOUBLE AS wp, sum(CASE WHEN y_true = 0 THEN 1 + (y + x) % 3 ELSE 0 END)::DOUBLE AS wn FROM preds GROUP BY 1, 2)) GROUP BY feature_set"))
def weighted_auc(spark, d):
    p = views.predictions(spark, d).withColumn("w", F.expr(W))
    return metrics.weighted_auc(p, ["feature_set"], "y_true", "y_pred", "w").select("feature_set", *r("auc"))


@query(sql("SELECT feature_set, " + r6("sqrt(sum(w * (y_pred - lidar) * (y_pred - lidar)) / sum(w))", "rmse") + ", " + r6("1 - sum(w * (lidar - y_pred) * (lidar - y_pred)) / (sum(w * lidar * lidar) - sum(w * lidar) * sum(w * lidar) / sum(w))", "r2") + f" FROM (SELECT *, {W} AS w FROM preds) GROUP BY feature_set"))
def weighted_r2_rmse(spark, d):
    p = views.predictions(spark, d).withColumn("w", F.expr(W))
    return p.groupBy("feature_set").agg(rounded(metrics.weighted_rmse(c("y_pred"), c("lidar"), c("w"))).alias("rmse"), rounded(metrics.weighted_r2(c("y_pred"), c("lidar"), c("w"))).alias("r2"))


# ---- bootstrap -----------------------------------------------------------------------------------------------------

_pb = "SELECT feature_set, block_id, count(*) AS n, sum((y_pred - lidar) * (y_pred - lidar)) AS sse FROM preds GROUP BY 1, 2"
_sc = "SELECT rep, feature_set, sqrt(sum(w * sse) / sum(w * n)) AS score FROM draws JOIN pb USING (block_id) GROUP BY 1, 2"


def draws(p, seed=42):
    blocks = inference.numbered_blocks(p)
    return inference.block_draws(blocks, blocks.count(), REPS, seed)


def boot_scores(spark, d):
    p = views.predictions(spark, d)
    per = p.groupBy("feature_set", "block_id").agg(F.count(F.lit(1)).alias("n"), F.sum((c("y_pred") - c("lidar")) * (c("y_pred") - c("lidar"))).alias("sse"))
    return draws(p).join(per, "block_id").groupBy("rep", "feature_set").agg(F.sqrt(F.sum(c("w") * c("sse")) / F.sum(c("w") * c("n"))).alias("score"))


@query(sql("SELECT feature_set, " + r6("avg(score)", "mean") + ", " + r6("quantile_cont(score, 0.025)", "ci_low") + ", " + r6("quantile_cont(score, 0.975)", "ci_high") + ", any_value(point) AS point FROM sc JOIN (SELECT feature_set, " + r6("sqrt(avg((y_pred - lidar) * (y_pred - lidar)))", "point") + " FROM preds GROUP BY 1) USING (feature_set) GROUP BY feature_set", pb=_pb, sc=_sc))
def block_bootstrap_ci(spark, d):
    point = views.predictions(spark, d).groupBy("feature_set").agg(rounded(metrics.rmse(c("y_pred"), c("lidar"))).alias("point"))
    ci = boot_scores(spark, d).groupBy("feature_set").agg(F.avg("score").alias("mean"), *inference.interval("score", []))
    return ci.join(F.broadcast(point), "feature_set").select("feature_set", *r("mean", "ci_low", "ci_high"), "point")


_points = "SELECT feature_set, sqrt(sum(sse) / sum(n)) AS score FROM pb GROUP BY 1"


@query(sql("SELECT feature_set, " + r6("(SELECT a.score - b.score FROM pts a, pts b WHERE a.feature_set = t.feature_set AND b.feature_set = 'all_vars')", "diff") + ", " + r6("quantile_cont(dd, 0.025)", "ci_low") + ", " + r6("quantile_cont(dd, 0.975)", "ci_high") + ", " + r6("avg((-1 * dd <= 0)::INTEGER)", "p_not_better") + ", quantile_cont(dd, 0.025) > 0 OR quantile_cont(dd, 0.975) < 0 AS ci_excludes_zero FROM (SELECT s.feature_set, s.score - b.score AS dd FROM sc s JOIN sc b ON s.rep = b.rep AND b.feature_set = 'all_vars' WHERE s.feature_set <> 'all_vars') t GROUP BY feature_set", pb=_pb, sc=_sc, pts=_points))
def paired_differences(spark, d):
    points = views.predictions(spark, d).groupBy("feature_set").agg(metrics.rmse(c("y_pred"), c("lidar")).alias("score"))
    out = inference.paired_differences(boot_scores(spark, d), points, "all_vars", -1)
    return out.select("feature_set", *r("diff", "ci_low", "ci_high", "p_not_better"), ((c("ci_low") > 0) | (c("ci_high") < 0)).alias("ci_excludes_zero"))


@query(sql("SELECT " + r6("avg(gap)", "gap") + ", " + r6("quantile_cont(gap, 0.025)", "ci_low") + ", " + r6("quantile_cont(gap, 0.975)", "ci_high") + " FROM (SELECT a.rep, b.score - a.score AS gap FROM sc a JOIN sc b ON a.rep = b.rep AND a.feature_set = 'all_vars' AND b.feature_set = 'deltas_only')", pb=_pb, sc=_sc))
def transfer_gap(spark, d):
    s = boot_scores(spark, d).groupBy("rep").agg((F.max(F.when(c("feature_set") == "deltas_only", c("score"))) - F.max(F.when(c("feature_set") == "all_vars", c("score")))).alias("gap"))
    return s.agg(rounded(F.avg("gap")).alias("gap"), *[rounded(x).alias(n) for n, x in zip(("ci_low", "ci_high"), inference.interval("gap", []))])


_bb = "SELECT block_id, least(floor(lidar / 20), 4)::INTEGER AS bin, sum(y_pred - lidar) AS s, count(*) AS n FROM preds WHERE feature_set = 'all_vars' GROUP BY 1, 2"


@query(sql("SELECT bin, " + r6("quantile_cont(m, 0.025)", "ci_low") + ", " + r6("quantile_cont(m, 0.975)", "ci_high") + ", any_value(n)::BIGINT AS n, any_value(nb) AS n_blocks FROM (SELECT rep, bin, sum(w * s) / sum(w * n) AS m FROM draws JOIN bb USING (block_id) GROUP BY 1, 2) JOIN (SELECT bin, sum(n) AS n, count(*) AS nb FROM bb GROUP BY bin) USING (bin) GROUP BY bin", bb=_bb))
def binned_block_bootstrap(spark, d):
    p = views.predictions(spark, d)
    per = p.where("feature_set = 'all_vars'").groupBy("block_id", S.floor_bin(c("lidar"), 20.0, 4).alias("bin")).agg(F.sum(c("y_pred") - c("lidar")).alias("s"), F.count(F.lit(1)).alias("n"))
    means = draws(p).join(per, "block_id").groupBy("rep", "bin").agg((F.sum(c("w") * c("s")) / F.sum(c("w") * c("n"))).alias("m"))
    size = per.groupBy("bin").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_blocks"))
    return means.groupBy("bin").agg(*inference.interval("m", [])).join(F.broadcast(size), "bin").select("bin", *r("ci_low", "ci_high"), "n", "n_blocks")


_med = "SELECT rep, median(e) AS m FROM (SELECT rep, y_pred - lidar AS e, unnest(range(w)) AS t FROM draws JOIN preds USING (block_id) WHERE feature_set = 'all_vars') GROUP BY rep"


@query(sql("SELECT " + r6("median(m)", "median") + ", " + r6("quantile_cont(m, 0.025)", "ci_low") + ", " + r6("quantile_cont(m, 0.975)", "ci_high") + " FROM md", md=_med))
def block_bootstrap_median(spark, d):
    p = views.predictions(spark, d)
    e = p.where("feature_set = 'all_vars'").select("block_id", (c("y_pred") - c("lidar")).alias("e"))
    # the frequency argument stands for w copies of a row
    per = draws(p).join(e, "block_id").groupBy("rep").agg(F.expr("percentile(e, 0.5D, w)").alias("m"))
    return per.agg(rounded(F.median("m")).alias("median"), *[rounded(x).alias(n) for n, x in zip(("ci_low", "ci_high"), inference.interval("m", []))])


_mc = "SELECT block_id, least(floor(lidar / 10), 9)::INTEGER AS bin, CASE WHEN y_pred > 45 THEN 1 ELSE 0 END AS grp, count(*) AS n, sum((y % 2 = 0)::INTEGER * 1.0::DOUBLE + x * 0.01::DOUBLE) AS s FROM preds WHERE feature_set = 'all_vars' GROUP BY 1, 2, 3"
_cmp = lambda src, extra: f"SELECT {extra}sum(cs) / sum(cn) AS cm, sum(rs / rn * cn) / sum(cn) AS rm FROM (SELECT {extra}bin, sum(CASE WHEN grp = 1 THEN wn END) AS cn, sum(CASE WHEN grp = 1 THEN ws END) AS cs, sum(CASE WHEN grp = 0 THEN wn END) AS rn, sum(CASE WHEN grp = 0 THEN ws END) AS rs FROM {src} GROUP BY ALL) WHERE cn > 0 AND rn > 0" + (" GROUP BY rep" if extra else "")


@query(sql("SELECT " + r6("(SELECT cm FROM pt)", "cluster_mean") + ", " + r6("(SELECT rm FROM pt)", "reference_mean") + ", " + r6("(SELECT cm - rm FROM pt)", "diff") + ", " + r6("quantile_cont(cm - rm, 0.025)", "ci_low") + ", " + r6("quantile_cont(cm - rm, 0.975)", "ci_high") + " FROM bt", mc=_mc, one="SELECT *, n AS wn, s AS ws FROM mc", pt=_cmp("one", ""), rp="SELECT rep, bin, grp, w * n AS wn, w * s AS ws FROM draws JOIN mc USING (block_id)", bt=_cmp("rp", "rep, ")))
def matched_cluster_compare(spark, d):
    p = views.predictions(spark, d).where("feature_set = 'all_vars'")
    v = (c("y") % 2 == 0).cast("int") * 1.0 + c("x") * 0.01
    per = p.groupBy("block_id", S.floor_bin(c("lidar"), 10.0, 9).alias("bin"), (c("y_pred") > 45).cast("int").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"))

    def compare(df, by):
        side = lambda g, x: F.sum(F.when(c("grp") == g, c(x)))
        bins = df.groupBy(*by, "bin").agg(side(1, "wn").alias("cn"), side(1, "ws").alias("cs"), side(0, "wn").alias("rn"), side(0, "ws").alias("rs")).where("cn > 0 AND rn > 0")
        return bins.groupBy(*by).agg((F.sum("cs") / F.sum("cn")).alias("cm"), (F.sum(c("rs") / c("rn") * c("cn")) / F.sum("cn")).alias("rm"))

    point = compare(per.withColumns({"wn": c("n"), "ws": c("s")}), []).select(rounded("cm").alias("cluster_mean"), rounded("rm").alias("reference_mean"), rounded(c("cm") - c("rm")).alias("diff"))
    boot = compare(draws(views.predictions(spark, d)).join(per, "block_id").withColumns({"wn": c("w") * c("n"), "ws": c("w") * c("s")}), ["rep"]).withColumn("dd", c("cm") - c("rm"))
    return point.join(boot.agg(*[rounded(x).alias(n) for n, x in zip(("ci_low", "ci_high"), inference.interval("dd", []))]))


_p = "SELECT y, x, exp(-abs(pred - lidar)) AS p FROM valid"


@query(sql("SELECT y, x, " + r6("p", "p") + ", coalesce(p <= (SELECT max(p) FROM (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM pv) WHERE p * n / k <= 0.05), false) AS significant FROM pv", pv=_p))
def bh_fdr(spark, d):
    p = views.grid(spark, d).where("lidar IS NOT NULL AND pred IS NOT NULL").select("y", "x", F.exp(-F.abs(c("pred") - c("lidar"))).alias("p"))
    return inference.benjamini_hochberg(p, "p").select("y", "x", *r("p"), "significant")


# ---- tables over feature sets --------------------------------------------------------------------------------------

_auc1 = "SELECT feature_set, year, sum(wp * (below + 0.5 * wn)) / (sum(wp) * sum(wn)) AS auc FROM (SELECT *, coalesce(sum(wn) OVER (PARTITION BY feature_set, year ORDER BY y_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM (SELECT feature_set, y % 2 AS year, y_pred, sum(y_true)::DOUBLE AS wp, sum(1 - y_true)::DOUBLE AS wn FROM preds GROUP BY 1, 2, 3)) GROUP BY feature_set, year"
_rr = "SELECT feature_set, y % 2 AS year, sqrt(avg((y_pred - lidar) * (y_pred - lidar))) AS rmse, 1 - sum((lidar - y_pred) * (lidar - y_pred)) / (count(*) * var_pop(lidar)) AS r2 FROM preds GROUP BY 1, 2"


def set_scores(spark, d):
    p = views.predictions(spark, d).withColumns({"year": c("y") % 2, "w": F.lit(1)})
    auc = metrics.weighted_auc(p, ["feature_set", "year"], "y_true", "y_pred", "w")
    fit = p.groupBy("feature_set", "year").agg(metrics.rmse(c("y_pred"), c("lidar")).alias("rmse"), metrics.r2(c("y_pred"), c("lidar")).alias("r2"))
    return auc.join(fit, ["feature_set", "year"])


@query(sql("SELECT a.feature_set, a.year, " + r6("auc", "auc") + ", " + r6("rmse", "rmse") + ", " + r6("r2", "r2") + " FROM au a JOIN rr USING (feature_set, year)", au=_auc1, rr=_rr))
def evaluate_all_sets(spark, d):
    return set_scores(spark, d).select("feature_set", "year", *r("auc", "rmse", "r2"))


@query(sql("SELECT feature_set, " + r6("max(CASE WHEN year = 1 THEN auc END) - max(CASE WHEN year = 0 THEN auc END)", "auc_drop") + ", " + r6("max(CASE WHEN year = 1 THEN r2 END) - max(CASE WHEN year = 0 THEN r2 END)", "r2_drop") + " FROM au JOIN rr USING (feature_set, year) GROUP BY feature_set", au=_auc1, rr=_rr))
def same_cross_drop(spark, d):
    of = lambda k, m: F.max(F.when(c("year") == k, c(m)))
    return set_scores(spark, d).groupBy("feature_set").agg(rounded(of(1, "auc") - of(0, "auc")).alias("auc_drop"), rounded(of(1, "r2") - of(0, "r2")).alias("r2_drop"))


@query(sql("SELECT metric, feature_set, year, " + r6("v", "score") + " FROM (SELECT 'auc' AS metric, feature_set, year, auc AS v FROM au UNION ALL SELECT 'rmse', feature_set, year, rmse FROM rr UNION ALL SELECT 'r2', feature_set, year, r2 FROM rr)", au=_auc1, rr=_rr))
def model_table_union(spark, d):
    return set_scores(spark, d).unpivot(["feature_set", "year"], ["auc", "rmse", "r2"], "metric", "score").select("metric", "feature_set", "year", *r("score"))


_imp = "SELECT feature_set, (y // 25)::INTEGER AS model, abs(corr(y_pred, lidar)) AS imp FROM preds GROUP BY 1, 2"


@query(sql("SELECT feature_set, min(k) FILTER (model = 0) AS m0, min(k) FILTER (model = 1) AS m1, min(k) FILTER (model = 2) AS m2, min(k) FILTER (model = 3) AS m3, count(*) AS n, " + r6("avg(k)", "mean_rank") + " FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY imp DESC, feature_set) AS k FROM im) WHERE k <= 30 GROUP BY feature_set", im=_imp))
def feature_rank_pivot(spark, d):
    im = views.predictions(spark, d).groupBy("feature_set", F.expr("int(y div 25)").alias("model")).agg(F.abs(F.corr("y_pred", "lidar")).alias("imp"))
    k = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("imp"), "feature_set")).cast("long")
    top = im.withColumn("k", k).where("k <= 30")
    return top.groupBy("feature_set").agg(*[F.min(F.when(c("model") == m, c("k"))).alias(f"m{m}") for m in range(4)], F.count(F.lit(1)).alias("n"), rounded(F.avg("k")).alias("mean_rank"))


@query(sql("SELECT feature_set, count(*) AS n FROM preds WHERE feature_set IN ('all_vars', 'medians') AND block_id NOT IN ('0_0', '1_1') GROUP BY feature_set"))
def isin_filter(spark, d):
    return views.predictions(spark, d).where(c("feature_set").isin("all_vars", "medians") & ~c("block_id").isin("0_0", "1_1")).groupBy("feature_set").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT pos, o.feature_set, " + r6("m", "mean") + " FROM (VALUES (0, 'medians'), (1, 'all_vars'), (2, 'spring')) o(pos, feature_set) LEFT JOIN (SELECT feature_set, avg(y_pred) AS m FROM preds GROUP BY 1) USING (feature_set) ORDER BY pos LIMIT 16"))
def fixed_order_topk(spark, d):
    order = spark.createDataFrame([(0, "medians"), (1, "all_vars"), (2, "spring")], "pos int, feature_set string")
    m = views.predictions(spark, d).groupBy("feature_set").agg(F.avg("y_pred").alias("mean"))
    return order.join(m, "feature_set", "left").orderBy("pos").limit(16).select("pos", "feature_set", *r("mean"))


@query(sql("SELECT g.y, g.x, " + r6("pred", "pred") + " FROM grid g WHERE g.y BETWEEN 10 AND 39 AND g.x BETWEEN 20 AND 59 AND pred IS NOT NULL AND EXISTS (SELECT 1 FROM zone_cells z WHERE z.y = g.y AND z.x = g.x)"))
def scan_roundtrip(spark, d):
    g = views.grid(spark, d).select("y", "x", F.coalesce("pred", F.lit(-9999.0)).alias("pred"))
    back = archive.read_raster(spark, archive.write_raster(g, "pred", 10), "pred", -9999.0, (10, 39), (20, 59))
    return back.where("pred IS NOT NULL").join(views.zone_cells(spark, d).select("y", "x"), ["y", "x"], "left_semi").select("y", "x", *r("pred"))


# ---- models (rows only) --------------------------------------------------------------------------------------------


def samples(spark, d):
    g = views.grid(spark, d).where("lidar IS NOT NULL AND pred IS NOT NULL")
    folds = sampling.fold_blocks(usable(spark, d), FOLDS)
    keyed = g.withColumns({"block_row": grids.block("y", 10), "block_col": grids.block("x", 10), "label": (c("lidar") > 0).cast("double")})
    return keyed.join(folds, ["block_row", "block_col"], "left"), ["pred", "other", "height", "code"]


@query()
def hurdle_predict(spark, d):
    s, f = samples(spark, d)
    models = learning.forest_pair(s.where("fold <> 0"), f, "label", "lidar", trees=20, depth=12)
    return learning.predict(s.where("fold = 0"), models, f).select("y", "x", "clf", *r("clf_prob", "rgr", "pred"))


@query()
def oof_predict(spark, d):
    s, f = samples(spark, d)
    return learning.out_of_fold(s, f, "label", "lidar", FOLDS, depth=12).select("y", "x", "fold", *r("pred"))


@query()
def rf_importance(spark, d):
    s, f = samples(spark, d)
    rows = learning.importances(learning.forest_pair(s, f, "label", "lidar", trees=20, depth=12), f)
    return spark.createDataFrame(rows, "feature string, clf double, rgr double")


@query()
def collinearity_screen(spark, d):
    s, f = samples(spark, d)
    rho = learning.correlation_table(s, [*f, "lidar"])
    strength = [abs(float(x)) for x in rho[-1][:-1]]
    kept, reps = learning.drop_correlated(rho[:-1, :-1], f, strength), learning.representatives(rho[:-1, :-1], f, strength)
    return spark.createDataFrame([(n, round(w, 6), n in kept, n in reps) for n, w in zip(f, strength)], "feature string, strength double, kept boolean, representative boolean")


@query()
def lisa_permutation(spark, d):
    g = views.grid(spark, d).where("lidar IS NOT NULL AND pred IS NOT NULL").withColumn("e", c("pred") - c("lidar"))
    return spatialstats.permutation_p(grids.coarsen(g, 5, ["e"]), "e").select("y", "x", *r("local_i", "p"))


@query()
def coregister_shift(spark, d):
    o = views.observations(spark, d).groupBy(F.year("obs_date").alias("scene"), "y", "x").agg(F.avg("B08").alias("v"))
    return registration.shifts(o, "v", 40, 40)
