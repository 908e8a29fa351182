"""Catalog, scene and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices
from ..functions.semantics import rounded
from ..operators import features, ingest
from ..sources import views
from .registry import query
from .relations import INDEX_SQL, r6, sql

BANDS, IDX, WINDOWS = indices.BANDS, indices.INDICES, indices.WINDOWS
FLAGSHIP = ["B04", "B08", *IDX]


def scaled(spark, d):
    return ingest.mask_scale(views.observations(spark, d))


def indexed(spark, d):
    return ingest.day_merge(scaled(spark, d)).withColumns(indices.spectral_indices())


def r(*cols):
    return [rounded(c).alias(c) for c in cols]


@query(sql("SELECT obs_date, tile, id, baseline, cloud_cover FROM (SELECT *, datetime::DATE AS obs_date, row_number() OVER (PARTITION BY datetime::DATE, tile ORDER BY baseline DESC, id) AS n FROM catalog WHERE cloud_cover < 80) WHERE n = 1"))
def catalog_filter_dedup(spark, d):
    return ingest.latest_items(views.catalog(spark, d))


@query(sql("SELECT id, tile FROM catalog c WHERE EXISTS (SELECT 1 FROM catalog b WHERE b.cloud_cover < 20 AND b.k = 0 AND b.tile = c.tile AND b.datetime::DATE = c.datetime::DATE)"))
def catalog_semi_join(spark, d):
    c = views.catalog(spark, d)
    days = c.where("cloud_cover < 20 AND k = 0").select("tile", F.to_date("datetime").alias("obs_date"))
    return c.withColumn("obs_date", F.to_date("datetime")).join(days, ["tile", "obs_date"], "left_semi").select("id", "tile")


@query(sql("SELECT m::INTEGER AS month FROM (SELECT unnest(range(1, 13)) AS m) WHERE m NOT IN (SELECT month(obs_date) FROM obs WHERE year(obs_date) = 2001)"))
def missing_months_anti(spark, d):
    return ingest.missing_months(views.observations(spark, d), 2001)


@query(sql("SELECT date_trunc('month', obs_date)::DATE AS month, count(*) AS n, count(DISTINCT obs_date) AS days FROM obs GROUP BY 1"))
def monthly_acquisitions(spark, d):
    return views.observations(spark, d).groupBy(F.to_date(F.date_trunc("month", "obs_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("obs_date").alias("days"))


@query(sql("SELECT obs_date, count(DISTINCT tile) AS tiles, count(tile) AS n FROM obs GROUP BY 1"))
def tiles_per_date(spark, d):
    return views.observations(spark, d).groupBy("obs_date").agg(F.countDistinct("tile").alias("tiles"), F.count("tile").alias("n"))


@query(sql("SELECT y, x, obs_date, tile, " + ", ".join(r6(f"sum({b})", b) for b in BANDS) + ", count(B02) AS n FROM scaled GROUP BY y, x, obs_date, tile"))
def mask_scale(spark, d):
    return scaled(spark, d).groupBy("y", "x", "obs_date", "tile").agg(*[rounded(F.sum(b)).alias(b) for b in BANDS], F.count("B02").alias("n"))


@query(sql("SELECT obs_date, count_if(scl <> 0)::BIGINT AS observed, count_if(scl IN (1, 3, 8, 9, 10, 11))::BIGINT AS cloudy, " + r6("count_if(scl IN (1, 3, 8, 9, 10, 11)) / count_if(scl <> 0)", "cloud_fraction") + " FROM obs GROUP BY 1 HAVING count_if(scl <> 0) > 0 AND count_if(scl IN (1, 3, 8, 9, 10, 11)) / count_if(scl <> 0) <= 0.8"))
def scene_cloud_fraction(spark, d):
    out = ingest.cloud_fraction(views.observations(spark, d)).where("cloud_fraction <= 0.8D")
    return out.select("obs_date", "observed", "cloudy", rounded("cloud_fraction").alias("cloud_fraction"))


@query(sql("SELECT y, x, obs_date, " + ", ".join(r6(b, b) for b in BANDS) + " FROM merged"))
def day_merge_median(spark, d):
    return ingest.day_merge(scaled(spark, d)).select("y", "x", "obs_date", *r(*BANDS))


@query(sql("SELECT y, x, obs_date, " + ", ".join(r6(k, k) for k in IDX) + " FROM idx"))
def spectral_indices(spark, d):
    return indexed(spark, d).select("y", "x", "obs_date", *r(*IDX))


_E = "0.0000000001::DOUBLE"
_nd = lambda a, b: f"({a} - {b}) / ({a} + {b} + {_E})"
LEGACY = {"s2wi": _nd("B05", "B12"), "ndmi": _nd("B08", "B11"), "ndre2": _nd("B08", "B06"), "grvi": _nd("B03", "B04"), "nbr": _nd("B08", "B12"), "gndvi": _nd("B08", "B03"), "ndbi": _nd("B11", "B08"), "psri": f"(B04 - B02) / (B06 + {_E})", "msi": f"B11 / (B08 + {_E})", "ireci": f"(B07 - B04) / (B05 / (B06 + {_E}) + {_E})", "evi": f"2.5 * (B08 - B04) / (B08 + 6.0 * B04 - 7.5 * B02 + 1.0)", "tdvi": INDEX_SQL["tdvi"], "bsi": f"((B11 + B04) - (B08 + B02)) / ((B11 + B04) + (B08 + B02) + {_E})"}


@query(sql("SELECT y, x, obs_date, " + ", ".join(r6(e, k) for k, e in LEGACY.items()) + " FROM merged WHERE B02 IS NOT NULL"))
def spectral_indices_legacy(spark, d):
    m = ingest.day_merge(scaled(spark, d)).where("B02 IS NOT NULL").withColumns(indices.legacy_indices())
    return m.select("y", "x", "obs_date", *r(*LEGACY))


def _q(b, lo, hi, p):
    return f"quantile_cont(CASE WHEN month(obs_date) BETWEEN {lo} AND {hi} THEN {b} END, {p})"


@query(sql("SELECT y, x, " + ", ".join(r6(_q(b, lo, hi, 0.5), f"{b}_{w}_median") + ", " + r6(f"{_q(b, lo, hi, 0.75)} - {_q(b, lo, hi, 0.25)}", f"{b}_{w}_iqr") for b in FLAGSHIP for w, (lo, hi) in WINDOWS.items()) + " FROM idx GROUP BY y, x"))
def seasonal_median_iqr(spark, d):
    q = features.seasonal_quantiles(indexed(spark, d), FLAGSHIP)
    return q.select("y", "x", *r(*q.columns[2:]))


_med = lambda b, m: f"median(CASE WHEN month(obs_date) IN ({m[0]}, {m[1]}) THEN {b} END)"


@query(sql("SELECT y, x, " + ", ".join(r6(f"{_med(b, new)} - {_med(b, old)}", f"{b}_{k}") for b in IDX for k, (new, old) in indices.DELTAS.items()) + " FROM idx GROUP BY y, x"))
def month_pair_deltas(spark, d):
    out = features.month_deltas(indexed(spark, d), list(IDX))
    return out.select("y", "x", *r(*out.columns[2:]))


@query(sql("SELECT y, x, " + ", ".join(r6(e, k) for k, e in {"mean": "avg(ndmi)", "max": "max(ndmi)", "min": "min(ndmi)", "std": "stddev_pop(ndmi)", "amp": "max(ndmi) - min(ndmi)", "cv": "stddev_pop(ndmi) / greatest(avg(ndmi), 0.000001::DOUBLE)", "p25": "quantile_cont(ndmi, 0.25)", "p50": "quantile_cont(ndmi, 0.5)", "p75": "quantile_cont(ndmi, 0.75)", "iqr": "quantile_cont(ndmi, 0.75) - quantile_cont(ndmi, 0.25)"}.items()) + " FROM idx GROUP BY y, x HAVING avg(ndmi) > 0.01"))
def ten_stat_summary(spark, d):
    out = features.ten_statistics(indexed(spark, d), "ndmi").where("mean > 0.01D")
    return out.select("y", "x", *r(*out.columns[2:]))


@query(sql("SELECT y, x, obs_date, band, " + r6("value", "value") + " FROM (UNPIVOT (SELECT y, x, obs_date, ndmi, nbr, grvi FROM idx) ON ndmi, nbr, grvi INTO NAME band VALUE value)"))
def features_unpivot(spark, d):
    return features.to_long(indexed(spark, d), ["y", "x", "obs_date"], ["ndmi", "nbr", "grvi"]).where("value IS NOT NULL").select("y", "x", "obs_date", "band", *r("value"))


@query(sql("SELECT y, x, " + ", ".join(r6(f"avg({b})", b) for b in ("ndmi", "nbr", "grvi")) + " FROM idx GROUP BY y, x"))
def features_pivot(spark, d):
    long = features.to_long(indexed(spark, d), ["y", "x", "obs_date"], ["ndmi", "nbr", "grvi"])
    return features.to_wide(long, ["y", "x"], ["ndmi", "nbr", "grvi"], F.avg).select("y", "x", *r("ndmi", "nbr", "grvi"))


@query(sql("SELECT band, " + r6("avg((v IS NULL)::INTEGER)", "missing") + " FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {b} AS v FROM idx" for b in (*BANDS, *IDX)) + ") GROUP BY band ORDER BY missing DESC, band LIMIT 30"))
def feature_missing_fraction(spark, d):
    cols = [*BANDS, *IDX]
    return features.missing_fraction(indexed(spark, d), cols).orderBy(F.desc("missing"), "band").limit(30).select("band", *r("missing"))


_names = ", ".join(f"'{n}'" for n in indices.feature_names())


@query(f"WITH f AS (SELECT unnest([{_names}]) AS n) SELECT s AS feature_set, count(*) AS n_features, min(n) AS first_name, max(n) AS last_name FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS s, n FROM f WHERE {c}" for s, c in {
    "spring": "n LIKE '%\\_spring\\_median' ESCAPE '\\'", "summer": "n LIKE '%\\_summer\\_median' ESCAPE '\\'", "fall": "n LIKE '%\\_fall\\_median' ESCAPE '\\'",
    "spring_summer": "regexp_matches(n, '_(spring|summer)_median$')", "spring_fall": "regexp_matches(n, '_(spring|fall)_median$')", "summer_fall": "regexp_matches(n, '_(summer|fall)_median$')",
    "three_seasons": "n LIKE '%median' AND n NOT LIKE '%season\\_median' ESCAPE '\\'", "all_seasons": "n LIKE '%median'", "growing_season": "n LIKE '%season\\_median' ESCAPE '\\'",
    "deltas_only": "n LIKE '%delta'", "medians_deltas": "n LIKE '%median' OR n LIKE '%delta'", "iqr_only": "n LIKE '%iqr'", "all_vars": "true"}.items()) + ") GROUP BY s")
def feature_set_membership(spark, d):
    sets = indices.feature_sets(indices.feature_names())
    rows = spark.createDataFrame([(s, n) for s, names in sets.items() for n in names], "feature_set string, name string")
    return rows.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n_features"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("WITH f AS (SELECT unnest([" + _names + "]) AS n) SELECT n AS name, regexp_extract(n, '^(?:band_)?(.+)_(spring|summer|fall|season)_median$', 1) AS base, regexp_extract(n, '^(?:band_)?(.+)_(spring|summer|fall|season)_median$', 2) AS season, replace(n, '_median', '') AS label, substr(n, 1, 3) AS short FROM f")
def feature_name_parse(spark, d):
    pattern = r"^(?:band_)?(.+)_(spring|summer|fall|season)_median$"
    rows = spark.createDataFrame([(n,) for n in indices.feature_names()], "name string")
    return rows.select("name", F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 2).alias("season"), F.replace("name", F.lit("_median"), F.lit("")).alias("label"), F.substring("name", 1, 3).alias("short"))


@query(sql("SELECT obs_date, last_day(obs_date) AS month_end, monthname(obs_date) AS month_name, month(obs_date)::INTEGER AS month, obs_date < DATE '1999-07-01' AS early, count(*) AS n FROM obs GROUP BY 1"))
def calendar_scalars(spark, d):
    o = views.observations(spark, d).groupBy("obs_date").agg(F.count(F.lit(1)).alias("n"))
    return o.select("obs_date", F.last_day("obs_date").alias("month_end"), F.date_format("obs_date", "MMMM").alias("month_name"), F.month("obs_date").alias("month"), (F.col("obs_date") < F.lit("1999-07-01").cast("date")).alias("early"), "n")


_share = "SELECT obs_date, avg((scl NOT IN (0, 1, 3, 8, 9, 10, 11))::INTEGER) AS valid FROM obs GROUP BY 1"


@query(sql("SELECT obs_date, " + r6("valid", "valid") + " FROM share ORDER BY share.valid DESC, obs_date LIMIT 1", share=_share))
def best_scene(spark, d):
    return ingest.best_scene(views.observations(spark, d)).select("obs_date", *r("valid"))


@query(sql("SELECT obs_date, " + r6("valid", "valid") + " FROM share WHERE share.valid >= (SELECT round(quantile_cont(valid, 0.25), 2) FROM share)", share=_share))
def drop_sparse_scenes(spark, d):
    return ingest.drop_sparse_scenes(views.observations(spark, d)).select("obs_date", *r("valid"))


@query(sql("SELECT count(*) AS n, " + r6("quantile_cont(m, 0.2)", "q_low") + ", " + r6("quantile_cont(m, 0.98)", "q_high") + " FROM (SELECT median(tdvi) AS m FROM idx GROUP BY y, x)"))
def two_stage_quantile(spark, d):
    m = indexed(spark, d).groupBy("y", "x").agg(F.median("tdvi").alias("m"))
    return m.agg(F.count(F.lit(1)).alias("n"), rounded(F.percentile("m", F.lit(0.2))).alias("q_low"), rounded(F.percentile("m", F.lit(0.98))).alias("q_high"))


@query(sql("SELECT y, x, n, " + r6("slope", "slope") + ", " + r6("sqrt(greatest(syy - slope * sxy, 0.0::DOUBLE) / (n - 2))", "fit_rmse") + " FROM (SELECT y, x, count(*) AS n, regr_slope(v, yr) AS slope, regr_syy(v, yr) AS syy, regr_sxy(v, yr) AS sxy FROM yearly GROUP BY y, x HAVING count(*) > 2)", yearly="SELECT y, x, year(obs_date)::DOUBLE AS yr, avg(ndmi) AS v FROM idx WHERE ndmi IS NOT NULL GROUP BY ALL"))
def cell_trend_slope(spark, d):
    return trend(spark, d).select("y", "x", "n", *r("slope", "fit_rmse"))


def trend(spark, d):
    yearly = indexed(spark, d).where("ndmi IS NOT NULL").groupBy("y", "x", F.year("obs_date").cast("double").alias("yr")).agg(F.avg("ndmi").alias("v"))
    fit = yearly.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", "yr").alias("slope"), F.regr_syy("v", "yr").alias("syy"), F.regr_sxy("v", "yr").alias("sxy")).where("n > 2")
    return fit.withColumn("fit_rmse", F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)))


@query(sql("SELECT count(*) AS n, count_if(sign(slope) = sign(y - 20))::BIGINT AS agree, " + r6("avg(slope)", "mean_slope") + " FROM fit WHERE fit_rmse < 1.7 * (SELECT median(fit_rmse) FROM fit) / 0.83",
    yearly="SELECT y, x, year(obs_date)::DOUBLE AS yr, avg(ndmi) AS v FROM idx WHERE ndmi IS NOT NULL GROUP BY ALL",
    fit="SELECT y, x, slope, sqrt(greatest(syy - slope * sxy, 0.0::DOUBLE) / (n - 2)) AS fit_rmse FROM (SELECT y, x, count(*) AS n, regr_slope(v, yr) AS slope, regr_syy(v, yr) AS syy, regr_sxy(v, yr) AS sxy FROM yearly GROUP BY y, x HAVING count(*) > 2)"))
def trend_gated_agreement(spark, d):
    t = trend(spark, d)
    limit = t.agg((1.7 * F.median("fit_rmse") / 0.83).alias("limit"))
    kept = t.join(F.broadcast(limit)).where("fit_rmse < limit")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("slope") == F.signum(F.col("y") - 20)).alias("agree"), rounded(F.avg("slope")).alias("mean_slope"))


@query(sql("SELECT y, x, obs_date, tile, scl FROM obs WHERE y % 20 = 0 AND x % 20 = 0"))
def systematic_sample(spark, d):
    return views.observations(spark, d).where("pmod(y, 20) = 0 AND pmod(x, 20) = 0").select("y", "x", "obs_date", "tile", "scl")


@query(sql("SELECT y, x, B04 FROM (SELECT y, x, " + r6("avg(B04)", "B04") + " FROM scaled GROUP BY y, x) ORDER BY ('0x' || substr(md5(y || '_' || x || '_50'), 1, 8))::BIGINT, y, x LIMIT 200"))
def hash_sample(spark, d):
    from ..operators.sampling import hash_sample as draw

    cells = scaled(spark, d).groupBy("y", "x").agg(rounded(F.avg("B04")).alias("B04"))
    return draw(cells, 200, ["y", "x"], 50).select("y", "x", "B04")


@query(sql("SELECT split, count(*) AS n, count(B04) AS valid FROM (SELECT 'train' AS split, B04 FROM scaled WHERE y < 28 UNION ALL SELECT 'test', B04 FROM scaled WHERE y >= 28 UNION ALL SELECT 'train', B04 FROM scaled WHERE x = 0) GROUP BY split"))
def union_train_test(spark, d):
    s = scaled(spark, d)
    part = lambda name, c: s.where(c).select(F.lit(name).alias("split"), "B04")
    return part("train", "y < 28").unionByName(part("test", "y >= 28")).unionByName(part("train", "x = 0")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("B04").alias("valid"))


@query(sql("SELECT a.y, a.x, " + r6("a.m", "ndmi") + ", " + r6("b.m", "b08") + " FROM (SELECT y, x, median(ndmi) AS m FROM idx GROUP BY y, x) a JOIN (SELECT y, x, median(B08) AS m FROM scaled GROUP BY y, x) b USING (y, x)"))
def concat_bands(spark, d):
    a = indexed(spark, d).groupBy("y", "x").agg(F.median("ndmi").alias("ndmi"))
    b = scaled(spark, d).groupBy("y", "x").agg(F.median("B08").alias("b08"))
    return a.join(b, ["y", "x"]).select("y", "x", *r("ndmi", "b08"))


_scaled_cells = "SELECT y, x, month(obs_date)::INTEGER AS m, avg(B08) AS v FROM scaled WHERE B08 IS NOT NULL GROUP BY ALL"


@query(sql("SELECT y, x, " + r6("avg(v) FILTER (m IN (6, 7)) - avg(v) FILTER (m IN (4, 5))", "summer_spring") + ", " + r6("avg(v) FILTER (m IN (6, 7)) - avg(v) FILTER (m IN (10, 11))", "summer_fall") + " FROM mc GROUP BY y, x", mc=_scaled_cells))
def texture_deltas(spark, d):
    mc = scaled(spark, d).where("B08 IS NOT NULL").groupBy("y", "x", F.month("obs_date").alias("m")).agg(F.avg("B08").alias("v"))
    of = lambda *ms: F.avg(F.when(F.col("m").isin(*ms), F.col("v")))
    return mc.groupBy("y", "x").agg(rounded(of(6, 7) - of(4, 5)).alias("summer_spring"), rounded(of(6, 7) - of(10, 11)).alias("summer_fall"))
