"""The gridded relations as DuckDB common table expressions, and a helper that puts together those a query needs."""

from __future__ import annotations

import re

from ..functions.indices import BANDS
from ..functions.semantics import MASKED_CLASSES

_BANDS = {"B02": "800 + 30 * q", "B03": "900 + 35 * q", "B04": "1000 + 40 * q", "B05": "1100 + 7 * (p % 100)", "B06": "1800 + 11 * (s % 50)", "B07": "2000 + 9 * (p % 80)", "B08": "2500 + 30 * (p % 100)", "B8A": "2600 + 25 * (o % 90)", "B11": "1500 + 30 * (s % 50)", "B12": "900 + 20 * q"}


def nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0.001 THEN ({a} - {b}) / ({a} + {b}) END"


def clipped(e: str) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {e})) END"


INDEX_SQL = {
    "s2wi": clipped(nd("B05", "B12")), "ndmi": clipped(nd("B08", "B11")), "ndre2": clipped(nd("B8A", "B06")), "grvi": clipped(nd("B03", "B04")),
    "psri": "CASE WHEN B06 > 0.001 THEN (B04 - B02) / B06 END", "tdvi": "CASE WHEN B08 * B08 + B04 + 0.5 > 0 THEN 1.5 * ((B08 - B04) / sqrt(B08 * B08 + B04 + 0.5)) END",
    "nbr": clipped(nd("B08", "B12")), "bsi": clipped(nd("(B11 + B04)", "(B08 + B02)")),
}

_masked = ", ".join(map(str, MASKED_CLASSES))
CTES = {
    "obs": "SELECT (o % 40)::INTEGER AS y, (p % 40)::INTEGER AS x, d::DATE AS obs_date, tile, (4 + ln)::DOUBLE / 2 AS baseline, ((s + ln) % 12)::INTEGER AS scl, " + ", ".join(f"({e})::DOUBLE AS {b}" for b, e in _BANDS.items()) + " FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln, l_quantity::DOUBLE AS q, l_shipdate AS d, l_returnflag AS tile FROM lineitem)",
    "scaled": f"SELECT y, x, obs_date, tile, baseline, scl, " + ", ".join(f"CASE WHEN scl NOT IN ({_masked}) THEN ({b} - CASE WHEN baseline >= 4 THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END) / 10000.0::DOUBLE END AS {b}" for b in BANDS) + " FROM obs",
    "merged": "SELECT y, x, obs_date, " + ", ".join(f"median({b}) AS {b}" for b in BANDS) + " FROM scaled GROUP BY y, x, obs_date",
    "idx": "SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in INDEX_SQL.items()) + " FROM merged",
    "cells": "SELECT (l_orderkey % 100)::INTEGER AS y, (l_partkey % 100)::INTEGER AS x, sum(round(l_discount * 100)::BIGINT) * 10.0::DOUBLE / count(*) AS d, sum(round(l_tax * 100)::BIGINT) * 12.0::DOUBLE / count(*) AS t, sum(round(l_quantity)::BIGINT) * 0.4::DOUBLE / count(*) AS height FROM lineitem GROUP BY 1, 2",
    "grid": "SELECT y, x, CASE WHEN (y * 7 + x * 3) % 41 <> 0 THEN l END AS lidar, CASE WHEN (y * 5 + x * 11) % 53 <> 0 THEN 0.6::DOUBLE * l + 0.4::DOUBLE * t END AS pred, t AS other, height, ((y + 3 * x) % 9)::INTEGER AS code FROM (SELECT *, CASE WHEN d < 30 THEN 0.0::DOUBLE ELSE d END AS l FROM cells)",
    "valid": "SELECT * FROM grid WHERE lidar IS NOT NULL AND pred IS NOT NULL",
    "preds": "SELECT y, x, (y // 10) || '_' || (x // 10) AS block_id, (lidar > 50)::INTEGER AS y_true, lidar, f AS feature_set, CASE f WHEN 'all_vars' THEN pred WHEN 'deltas_only' THEN other ELSE 0.5::DOUBLE * lidar + 0.5::DOUBLE * other END AS y_pred FROM valid, (SELECT unnest(['all_vars', 'deltas_only', 'medians']) AS f)",
    "zone_cells": "SELECT zone_id, n_name AS zone_name, r_name AS borough, y, x, ((y + 2 * x) % 4 + 1)::DOUBLE / 4 AS coverage FROM (SELECT DISTINCT s_nationkey AS zone_id, (l_orderkey % 100)::INTEGER AS y, (l_partkey % 100)::INTEGER AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) JOIN nation ON zone_id = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE (y + x) % 25 = zone_id",
    "catalog": "SELECT event_id AS id, ts AS datetime, '18T' || upper(substr(event_type, 1, 2)) AS tile, 3.0::DOUBLE + (user_id % 4) * 0.5::DOUBLE AS baseline, (event_id % 101)::DOUBLE AS cloud_cover, json_extract(props, '$.k')::INTEGER AS k FROM events",
    "blocks10": "SELECT DISTINCT block_id FROM preds",
    "numbered": "SELECT block_id, row_number() OVER (ORDER BY block_id) - 1 AS b FROM blocks10",
    "draws": "SELECT rep, block_id, w FROM (SELECT rep, ('0x' || substr(md5(rep || '_' || j || '_42'), 1, 8))::BIGINT % (SELECT count(*) FROM blocks10) AS b, count(*) AS w FROM (SELECT unnest(range(1000)) AS rep), (SELECT unnest(range((SELECT count(*) FROM blocks10))) AS j) GROUP BY 1, 2) JOIN numbered USING (b)",
}


def sql(body: str, **more: str) -> str:
    """``body`` with the expressions it names, in order, and those that they name; ``more`` are the query's own."""
    known = CTES | more
    need: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(known[name])
                if name not in need:
                    need.append(name)

    for text in (*more.values(), body):
        visit(text)
    need += [n for n in more if n not in need]
    return ("WITH " + ", ".join(f"{n} AS ({known[n]})" for n in need) + " " if need else "") + body


def r6(e: str, name: str | None = None) -> str:
    return f"round({e}, 6) + 0.0::DOUBLE" + (f" AS {name}" if name else "")
