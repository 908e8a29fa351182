"""Spectral indices and names of features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import clip, safe_div

# Fixed values.
BANDS = ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12")
INDICES = ("s2wi", "ndmi", "ndre2", "grvi", "psri", "tdvi", "nbr", "bsi")
UNCLIPPED = ("psri", "tdvi")
WINDOWS = {"season": (3, 11), "spring": (3, 5), "summer": (6, 8), "fall": (9, 11)}
DELTAS = {"spring_delta": ((5, 6), (3, 4)), "fall_delta": ((8, 9), (10, 11))}


def _difference(a: str, b: str) -> Column:
    return safe_div(F.col(a) - F.col(b), F.col(a) + F.col(b))


def spectral_indices() -> dict[str, Column]:
    """The eight indices over reflectance columns; normalised ones are clipped to [-1, 1]."""
    c = F.col
    root = c("B08") * c("B08") + c("B04") + 0.5
    bare, green = c("B11") + c("B04"), c("B08") + c("B02")
    found = {
        "s2wi": _difference("B05", "B12"),
        "ndmi": _difference("B08", "B11"),
        "ndre2": _difference("B8A", "B06"),
        "grvi": _difference("B03", "B04"),
        "psri": safe_div(c("B04") - c("B02"), c("B06")),
        "tdvi": F.when(root > 0, 1.5 * ((c("B08") - c("B04")) / F.sqrt(root))),
        "nbr": _difference("B08", "B12"),
        "bsi": safe_div(bare - green, bare + green),
    }
    return {k: v if k in UNCLIPPED else clip(v, -1.0, 1.0) for k, v in found.items()}


def legacy_indices(eps: float = 1e-10) -> dict[str, Column]:
    """The older thirteen, with an additive epsilon where the newer ones have a floor (fixed values; evi has neither)."""
    c = F.col
    nd = lambda a, b: (c(a) - c(b)) / (c(a) + c(b) + eps)
    root = c("B08") * c("B08") + c("B04") + 0.5
    return {
        "s2wi": nd("B05", "B12"), "ndmi": nd("B08", "B11"), "ndre2": nd("B08", "B06"), "grvi": nd("B03", "B04"), "nbr": nd("B08", "B12"),
        "gndvi": nd("B08", "B03"), "ndbi": nd("B11", "B08"), "psri": (c("B04") - c("B02")) / (c("B06") + eps), "msi": c("B11") / (c("B08") + eps),
        "ireci": (c("B07") - c("B04")) / (c("B05") / (c("B06") + eps) + eps), "evi": 2.5 * (c("B08") - c("B04")) / (c("B08") + 6.0 * c("B04") - 7.5 * c("B02") + 1.0),
        "tdvi": F.when(root > 0, 1.5 * ((c("B08") - c("B04")) / F.sqrt(root))), "bsi": ((c("B11") + c("B04")) - (c("B08") + c("B02"))) / ((c("B11") + c("B04")) + (c("B08") + c("B02")) + eps),
    }


def feature_names() -> list[str]:
    """All names of seasonal features, in band order."""
    names = [f"{b}_{w}_{s}" for b in (*BANDS, *INDICES) for w in WINDOWS for s in ("median", "iqr")]
    return names + [f"{b}_{d}" for b in (*BANDS, *INDICES) for d in DELTAS]


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """The thirteen feature sets by rules on column names; labels and keys among ``columns`` are in none."""
    names = set(feature_names())
    pick = lambda f: [c for c in columns if f(c)]
    season = lambda *s: pick(lambda c: any(c.endswith(f"_{x}_median") for x in s))
    return {
        "spring": season("spring"), "summer": season("summer"), "fall": season("fall"),
        "spring_summer": season("spring", "summer"), "spring_fall": season("spring", "fall"), "summer_fall": season("summer", "fall"),
        "three_seasons": pick(lambda c: c.endswith("_median") and not c.endswith("season_median")), "all_seasons": pick(lambda c: c.endswith("_median")),
        "growing_season": season("season"), "deltas_only": pick(lambda c: c.endswith("delta")), "medians_deltas": pick(lambda c: c.endswith(("median", "delta"))),
        "iqr_only": pick(lambda c: c.endswith("iqr")), "all_vars": pick(lambda c: c.startswith("band_") or c in names),
    }
