"""Scene registration: translations by phase correlation of gradients, and their application as key offsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shifts(scenes: DataFrame, value: str, height: int, width: int, most: float = 5.0) -> DataFrame:
    """(scene, dy, dx, peak): each scene's translation against the temporal median, identity beyond ``most`` cells.

    A scene is one group of at most height x width cells; the median image is an aggregate joined to each scene.
    """
    median = scenes.groupBy("y", "x").agg(F.median(value).alias("ref"))
    paired = scenes.join(median, ["y", "x"]).select("scene", "y", "x", F.col(value).alias("v"), "ref")

    def image(pdf: pd.DataFrame, c: str) -> np.ndarray:
        out = np.full((height, width), float(pdf[c].mean()))
        out[pdf["y"], pdf["x"]] = pdf[c]
        gy, gx = np.gradient(out)
        return 0.5 * np.abs(gx) + 0.5 * np.abs(gy)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.fft.fft2(image(pdf, "v")), np.fft.fft2(image(pdf, "ref"))
        cross = a * np.conj(b)
        surface = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        i, j = np.unravel_index(surface.argmax(), surface.shape)
        dy, dx = (i - height if i > height // 2 else i), (j - width if j > width // 2 else j)
        if np.hypot(dy, dx) > most:
            dy = dx = 0
        return pd.DataFrame({"scene": [int(pdf["scene"].iloc[0])], "dy": [int(dy)], "dx": [int(dx)], "peak": [round(float(surface.max()), 6)]})

    return paired.groupBy("scene").applyInPandas(run, "scene int, dy int, dx int, peak double")


def apply_shift(scenes: DataFrame, found: DataFrame) -> DataFrame:
    """Scenes with whole-cell shifts undone."""
    out = scenes.join(F.broadcast(found.select("scene", "dy", "dx")), "scene")
    return out.withColumns({"y": F.col("y") - F.col("dy"), "x": F.col("x") - F.col("dx")}).drop("dy", "dx")
