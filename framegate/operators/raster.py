"""Brightness, sharpness and focus of gray rasters.

Two forms of each. Columns over array<double> stay in the JVM and suit small rasters.
raster_metrics works on decoded image bytes with numpy, batch by batch, where a picture has
millions of pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.presets import DARK, FOCUS_GRADIENT, FOCUS_VARIANCE, GLARE, LUMA


def _inner(gray: Column, width: int) -> Column:
    """Positions (from 0) of pixels with four neighbours."""
    rows = F.floor(F.size(gray) / width).cast("int")
    every = F.sequence(F.lit(0), F.size(gray) - 1)
    return F.filter(every, lambda i: (i % width > 0) & (i % width < width - 1) & (i >= width) & (i < (rows - 1) * width))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _laplacian(gray: Column, width: int) -> Column:
    at = lambda i: F.get(gray, i.cast("int"))
    return F.transform(_inner(gray, width), lambda i: at(i - width) + at(i + width) + at(i - 1) + at(i + 1) - 4 * at(i))


def _variance(values: Column) -> Column:
    """E[x^2] - E[x]^2; 0 without values."""
    square = F.transform(values, lambda x: x * x)
    return F.when(F.size(values) == 0, 0.0).otherwise(_mean(square) - F.pow(_mean(values), F.lit(2)))


def raster_sharpness(df: DataFrame, gray: str, width: int, out: str = "sharpness") -> DataFrame:
    """Variance of the 4-neighbour Laplacian over inner pixels, at least 0."""
    df = df.withColumn("_lap", _laplacian(F.col(gray), width))
    return df.withColumn(out, F.greatest(F.lit(0.0), _variance(F.col("_lap")))).drop("_lap")


def raster_focus(df: DataFrame, gray: str, width: int, out: str = "focus") -> DataFrame:
    """100 (0.7 v + 3 g) / (m + 1): v the Laplacian's variance, g the mean gradient of inner
    pixels, m the mean of all; 0 for a dark or glaring raster."""
    at = lambda i: F.get(F.col(gray), i.cast("int"))
    grad = F.transform(_inner(F.col(gray), width), lambda i: F.sqrt(F.pow(at(i + 1) - at(i - 1), F.lit(2)) + F.pow(at(i + width) - at(i - width), F.lit(2))))
    df = df.withColumns({"_m": _mean(F.col(gray)), "_lap": _laplacian(F.col(gray), width), "_grad": grad})
    mean_grad = F.when(F.size("_grad") == 0, 0.0).otherwise(_mean(F.col("_grad")))
    score = 100 * (FOCUS_VARIANCE * _variance(F.col("_lap")) + FOCUS_GRADIENT * mean_grad) / (F.col("_m") + 1)
    return df.withColumn(out, F.when((F.col("_m") < DARK) | (F.col("_m") > GLARE), 0.0).otherwise(score)).drop("_m", "_lap", "_grad")


def raster_brightness(df: DataFrame, gray: str, width: int, x0: int, y0: int, x1: int, y1: int, out: str = "brightness") -> DataFrame:
    """Mean over the central half of the box [x0, x1) x [y0, y1), cut to the raster; 0 if
    nothing is left."""
    w, h = x1 - x0, y1 - y0
    left, top = max(0, int(np.floor(x0 + w * 0.25))), max(0, int(np.floor(y0 + h * 0.25)))
    right, bottom = min(width, left + int(np.floor(w * 0.5))), top + int(np.floor(h * 0.5))
    every = F.sequence(F.lit(0), F.size(gray) - 1)
    inside = F.filter(every, lambda i: (i % width >= left) & (i % width < right) & (i >= top * width) & (i < bottom * width))
    df = df.withColumn("_in", F.transform(inside, lambda i: F.get(F.col(gray), i)))
    return df.withColumn(out, F.when(F.size("_in") == 0, 0.0).otherwise(_mean(F.col("_in")))).drop("_in")


def measures(gray: np.ndarray) -> tuple[float, float, float]:
    """(brightness of the central half, sharpness, focus) of one gray raster."""
    h, w = gray.shape
    centre = gray[h // 4 : h // 4 + h // 2, w // 4 : w // 4 + w // 2]
    bright = float(centre.mean()) if centre.size else 0.0
    if h < 3 or w < 3:
        return bright, 0.0, 0.0
    mid = gray[1:-1, 1:-1]
    lap = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * mid
    var = float((lap**2).mean() - lap.mean() ** 2)
    grad = float(np.sqrt((gray[1:-1, 2:] - gray[1:-1, :-2]) ** 2 + (gray[2:, 1:-1] - gray[:-2, 1:-1]) ** 2).mean())
    mean = float(gray.mean())
    focus = 0.0 if mean < DARK or mean > GLARE else 100 * (FOCUS_VARIANCE * var + FOCUS_GRADIENT * grad) / (mean + 1)
    return bright, max(0.0, var), focus


def raster_metrics(images: DataFrame, id_col: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """brightness, sharpness and focus of decoded images (height, width, n_channels, data:
    BGR bytes); NULL where an image was not decoded. keep: text columns to pass on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, h, w, c, data, *kept in batch.itertuples(index=False):
                if h is None or h <= 0 or data is None or len(data) != h * w * c:
                    out.append((name, None, None, None, *kept))
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                gray = px[..., 0] if c == 1 else px[..., :3] @ np.array(LUMA[::-1])
                out.append((name, *measures(gray), *kept))
            yield pd.DataFrame(out, columns=[id_col, "brightness", "sharpness", "focus", *keep])

    rows = images.select(id_col, "height", "width", "n_channels", "data", *keep)
    return rows.mapInPandas(run, ", ".join([f"{id_col} string, brightness double, sharpness double, focus double", *(f"{k} string" for k in keep)]))
