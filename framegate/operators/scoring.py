"""Batch model scoring in two stages, with errors kept as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "item_id string, success boolean, error string, original_size array<int>, upscaled_size array<int>, stage1_ms double, stage2_ms double, total_ms double, quality_score double"

#: Takes (image, hint point) and gives (image, score) or (image, score, mask); takes an image
#: and gives an image.
Stage1 = Callable[[np.ndarray, tuple[int, int]], tuple]
Stage2 = Callable[[np.ndarray], np.ndarray]


def hint_point(x: float | None, y: float | None, width: int, height: int) -> tuple[int, int]:
    """The point, or the image's centre where it is unknown or outside."""
    if x is None or y is None or np.isnan(x) or np.isnan(y) or not (0 <= x < width and 0 <= y < height):
        return width // 2, height // 2
    return int(x), int(y)


def upscaled(image: np.ndarray, stage2: Stage2) -> np.ndarray:
    """stage2 of the image; a fourth channel goes through it on its own. Where stage2 fails
    the image stays as it is."""
    try:
        if image.ndim == 3 and image.shape[2] == 4:
            alpha = stage2(np.repeat(image[..., 3:], 3, axis=2))[..., :1]
            return np.concatenate((stage2(image[..., :3]), alpha), axis=2)
        return stage2(image)
    except Exception:  # the contract of this stage: any failure falls back
        return image


def one_job_an_executor(spark: SparkSession) -> ResourceProfile:
    """A scoring task takes all cores of its executor, so that one model job runs there at a
    time, whatever runs in other stages. Needs a cluster whose scheduler knows such profiles
    (standalone, YARN, Kubernetes); on a local master Spark refuses it."""
    cores = int(spark.conf.get("spark.executor.cores", None) or _cores_of(spark.sparkContext.master))
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def _cores_of(master: str) -> int:
    """Cores of an executor of local-cluster[executors, cores, memory]; 1 for any other master."""
    return int(master.split(",")[1]) if master.startswith("local-cluster[") else 1


def score_two_stage(
    df: DataFrame, stage1_factory: Callable[[], Stage1], stage2_factory: Callable[[], Stage2], return_mask: bool = False, return_intermediate: bool = False,
    return_image: bool = False, profile: ResourceProfile | None = None,
) -> DataFrame:
    """Scores rows of item_id, height, width, n_channels, data, hint_x, hint_y.

    The factories run once a task, so models load once. A stage 1 error fails its row and
    never the job. total_ms = stage1_ms + stage2_ms. The flags add the bytes of stage 1's
    mask, of its image (both of original_size) and of stage 2's image (of upscaled_size), row
    by row, in columns mask, intermediate and upscaled; NULL where there is none. profile: what
    each scoring task takes, as one_job_an_executor() makes it."""
    asked = (("mask", return_mask), ("intermediate", return_intermediate), ("upscaled", return_image))
    pictures = [name for name, wanted in asked if wanted]
    schema = ", ".join([SCHEMA, *(f"{name} binary" for name in pictures)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = stage1_factory(), stage2_factory()
        for batch in batches:
            yield pd.DataFrame([_scored(row, one, two, pictures) for row in batch.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    rows = df.select("item_id", "height", "width", "n_channels", "data", "hint_x", "hint_y")
    return rows.mapInPandas(run, schema, profile=profile)


def _scored(row, one: Stage1, two: Stage2, pictures: list[str]) -> tuple:
    began = time.perf_counter()
    try:
        image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.n_channels)
        cut, score, *mask = one(image, hint_point(row.hint_x, row.hint_y, row.width, row.height))
    except Exception as error:  # one bad row is a result, not the end of the job
        return row.item_id, False, str(error)[:200], None, None, None, None, None, None, *[None] * len(pictures)
    middle = time.perf_counter()
    out = upscaled(cut, two)
    ms1, ms2 = (middle - began) * 1e3, (time.perf_counter() - middle) * 1e3
    made = {"mask": mask[0] if mask else None, "intermediate": cut, "upscaled": out}
    shown = [None if made[p] is None else np.ascontiguousarray(made[p]).tobytes() for p in pictures]
    return row.item_id, True, None, list(cut.shape[:2]), list(out.shape[:2]), ms1, ms2, ms1 + ms2, float(score), *shown
