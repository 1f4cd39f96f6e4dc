"""Landmark geometry as columns: arrays of normalised points to pixel measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framegate.presets import CROP, IRIS, NATIVE

#: Places of an iris's points after its first: centre, top, bottom, left, right.
CENTER, TOP, BOTTOM, LEFT, RIGHT = range(5)
LEFT_IRIS, RIGHT_IRIS = 468, 473


def landmark_to_pixels(landmarks: Column, width: Column, height: Column) -> Column:
    return F.transform(landmarks, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def iris_points(pixels: Column, start: int) -> Column:
    """The five points of an iris, or NULL if one is missing."""
    points = F.slice(pixels, start + 1, 5)
    whole = (F.size(points) == 5) & ~F.exists(points, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    return F.when(F.coalesce(whole, F.lit(False)), points)


def iris_geometry(points: Column, width: Column, height: Column) -> Column:
    """struct(x, y, diameter): the centre point, and the larger extent cut to 0.8 % - 12 % of
    the short side. NULL where the centre lies outside the frame or below 70 % of it."""
    at = lambda i, axis: F.get(points, F.lit(i))[axis]
    x, y, side = at(CENTER, "x"), at(CENTER, "y"), F.least(width, height)
    extent = F.greatest(F.abs(at(BOTTOM, "y") - at(TOP, "y")), F.abs(at(RIGHT, "x") - at(LEFT, "x")))
    seen = x.between(0, width) & (y >= 0) & (y <= height * IRIS["lowest"])
    return F.when(seen, F.struct(x.alias("x"), y.alias("y"), F.greatest(side * IRIS["least"], F.least(side * IRIS["most"], extent)).alias("diameter")))


def face_bounds(pixels: Column) -> Column:
    xs, ys = F.transform(pixels, lambda p: p["x"]), F.transform(pixels, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height")
    )


def _place(middle: Column, size: Column, most: Column) -> Column:
    """Where a box of that size begins, kept inside the frame."""
    at = F.greatest(F.lit(0.0), F.floor(middle - size / 2).cast("double"))
    return F.when(at + size > most, F.greatest(F.lit(0.0), most - size)).otherwise(at)


def crop_box(points: Column, iris: Column, width: Column, height: Column, padding: float = CROP["padding"], least: int = CROP["least"]) -> Column:
    """struct(x, y, size): a square around the iris. It is cut to the frame by its whole size,
    which is floored last. Without five points it is centred on the iris."""
    box = face_bounds(points)
    five = F.coalesce(F.size(points) >= 5, F.lit(False))
    across = iris["diameter"] * padding
    size = F.greatest(F.lit(float(least)), F.when(five, F.greatest(F.greatest(box["width"], box["height"]) * padding, iris["diameter"] * CROP["padding"])).otherwise(across))
    cx = F.when(five, box["x"] + box["width"] / 2).otherwise(iris["x"])
    cy = F.when(five, box["y"] + box["height"] / 2).otherwise(iris["y"])
    return F.when(
        iris.isNotNull(), F.struct(_place(cx, size, width).alias("x"), _place(cy, size, height).alias("y"), F.floor(size).alias("size"))
    )


def map_to_native(x: Column, y: Column, diameter: Column, box: Column, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    """struct(crop_x, crop_y, crop_size, iris_x, iris_y, radius): a crop box of the analysis
    frame in the camera's own pixels, and the iris in it, mirrored. The last three are NULL
    unless the iris lies within 5 % - 95 % of the crop."""
    scale = (scale_x + scale_y) / 2
    size = F.greatest(F.lit(NATIVE["least"]), box["size"] * scale)

    def cut(at: Column, most: Column) -> Column:
        at = F.greatest(F.lit(0.0), at)
        return F.when(at + size > most, F.greatest(F.lit(0.0), most - size)).otherwise(at)

    left, top = cut(box["x"] * scale_x, width), cut(box["y"] * scale_y, height)
    inx, iny = size - (x * scale_x - left), y * scale_y - top
    low, high = size * NATIVE["margin"], size * (1 - NATIVE["margin"])
    fine = (inx > low) & (inx < high) & (iny > low) & (iny < high)
    return F.struct(
        left.alias("crop_x"), top.alias("crop_y"), size.alias("crop_size"), F.when(fine, inx).alias("iris_x"), F.when(fine, iny).alias("iris_y"),
        F.when(fine, diameter * scale * NATIVE["iris_scale"] / 2).alias("radius"),
    )
