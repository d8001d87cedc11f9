"""Polygon and box geometry as columns.

A polygon is an array of structs (x, y) with coordinates in 0..1; a box is four columns, inclusive at both ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _next(p: Column) -> Column:
    """The polygon turned by one point, so that zip_with pairs each point with the one after it."""
    n = F.size(p)
    return F.concat(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.slice(p, 1, F.least(n, F.lit(1))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _twice_area(p: Column) -> Column:
    return _sum(F.zip_with(p, _next(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))


def polygon_area(p: Column) -> Column:
    """Shoelace area; 0 below three points."""
    return F.when(F.size(p) < 3, 0.0).otherwise(F.abs(_twice_area(p)) / 2)


def pixel_area_ratio(p: Column, width: Column, height: Column) -> Column:
    """Area of the polygon on (width - 1) x (height - 1), over width x height."""
    return polygon_area(p) * (width - 1) * (height - 1) / F.greatest(width * height, F.lit(1))


def bounds(p: Column) -> Column:
    """Struct x0, y0, x1, y1."""
    x, y = F.transform(p, lambda a: a["x"]), F.transform(p, lambda a: a["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def boxes_overlap(a: str, b: str) -> Column:
    """Whether two boxes (prefixes of x0, y0, x1, y1) meet; touching counts."""
    c = F.col
    return (c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{b}x0") <= c(f"{a}x1")) & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{b}y0") <= c(f"{a}y1"))


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of boxes of whole pixels, both ends included."""
    c = F.col
    side = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0))
    area = lambda p: (c(f"{p}x1") - c(f"{p}x0") + 1) * (c(f"{p}y1") - c(f"{p}y0") + 1)
    inter = side(F.greatest(c(f"{a}x0"), c(f"{b}x0")), F.least(c(f"{a}x1"), c(f"{b}x1"))) * side(F.greatest(c(f"{a}y0"), c(f"{b}y0")), F.least(c(f"{a}y1"), c(f"{b}y1")))
    return inter.cast("double") / (area(a) + area(b) - inter)


def touches_edge(p: Column, margin: float = 0.0) -> Column:
    b = bounds(p)
    return (b["x0"] <= margin) | (b["y0"] <= margin) | (b["x1"] >= 1 - margin) | (b["y1"] >= 1 - margin)


def edge_distance(p: Column) -> Column:
    b = bounds(p)
    return F.least(b["x0"], b["y0"], 1 - b["x1"], 1 - b["y1"])


def vertex_mean(p: Column) -> Column:
    n = F.size(p)
    return F.struct((_sum(F.transform(p, lambda a: a["x"])) / n).alias("x"), (_sum(F.transform(p, lambda a: a["y"])) / n).alias("y"))


def _clamped(v: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high) if not isinstance(high, Column) else high, v))


def centroid(p: Column) -> Column:
    """Area-weighted, in 0..1; the mean of the vertices where the area vanishes."""
    twice, mean = _twice_area(p), vertex_mean(p)
    moment = lambda k: _sum(F.zip_with(p, _next(p), lambda a, b: (a[k] + b[k]) * (a["x"] * b["y"] - b["x"] * a["y"])))
    flat = F.abs(twice) < 1e-9
    return F.struct(*(_clamped(F.when(flat, mean[k]).otherwise(moment(k) / F.when(flat, F.lit(None)).otherwise(3 * twice))).alias(k) for k in "xy"))


def perimeter(p: Column) -> Column:
    return _sum(F.zip_with(p, _next(p), lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))))


def circularity(p: Column, area: Column) -> Column:
    around = perimeter(p)
    return 4 * math.pi * area / F.greatest(around * around, F.lit(1e-9))


def rounded_box(b: Column, width: Column, height: Column) -> Column:
    """Pixel box, half to even."""
    at = lambda v, n: F.rint(v * (n - 1)).cast("int")
    return F.struct(at(b["x0"], width).alias("x0"), at(b["y0"], height).alias("y0"), at(b["x1"], width).alias("x1"), at(b["y1"], height).alias("y1"))


def outer_box(b: Column, width: Column, height: Column) -> Column:
    """Pixel box that covers the polygon: floor of the low ends, ceiling of the high ones."""
    down, up = (lambda v, n: F.floor(v * (n - 1)).cast("int")), (lambda v, n: F.ceil(v * (n - 1)).cast("int"))
    return F.struct(down(b["x0"], width).alias("x0"), down(b["y0"], height).alias("y0"), up(b["x1"], width).alias("x1"), up(b["y1"], height).alias("y1"))


def square_crop(b: Column, width: Column, height: Column, expand: float, least: int, most: int) -> Column:
    """A square around a pixel box, ``expand`` times its longer side (half to even), within least..most, or the image's shorter side where it doesn't
    fit; moved into the image. Its centre and half are whole pixels, rounded down. Null if under least."""
    longer = F.greatest(b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1, F.lit(1))
    side = F.greatest(F.lit(least), F.least(F.lit(most), F.rint(longer * expand).cast("int")))
    side = F.when((side > width) | (side > height), F.least(width, height)).otherwise(side).cast("int")
    half = lambda v: F.floor(v / 2).cast("int")
    low = lambda a, z, n: F.greatest(F.lit(0), F.least(n - side, half(b[a] + b[z]) - half(side)))
    x, y = low("x0", "x1", width), low("y0", "y1", height)
    return F.when(side >= least, F.struct(x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1")))


def margin_crop(b: Column, width: Column, height: Column, margin: float) -> Column:
    """A pixel box grown on each side by a share of its sides, clamped to the image."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return F.struct(F.greatest(F.lit(0), F.floor(b["x0"] - w * margin).cast("int")).alias("x0"), F.greatest(F.lit(0), F.floor(b["y0"] - h * margin).cast("int")).alias("y0"), F.least(width, F.ceil(b["x1"] + w * margin + 1).cast("int")).alias("x1"), F.least(height, F.ceil(b["y1"] + h * margin + 1).cast("int")).alias("y1"))


def to_pixels(p: Column, width: Column, height: Column) -> Column:
    return F.transform(p, lambda a: F.struct(F.rint(a["x"] * (width - 1)).cast("int").alias("x"), F.rint(a["y"] * (height - 1)).cast("int").alias("y")))


def self_intersects(p: Column) -> Column:
    """Whether two edges that are not neighbours cross properly; touching in a line is no crossing."""
    n = F.size(p)
    edge = F.sequence(F.lit(0), n - 1)
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def crosses(i, j):
        a, b, c, d = F.get(p, i), F.get(p, (i + 1) % n), F.get(p, j), F.get(p, (j + 1) % n)
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    return F.when(n < 4, F.lit(False)).otherwise(F.exists(edge, lambda i: F.exists(edge, lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1)) & crosses(i, j))))


def valid_roi(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Finite, in 0..1, of positive sides."""
    each = [x0, y0, x1, y1]
    fine = F.lit(True)
    for v in each:
        fine = fine & v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0)
    return fine & (x1 > x0) & (y1 > y0)


def roi_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Half to even, inside the image, one pixel at least."""
    left, top = F.least(F.greatest(F.rint(x0 * width).cast("int"), F.lit(0)), width - 1), F.least(F.greatest(F.rint(y0 * height).cast("int"), F.lit(0)), height - 1)
    right, bottom = F.least(F.greatest(F.rint(x1 * width).cast("int"), left + 1), width), F.least(F.greatest(F.rint(y1 * height).cast("int"), top + 1), height)
    return F.struct(left.alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1"))


def roi_to_frame(v: Column, offset: Column, size: Column) -> Column:
    """A coordinate within a region, in the frame, clamped to it."""
    return F.greatest(F.lit(0.0), F.least(size.cast("double"), v + offset))


def box_center(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"))


def normalized_pixel(v: Column, size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.greatest(size - 1, F.lit(1))))


def mapped_pixel(v: Column, size: Column, target: Column) -> Column:
    return normalized_pixel(v, size) * F.greatest(target - 1, F.lit(1))


def tile_starts(size: Column, tile: Column, overlap: float) -> Column:
    """Starts of tiles that cover a side: steps of the tile less its overlap, and a last tile at the end."""
    step = F.greatest(F.lit(1), F.rint(tile * (1 - overlap)).cast("int"))
    last = size - tile
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(F.sequence(F.lit(0), last, step), F.array(last))))


def keeps_in_tile(b: Column, tile: Column, margin: float, width: Column, height: Column) -> Column:
    """Whether a box in frame pixels stays clear of its tile's inner edges; edges of the frame don't count."""
    return ~(((tile["x0"] > 0) & (b["x0"] <= tile["x0"] + margin)) | ((tile["y0"] > 0) & (b["y0"] <= tile["y0"] + margin)) | ((tile["x1"] < width) & (b["x1"] >= tile["x1"] - 1 - margin)) | ((tile["y1"] < height) & (b["y1"] >= tile["y1"] - 1 - margin)))


def unit_vector(v: Column, eps: float = 1e-8) -> Column:
    """Less its mean, over its length; zeros where that is at most eps."""
    mean = _sum(v) / F.size(v)
    centered = F.transform(v, lambda x: x - mean)
    length = F.sqrt(_sum(F.transform(centered, lambda x: x * x)))
    return F.transform(centered, lambda x: F.when(length <= eps, 0.0).otherwise(x / length))


def correlation(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def fitted_size(width: Column, height: Column, most: int) -> Column:
    """The size at which the longer side is ``most``, one pixel at least."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    return F.struct(F.greatest(F.lit(1), F.rint(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.rint(height * scale).cast("int")).alias("height"))
