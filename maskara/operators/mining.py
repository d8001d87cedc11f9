"""Crops around confident predictions that no truth explains, with a limit for each image and one for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from . import masks, matching
from .order import cut, numbered

CROP = "struct<idx: int, conf: double, area: double, best_iou: double, overlap: double, x0: int, y0: int, x1: int, y1: int, refused: int>"


def _share(crop: Column, truths: Column, width: Column, height: Column, size: int) -> Column:
    """The largest share of a crop that one truth's mask covers on the raster; 1 if the crop is empty there."""
    at = lambda v, n: F.least(F.greatest(F.rint(v / n * size).cast("int"), F.lit(0)), F.lit(size))
    x0, y0, x1, y1 = at(crop["x0"], width), at(crop["y0"], height), at(crop["x1"], width), at(crop["y1"], height)
    own = F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))
    most = F.coalesce(F.array_max(F.transform(truths, lambda t: masks.within(t["shape"], x0, y0, x1, y1))), F.lit(0))
    return F.when(own <= 0, 1.0).otherwise(most / own)


def crops_of(rows: DataFrame, least_conf: float, low: float, high: float, max_iou: float, expand: float, least: int, most: int, max_share: float, per_image: int, size: int = masks.SIZE, shared=masks.shared) -> DataFrame:
    """rows (image, idx, gt, model, conf, area, edge, shape, points, width, height, split, place: the order of images) -> a row per image: candidates,
    matched (those that overlap a truth by more than max_iou), refused (crops that truths fill too much) and crops.

    Candidates are of that confidence and of an area in low..high. By falling confidence each takes a square around it, unless over half of it
    lies in one taken before, or truths fill more than max_share of it; after ``per_image`` crops no more are looked at. A crop knows how many were
    refused before it.
    """
    lists = matching.gathered(rows, least_conf, "width", "height", "split", "place", also=("points",), strips=True)
    able = lists.withColumn("c", F.filter("p", lambda p: p["area"].between(low, high)))
    best = lambda x: F.coalesce(F.array_max(F.transform(matching.met(x, F.col("t"), shared), lambda y: y["iou"])), F.lit(0.0))
    able = able.withColumn("c", F.transform("c", lambda x: F.struct(x["idx"].alias("idx"), x["conf"].alias("conf"), x["area"].alias("area"), best(x).alias("best"), x["points"].alias("points"))))
    free = F.filter("c", lambda x: x["best"] <= max_iou)
    box = lambda x: g.square_crop(g.outer_box(g.bounds(x["points"]), F.col("width"), F.col("height")), F.col("width"), F.col("height"), expand, least, most)
    made = able.withColumn("f", F.transform(free, lambda x: F.struct(x["idx"].alias("idx"), x["conf"].alias("conf"), x["area"].alias("area"), x["best"].alias("best"), box(x).alias("crop"))))
    shares = F.transform(F.filter("f", lambda x: x["crop"].isNotNull()), lambda x: x.withField("share", _share(x["crop"], F.col("t"), F.col("width"), F.col("height"), size)))
    made = made.withColumn("f", shares)
    start = F.struct(F.array().cast(f"array<{CROP}>").alias("kept"), F.lit(0).alias("refused"))

    def step(s, x):
        c = x["crop"]
        side = lambda k, lo, hi: F.greatest(F.least(k[hi], c[hi]) - F.greatest(k[lo], c[lo]), F.lit(0))
        covered = F.exists(s["kept"], lambda k: side(k, "x0", "x1") * side(k, "y0", "y1") > 0.5 * (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]))
        own = F.struct(x["idx"].alias("idx"), x["conf"].alias("conf"), x["area"].alias("area"), x["best"].alias("best_iou"), x["share"].alias("overlap"), *(c[k].alias(k) for k in ("x0", "y0", "x1", "y1")), s["refused"].alias("refused"))
        full = F.struct(s["kept"].alias("kept"), (s["refused"] + 1).alias("refused"))
        taken = F.struct(F.array_append(s["kept"], own).cast(f"array<{CROP}>").alias("kept"), s["refused"].alias("refused"))
        return F.when((F.size(s["kept"]) >= per_image) | covered, s).when(x["share"] > max_share, full).otherwise(taken)

    done = made.withColumn("s", F.aggregate("f", start, step))
    return done.select("image", "split", "place", F.size("c").alias("candidates"), F.size(F.filter("c", lambda x: x["best"] > max_iou)).alias("matched"), F.col("s.refused").alias("refused"), F.col("s.kept").alias("crops"))


def mined(crops: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """crops_of() -> (the first ``total`` crops in the order of images and of taking, with their number and name; one row of counters, of the images
    up to the one that the last crop comes from). The prefix is found by ranges of the order, not by a walk."""
    kept = cut(crops)
    each = kept.select("image", "split", "place", F.posexplode("crops").alias("seq", "c")).select("image", "split", "place", "seq", "c.*")
    found = cut(numbered(each, ["place", "seq"], "number").filter(F.col("number") < total))
    last = found.filter(F.col("number") == total - 1).select("place", "refused").first() if total > 0 else None
    seen = kept if last is None else kept.filter(F.col("place") <= last["place"])
    refused = F.col("refused") if last is None else F.when(F.col("place") == last["place"], F.lit(last["refused"])).otherwise(F.col("refused"))
    seen = seen if total > 0 else kept.limit(0)
    sums = seen.agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in (("candidates_total", F.col("candidates")), ("skipped_existing_match", F.col("matched")), ("skipped_gt_crop_overlap", refused))))
    counters = sums.crossJoin(F.broadcast(found.agg(F.count("*").alias("hard_negative_images"))))  # a row each
    return found.withColumn("name", F.format_string("hardneg_%s_%05d_%s", "split", "number", "image")), counters
