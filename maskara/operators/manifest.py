"""What a training set is built of: the images that stay, ids dense within each split, manifests, and duplicates with equal masks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import leakage, masks, matching
from .order import cut, numbered, small

#: Names of the splits that come out; IoU at which masks of equal images count as equal; class and category of instances.
DERIVED = {"train": "train_clean", "val": "val_clean", "test": "test_frozen"}
SAME_IOU = 0.99
#: Images that are broadcast by number.
BROADCAST_IMAGES = 1_000_000
CLASS_ID, CATEGORY_ID = 0, 1
#: Splits (or others by which ids start anew) that are broadcast.
FEW = 10_000


def ids_within(rows: DataFrame, by: str, keys: list[str | Column], name: str) -> DataFrame:
    """rows with ``name``: 1, 2, ... within each value of ``by``, in the order of the keys, which should tell its rows apart. One global order is numbered by
    ranges; where a value starts is a row of a small table."""
    all_ = cut(numbered(rows, [by, *keys], "_place"))
    first = all_.groupBy(by).agg(F.min("_place").alias("_first"))
    same = F.col(f"a.{by}").eqNullSafe(F.col(f"f.{by}"))
    return all_.alias("a").join(small(first, FEW).alias("f"), same).select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("_place") - F.col("_first") + 1).alias(name))


def selection(assets: DataFrame) -> DataFrame:
    """assets (image, source, name, sha256, scene, split) that stay, with derived and first_view: without leaks between splits; of one content in train the
    first by name; first_view tells which test image is the first of its scene."""
    clean = leakage.leak_free(assets).filter("why IS NULL").drop("why")
    train = leakage.first_of(clean.filter("split = 'train'"), "sha256").filter("first").drop("first").withColumn("first_view", F.lit(False))
    test = leakage.first_of(clean.filter("split = 'test'"), "scene").withColumnRenamed("first", "first_view")
    kept = train.unionByName(clean.filter("split = 'val'").withColumn("first_view", F.lit(False))).unionByName(test)
    return kept.withColumn("derived", F.element_at(F.create_map(*(F.lit(x) for kv in DERIVED.items() for x in kv)), F.col("split")))


def with_image_ids(kept: DataFrame) -> DataFrame:
    """selection() with coco_image_id, and unique_image_id of the test's first views (null for others), each by lower-case name, then name."""
    order = [F.lower("name"), F.col("name"), F.col("image")]
    ids = ids_within(kept, "derived", order, "coco_image_id")
    views = ids_within(kept.filter("first_view").select("image", "name", "derived"), "derived", order, "unique_image_id").select("image", "unique_image_id")
    return ids.join(views, "image", "left")


def image_manifest(ids: DataFrame, instances: DataFrame) -> DataFrame:
    """with_image_ids() rows and instances (image, line) -> a row per image."""
    n = instances.groupBy("image").agg(F.count("*").alias("instances"))
    label = F.regexp_replace("name", r"\.[^.]+$", ".txt")
    path = lambda kind, name: F.concat_ws("/", F.lit(kind), F.col("split"), name)
    rows = ids.join(n, "image", "left")
    return rows.select(
        F.col("derived").alias("derived_split"), F.col("split").alias("source_split"), "source", F.col("name").alias("image"), label.alias("label"), path("images", F.col("name")).alias("relative_image_path"), path("labels", label).alias("relative_label_path"),
        F.coalesce("instances", F.lit(0)).alias("instances"), F.col("scene").alias("scene_key"), F.col("sha256").alias("image_sha256"), "coco_image_id", F.col("first_view").cast("string").alias("included_in_test_scene_unique"), F.coalesce(F.col("unique_image_id").cast("string"), F.lit("")).alias("test_scene_unique_coco_image_id"),
    )


def polygon_text(pixels: Column) -> Column:
    """x,y;x,y with six decimals: what a polygon's hash is of."""
    return F.array_join(F.transform(pixels, lambda p: F.concat_ws(",", F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"]))), ";")


def instance_manifest(ids: DataFrame, instances: DataFrame) -> DataFrame:
    """with_image_ids() rows and instances (image, line, pixels: points in pixels) -> a row per instance; annotation ids are dense within a split, in the
    order of images and lines."""
    from ..functions.geometry import bounds, polygon_area

    own = ids.select(F.col("image").alias("_i"), "derived", "split", "source", "name", "coco_image_id")
    rows = ids_within(instances.join(own, F.col("image") == F.col("_i")).drop("_i"), "derived", ["coco_image_id", "line"], "coco_annotation_id")
    b = bounds(F.col("pixels"))
    return rows.select(
        F.col("derived").alias("derived_split"), F.col("split").alias("source_split"), "source", F.col("name").alias("image"), F.col("line").alias("label_line"), "coco_image_id", "coco_annotation_id", F.lit(CLASS_ID).alias("yolo_class_id"), F.lit(CATEGORY_ID).alias("coco_category_id"), F.size("pixels").alias("vertices"),
        b["x0"].alias("bbox_x"), b["y0"].alias("bbox_y"), (b["x1"] - b["x0"]).alias("bbox_w"), (b["y1"] - b["y0"]).alias("bbox_h"), polygon_area(F.col("pixels")).alias("area"), F.sha2(polygon_text(F.col("pixels")), 256).alias("polygon_sha256"),
    )


def duplicate_groups(images: DataFrame, instances: DataFrame, least: float = SAME_IOU) -> DataFrame:
    """images (image, sha256, width, height, place: their order) and instances (image, idx, shape: masks on one raster, or points: polygons,
    drawn here only of images that have a copy) -> a row per content that several
    images have: sha256, n, kind and min_iou.

    kind: dimension_conflict (sizes differ); exact_raster (the same masks); equivalent_raster (the masks of each image match those of the first one to one at
    ``least``; min_iou is the lowest IoU of those pairs); else label_conflict. min_iou is 1 but for equivalent_raster.
    """
    several = images.groupBy("sha256").agg(F.count("*").alias("n"), F.count_distinct("width", "height").alias("sizes"), F.min_by("image", "place").alias("first")).filter("n > 1")
    held = cut(images.join(several, "sha256").select("sha256", "image", "n", "sizes", "first"))

    # masks of copies of one size only, as hashes; masks themselves go on of images that are compared
    def of(images_: DataFrame) -> DataFrame:
        chosen = instances.join(small(images_, BROADCAST_IMAGES), "image", "left_semi")
        return chosen if "shape" in instances.columns else chosen.select("image", "idx", masks.packed(F.col("points")).alias("shape"))

    digests = of(held.filter("sizes = 1").select("image")).select("image", F.sha2(F.to_json("shape"), 256).alias("d"))
    signatures = digests.groupBy("image").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("d"))), 256).alias("signature"))
    rows = cut(held.join(signatures, "image", "left").withColumn("signature", F.coalesce("signature", F.lit(""))))
    kinds = rows.groupBy("sha256", "n", "sizes").agg(F.count_distinct("signature").alias("signatures"))
    left = rows.join(kinds.filter("sizes = 1 AND signatures > 1").select("sha256"), "sha256", "left_semi")
    # against the first; copies with its masks match it anyway, and of others with equal masks one is looked at, so a content of many copies is few rows
    first = left.filter("image = first").select("sha256", F.col("image").alias("_first"), F.col("signature").alias("base_signature"))
    others = left.groupBy("sha256", "signature").agg(F.min("image").alias("_other")).join(first, "sha256").filter("signature <> base_signature")
    others = cut(others.select("sha256", "_first", "_other"))
    compared = others.select(F.col("_first").alias("image")).union(others.select("_other")).distinct()
    lists = of(compared).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("idx", "shape"))).alias("own"))
    empty = F.array().cast(lists.schema["own"].dataType)
    others = others.join(lists.select(F.col("image").alias("_first"), F.col("own").alias("base")), "_first", "left").join(lists.select(F.col("image").alias("_other"), "own"), "_other", "left")
    others = others.select("sha256", F.coalesce("base", empty).alias("base"), F.coalesce("own", empty).alias("own"))
    near = F.transform("base", lambda x: F.struct(x["idx"].alias("idx"), matching.falling(F.filter(matching.met(x, F.col("own"), masks.shared, "idx"), lambda y: y["iou"] >= least)).alias("gts")))
    pairs = others.select("sha256", F.size("base").alias("n_base"), F.size("own").alias("n_own"), near.alias("near"))

    def lowest(batches):
        for batch in batches:
            out = []
            for a, b, near_ in zip(batch.column("n_base").to_pylist(), batch.column("n_own").to_pylist(), batch.column("near").to_pylist()):
                iou = {(x["idx"], g["idx"]): g["iou"] for x in near_ for g in x["gts"]}
                found = matching.maximum_matching({x["idx"]: [g["idx"] for g in x["gts"]] for x in near_ if x["gts"]}, [x["idx"] for x in near_])
                out.append(min((iou[p, g] for g, p in found.items()), default=1.0) if a == b == len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(out, pa.float64())], names=["sha256", "low"])

    low = pairs.mapInArrow(lowest, "sha256 string, low double").groupBy("sha256").agg(F.min("low").alias("low"), F.count_if(F.col("low").isNull()).alias("apart"))
    kind = F.when(F.col("sizes") > 1, "dimension_conflict").when(F.col("signatures") == 1, "exact_raster").when(F.col("apart") == 0, "equivalent_raster").otherwise("label_conflict")
    return kinds.join(low, "sha256", "left").select("sha256", "n", kind.alias("kind"), F.when(kind == "equivalent_raster", F.col("low")).otherwise(1.0).alias("min_iou"))


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, rows, exact and equivalent groups, conflicts, and the lowest matched IoU (1 without one)."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), count("exact_raster").alias("exact_raster_groups"), count("equivalent_raster").alias("equivalent_raster_groups"), (count("dimension_conflict") + count("label_conflict")).alias("conflicts"), F.coalesce(F.min("min_iou"), F.lit(1.0)).alias("minimum_matched_iou"))
