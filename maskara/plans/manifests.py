"""Queries on the manifests of a training set and on duplicates with equal masks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import manifest, masks
from ..operators.order import cut
from . import curation, views


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(manifest.with_image_ids(manifest.selection(views.assets(spark, sf_dir))))


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the truths as labels of the document of that number, in pixels of an image of 40 x 40."""
    rows = views.outlines(spark, sf_dir).filter("gt")
    return rows.select("image", (F.col("idx") + 1).alias("line"), F.transform("points", lambda p: F.struct((p["x"] * 40).alias("x"), (p["y"] * 40).alias("y"))).alias("pixels"))


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.image_manifest(_ids(spark, sf_dir), _instances(spark, sf_dir))


def instance_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.instance_manifest(_ids(spark, sf_dir), _instances(spark, sf_dir))
    return out.select("derived_split", "source_split", "source", "image", "label_line", "coco_image_id", "coco_annotation_id", "vertices", *(F.round(c, 6).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h", "area")), "polygon_sha256")


_IDS = f"""{curation._LEAKS}, whole AS (SELECT l.*, a.sha256 FROM leak l JOIN asset a ON a.image = l.image WHERE l.why = ''),
kept AS (SELECT *, false AS first_view FROM whole WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY lower(name), name, image) = 1
  UNION ALL SELECT *, false FROM whole WHERE split = 'val' UNION ALL SELECT *, row_number() OVER (PARTITION BY scene ORDER BY lower(name), name, image) = 1 FROM whole WHERE split = 'test'),
named AS (SELECT *, CASE split WHEN 'train' THEN 'train_clean' WHEN 'val' THEN 'val_clean' ELSE 'test_frozen' END AS derived FROM kept),
ids AS (SELECT *, row_number() OVER (PARTITION BY derived ORDER BY lower(name), name, image) AS coco_image_id, CASE WHEN first_view THEN row_number() OVER (PARTITION BY derived, first_view ORDER BY lower(name), name, image) END AS uid FROM named)"""
IMAGE_MANIFEST = f"""WITH {_IDS}, {views.INST}, n AS (SELECT image, count(*) AS n FROM truth GROUP BY image)
SELECT derived AS derived_split, split AS source_split, source, name AS image, replace(name, '.jpg', '.txt') AS label, 'images/' || split || '/' || name AS relative_image_path, 'labels/' || split || '/' || replace(name, '.jpg', '.txt') AS relative_label_path, coalesce(n.n, 0) AS instances,
  scene AS scene_key, sha256 AS image_sha256, coco_image_id, first_view::VARCHAR AS included_in_test_scene_unique, coalesce(uid::VARCHAR, '') AS test_scene_unique_coco_image_id FROM ids LEFT JOIN n ON n.image = ids.image"""
_S = views.STEP
_RING = [("x0 + c0", "y0"), ("x1 - c1", "y0"), ("x1", "y0 + c1"), ("x1", "y1 - c2"), ("x1 - c2", "y1"), ("x0 + c3", "y1"), ("x0", "y1 - c3"), ("x0", "y0 + c0")]
_TEXT = " || ';' || ".join(f"printf('%.6f,%.6f', ({x})::DOUBLE, ({y})::DOUBLE)" for x, y in _RING)
INSTANCE_MANIFEST = f"""WITH {_IDS}, {views.INST}, o AS (SELECT image, idx, x0, y0, x1, y1, {", ".join(f"{c} AS c{k}" for k, c in enumerate(views._CUT))} FROM truth)
SELECT derived AS derived_split, split AS source_split, source, name AS image, idx + 1 AS label_line, coco_image_id, row_number() OVER (PARTITION BY derived ORDER BY coco_image_id, idx) AS coco_annotation_id, 8 AS vertices, x0::DOUBLE AS bbox_x, y0::DOUBLE AS bbox_y, (x1 - x0)::DOUBLE AS bbox_w, (y1 - y0)::DOUBLE AS bbox_h,
  (x1 - x0) * (y1 - y0) - (c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3) / 2.0::DOUBLE AS area, sha256({_TEXT}) AS polygon_sha256 FROM ids JOIN o ON o.image = ids.image"""

SIDE = masks.SIZE - 1


def duplicate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image with one to three boxes, of places that its SHA-256 gives, in a copy of the text moved by some pixels as its number says."""
    t = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.sha2("text", 256).alias("sha256"))
    byte = lambda k: F.conv(F.substring("sha256", 2 * k + 1, 2), 16, 10).cast("int")
    moved = F.when(F.col("image") % 11 == 0, 9).when(F.col("image") % 3 == 1, 1).otherwise(0)
    images = t.select("image", "sha256", F.when(F.col("image") % 29 == 0, 480).otherwise(640).alias("width"), F.lit(640).alias("height"), F.col("image").alias("place"))
    corner = lambda q: (F.lit(384 * (q % 2)) + byte(1 + q) % 20 + moved, F.lit(384 * (q // 2)) + byte(5 + q) % 20, 330 + byte(9 + q) % 20, 330 + byte(13 + q) % 20)
    ring = lambda x, y, w, h: F.array(*(F.struct((a / SIDE).alias("x"), (b / SIDE).alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
    boxes = F.slice(F.array(*(F.struct(F.lit(q).alias("idx"), ring(*corner(q)).alias("points")) for q in range(3))), 1, byte(0) % 3 + 1)
    rows = t.select("image", F.explode(boxes).alias("b")).select("image", "b.idx", "b.points")
    return manifest.duplicate_groups(images, rows).select("sha256", "n", "kind", F.round("min_iou", 6).alias("min_iou"))


#: A box moved to the right by d: w + 1 - d columns of it are shared; quarters of the image keep boxes apart.
_B = lambda k: f"('0x' || substr(sha256, {2 * k + 1}, 2))::INT"
DUPLICATE_MASKS = f"""WITH t AS (SELECT doc_id AS image, sha256(text) AS sha256, CASE WHEN doc_id % 29 = 0 THEN 480 ELSE 640 END AS width, CASE WHEN doc_id % 11 = 0 THEN 9 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS moved FROM documents),
g AS (SELECT sha256, count(*) AS n, count(DISTINCT width) AS sizes, count(DISTINCT moved) AS moves, arg_min(moved, image) AS base FROM t GROUP BY sha256 HAVING count(*) > 1),
b AS (SELECT DISTINCT g.sha256, abs(t.moved - g.base) AS d, unnest([{", ".join(f"331 + {_B(9 + q)} % 20" for q in range(3))}][1:{_B(0)} % 3 + 1]) AS w FROM g JOIN t USING (sha256) WHERE t.moved <> g.base),
low AS (SELECT sha256, min((w - d) / (w + d)::DOUBLE) AS low FROM b GROUP BY sha256)
SELECT sha256, n, CASE WHEN sizes > 1 THEN 'dimension_conflict' WHEN moves = 1 THEN 'exact_raster' WHEN low >= 0.99 THEN 'equivalent_raster' ELSE 'label_conflict' END AS kind, round(CASE WHEN sizes = 1 AND moves > 1 AND low >= 0.99 THEN low ELSE 1 END, 6) AS min_iou FROM g LEFT JOIN low USING (sha256)"""

_WITH_SQL = {"image_manifest": (image_manifest, IMAGE_MANIFEST), "instance_manifest": (instance_manifest, INSTANCE_MANIFEST), "duplicate_masks": (duplicate_masks, DUPLICATE_MASKS)}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
