"""Queries on overlaps of masks, and their SQL: outlines are octagons, whose pixels SQL counts a row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import masks, matching, metrics, mining
from . import evaluation, views

CONF, NMS_IOU, MATCH_IOU = evaluation.CONF, evaluation.NMS_IOU, evaluation.MATCH_IOU
#: The four axes, in order; grid_seq breaks ties.
GRID = {"conf": (0.1, 0.4, 0.7), "nms_iou": (0.2, 0.5), "min_area": (0.0, 0.06), "min_edge": (-1.0, 0.05)}
FLOORS = (0.2, 0.1)


def mask_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masks.pairs_of(matching.gathered(views.masked(spark, sf_dir)), masks.looked_up)
    return out.select("image", "p_idx", "g_idx", F.col("inter").cast("long").alias("inter"), F.round("iou", 6).alias("iou"))


MASK_IOU_PAIRS = f"WITH {views.MASK_INST} SELECT image, p_idx, g_idx, inter, round(iou, 6) AS iou FROM over_ WHERE gt"


def mask_nms_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nms(views.mask_rows(spark, sf_dir, CONF), NMS_IOU, CONF)


def mask_match_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(views.mask_rows(spark, sf_dir, CONF), MATCH_IOU, CONF).select("image", "idx", "gt", F.round("iou", 6).alias("iou"))


def _of_masks(sql: str) -> str:
    return sql.replace(views.INST, views.MASK_INST)


MASK_NMS_RASTER = _of_masks(evaluation.MASK_NMS)
MASK_MATCH_RASTER = _of_masks(evaluation.GREEDY_MATCH)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, n, a, e) for c in GRID["conf"] for n in GRID["nms_iou"] for a in GRID["min_area"] for e in GRID["min_edge"]]
    grid = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_seq int, conf double, nms_iou double, min_area double, min_edge double")
    return matching.grid_totals(matching.evaluated_totals(views.mask_rows(spark, sf_dir, min(GRID["conf"])), grid, ["grid_seq", *GRID], MATCH_IOU), ["grid_seq", *GRID])


def mask_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _grid(spark, sf_dir)
    return out.select("grid_seq", *GRID, "gt", "selected_predictions", "kept_predictions", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_SQL = _of_masks(evaluation._GRID)
_SQL = _SQL[: _SQL.index("grid AS (")] + f"""grid AS (SELECT row_number() OVER (ORDER BY {", ".join(f"i_{c}" for c in GRID)}) - 1 AS grid_seq, {", ".join(f"{list(v)}[i_{c}]::DOUBLE AS {c}" for c, v in GRID.items())} FROM {", ".join(f"range(1, {len(v) + 1}) r_{c}(i_{c})" for c, v in GRID.items())}),
""" + _SQL[_SQL.index("sel AS (") :]
_SQL = _SQL.replace("p.area >= g.min_area::DOUBLE", "p.area >= g.min_area AND p.edge >= g.min_edge").replace("SELECT g.grid_seq, g.conf::DOUBLE AS conf, g.nms_iou::DOUBLE AS nms_iou, g.min_area::DOUBLE AS min_area,", "SELECT g.*, (SELECT count(*) FROM truth) AS gt, coalesce(sum(l.rank), 0)::BIGINT AS selected_predictions, coalesce(sum(n_kept), 0)::BIGINT AS kept_predictions,")
_SQL = _SQL.replace("last AS (SELECT grid_seq, image, len(kept)", "last AS (SELECT grid_seq, image, rank, len(kept)")
MASK_GRID = f"WITH RECURSIVE {_SQL} SELECT grid_seq, {', '.join(GRID)}, gt, selected_predictions, kept_predictions, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_"


def mask_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.four_selections(_grid(spark, sf_dir), *FLOORS).select("selection", "grid_seq", *GRID, "tp", "fp", "fn")


_BEST = {"best_f1": ("true", "f1, recall, precision"), "best_target": (f"precision >= {FLOORS[0]} AND recall >= {FLOORS[1]}", "f1, recall"), "best_recall": (f"precision >= {FLOORS[0]}", "recall, f1"), "best_precision": (f"recall >= {FLOORS[1]}", "precision, f1")}
MASK_GRID_BEST = f"WITH RECURSIVE {_SQL} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{k}' AS selection, grid_seq, {', '.join(GRID)}, tp, fp, fn FROM full_ WHERE {where} ORDER BY {', '.join(f'{x} DESC' for x in by.split(', '))}, grid_seq LIMIT 1)" for k, (where, by) in _BEST.items()
)

#: Limits of an image and of all; SQL has no fold over crops, a test holds it against the loop.
MINED = {"least_conf": 0.2, "low": 0.02, "high": 0.12, "max_iou": 0.1, "expand": 1.4, "least": 24, "most": 96, "max_share": 0.3, "per_image": 2}
MOST_MINED = 2000


def hard_negative_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops around confident predictions that no truth explains, in the order of images up to the total."""
    rows = views.masked(spark, sf_dir, MINED["least_conf"]).withColumn("width", F.lit(views.SIDE)).withColumn("height", F.lit(views.SIDE)).withColumn("split", F.lit("train")).withColumn("place", F.col("image"))
    found, _ = mining.mined(mining.crops_of(rows, **MINED, size=views.SIDE, shared=masks.looked_up), MOST_MINED)
    return found.select("name", "image", "idx", "conf", F.round("area", 6).alias("area"), F.round("best_iou", 6).alias("best_iou"), F.round("overlap", 6).alias("overlap"), "x0", "y0", "x1", "y1")


_WITH_SQL = {"mask_iou_pairs": (mask_iou_pairs, MASK_IOU_PAIRS), "mask_nms_raster": (mask_nms_raster, MASK_NMS_RASTER), "mask_match_raster": (mask_match_raster, MASK_MATCH_RASTER), "mask_grid": (mask_grid, MASK_GRID), "mask_grid_best": (mask_grid_best, MASK_GRID_BEST)}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()} | {"hard_negative_crops": hard_negative_crops}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
