"""Queries on detection and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as g
from ..operators import curate, matching, metrics, pairs
from . import views

CONF, NMS_IOU, MATCH_IOU = 0.2, 0.3, 0.5
#: The area gate of the error table's policy: none.
ERROR_AREA = 0.0
#: The grid of the flagship query: settings in order; grid_seq breaks ties.
GRID_CONF, GRID_NMS, GRID_AREA = (0.1, 0.3, 0.5, 0.7), (0.2, 0.3, 0.5), (0.0, 0.1)


def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    rows = views.polygons(spark, sf_dir)
    b, c, m = g.bounds(p), g.centroid(p), g.vertex_mean(p)
    r = lambda v: F.round(v, 6)
    return rows.select("image", r(g.polygon_area(p)).alias("area"), r(b["x0"]).alias("x0"), r(b["y0"]).alias("y0"), r(b["x1"]).alias("x1"), r(b["y1"]).alias("y1"), g.touches_edge(p, 0.02).alias("edge"), r(g.edge_distance(p)).alias("edge_distance"), r(c["x"]).alias("cx"), r(c["y"]).alias("cy"), r(m["x"]).alias("mx"), r(m["y"]).alias("my"), r(g.perimeter(p)).alias("perimeter"), r(g.circularity(p, g.polygon_area(p))).alias("circularity"))


POLYGON_MEASURES = f"""
WITH {views.POLY}, s AS (
  SELECT image, sum(px * ny - nx * py) AS t, sum((px + nx) * (px * ny - nx * py)) AS sx, sum((py + ny) * (px * ny - nx * py)) AS sy, sum(sqrt((px - nx) * (px - nx) + (py - ny) * (py - ny))) AS around,
    min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1, avg(px) AS mx, avg(py) AS my FROM pt GROUP BY image
)
SELECT image, round(abs(t) / 2, 6) AS area, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, x0 <= 0.02 OR y0 <= 0.02 OR x1 >= 0.98 OR y1 >= 0.98 AS edge,
  round(least(x0, y0, 1 - x1, 1 - y1), 6) AS edge_distance,
  round(greatest(0, least(1, CASE WHEN abs(t) < 1e-9 THEN mx ELSE sx / (3 * t) END)), 6) AS cx, round(greatest(0, least(1, CASE WHEN abs(t) < 1e-9 THEN my ELSE sy / (3 * t) END)), 6) AS cy,
  round(mx, 6) AS mx, round(my, 6) AS my, round(around, 6) AS perimeter, round(4 * pi() * (abs(t) / 2) / greatest(around * around, 1e-9), 6) AS circularity
FROM s
"""


def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on an image of 641 x 481: rounded, outer, a square crop and a crop with a margin."""
    w, h = F.lit(641), F.lit(481)
    rows = views.polygons(spark, sf_dir).select("image", g.bounds(F.col("points")).alias("b"))
    rows = rows.select("image", g.rounded_box(F.col("b"), w, h).alias("r"), g.outer_box(F.col("b"), w, h).alias("o")).withColumn("s", g.square_crop(F.col("o"), w, h, 1.4, 64, 400)).withColumn("m", g.margin_crop(F.col("o"), w, h, 0.25))
    return rows.select("image", *(F.col(f"{k}.{c}").cast("long").alias(f"{k}_{c}") for k in "rosm" for c in ("x0", "y0", "x1", "y1")))


PIXEL_BOXES = f"""
WITH {views.POLY}, b AS (SELECT image, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM pt GROUP BY image),
o AS (SELECT image, round_even(x0 * 640, 0)::BIGINT AS r_x0, round_even(y0 * 480, 0)::BIGINT AS r_y0, round_even(x1 * 640, 0)::BIGINT AS r_x1, round_even(y1 * 480, 0)::BIGINT AS r_y1,
  floor(x0 * 640)::BIGINT AS o_x0, floor(y0 * 480)::BIGINT AS o_y0, ceil(x1 * 640)::BIGINT AS o_x1, ceil(y1 * 480)::BIGINT AS o_y1 FROM b),
c AS (SELECT *, least(greatest(round_even(greatest(o_x1 - o_x0 + 1, o_y1 - o_y0 + 1) * 1.4::DOUBLE, 0)::BIGINT, 64), 400, 641, 481) AS side FROM o),
d AS (SELECT *, CASE WHEN side >= 64 THEN greatest(0, least(641 - side, (o_x0 + o_x1) // 2 - side // 2)) END AS s_x0, CASE WHEN side >= 64 THEN greatest(0, least(481 - side, (o_y0 + o_y1) // 2 - side // 2)) END AS s_y0 FROM c)
SELECT image, r_x0, r_y0, r_x1, r_y1, o_x0, o_y0, o_x1, o_y1, s_x0, s_y0, s_x0 + side AS s_x1, s_y0 + side AS s_y1,
  greatest(0, floor(o_x0 - (o_x1 - o_x0) * 0.25::DOUBLE)::BIGINT) AS m_x0, greatest(0, floor(o_y0 - (o_y1 - o_y0) * 0.25::DOUBLE)::BIGINT) AS m_y0,
  least(641, ceil(o_x1 + (o_x1 - o_x0) * 0.25::DOUBLE + 1)::BIGINT) AS m_x1, least(481, ceil(o_y1 + (o_y1 - o_y0) * 0.25::DOUBLE + 1)::BIGINT) AS m_y1 FROM d
"""


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.pred_gt(views.preds(spark, sf_dir), views.truths(spark, sf_dir))
    return out.select("image", "p_idx", "g_idx", F.round("iou", 6).alias("iou"))


IOU_PAIRS = f"WITH {views.INST} SELECT image, p_idx, g_idx, round(iou, 6) AS iou FROM pair"


def best_overlap_per_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = views.preds(spark, sf_dir), views.truths(spark, sf_dir)
    out = pairs.best_per_gt(t, p, pairs.pred_gt(p, t), MATCH_IOU)
    return out.select("image", "idx", "best_idx", F.round("best_iou", 6).alias("best_iou"), "best_conf", "reachable")


_BEST_GT = f"""{views.INST}, b AS (SELECT image, g_idx, arg_max(p_idx, (iou, -p_idx)) AS best_idx, max(iou) AS best_iou FROM pair WHERE iou > 0 GROUP BY image, g_idx),
best AS (SELECT t.image, t.idx, t.source, coalesce(b.best_idx, -1) AS best_idx, coalesce(b.best_iou, 0.0) AS best_iou, p.conf AS best_conf, coalesce(b.best_iou, 0.0) >= 0.5 AS reachable
  FROM truth t LEFT JOIN b ON t.image = b.image AND t.idx = b.g_idx LEFT JOIN pred p ON p.image = b.image AND p.idx = b.best_idx)"""
BEST_OVERLAP_PER_GT = f"WITH {_BEST_GT} SELECT image, idx, best_idx, round(best_iou, 6) AS best_iou, best_conf, reachable FROM best"


def max_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = views.preds(spark, sf_dir), views.truths(spark, sf_dir)
    return pairs.reachable_recall(pairs.best_per_gt(t, p, pairs.pred_gt(p, t), MATCH_IOU)).select("n_gt", "unreachable", F.round("max_recall", 6).alias("max_recall"))


MAX_RECALL = f"WITH {_BEST_GT} SELECT count(*) AS n_gt, count(*) FILTER (WHERE NOT reachable) AS unreachable, round(count(*) FILTER (WHERE reachable) / count(*)::DOUBLE, 6) AS max_recall FROM best"


def support_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.preds(spark, sf_dir)
    return pairs.supported(p, pairs.pred_pred(p), 0.5).select("image", "idx", "model", "conf")


SUPPORT_SEMI_JOIN = f"""WITH {views.INST} SELECT image, idx, model, conf FROM pred p WHERE EXISTS (
  SELECT 1 FROM near n WHERE n.image = p.image AND (n.a_idx = p.idx OR n.b_idx = p.idx) AND n.iou >= 0.5 AND n.a_model <> n.b_model)"""


def consensus_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.preds(spark, sf_dir)
    out = pairs.consensus(p, pairs.pred_pred(p), 0.5, 2)
    return out.select("image", "idx", F.col("support").cast("long").alias("support"), "representative", "score", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


CONSENSUS_MEMBERS = f"""WITH {views.INST}, m AS (
  SELECT image, a_idx AS idx, b_idx AS other FROM near WHERE iou >= 0.5 UNION ALL SELECT image, b_idx, a_idx FROM near WHERE iou >= 0.5 UNION ALL SELECT image, idx, idx FROM pred)
SELECT m.image, m.idx, count(DISTINCT p.model) AS support, arg_max(p.idx, (p.conf, -p.idx)) AS representative, max(p.conf) AS score, string_agg(p.idx::VARCHAR, ',' ORDER BY p.idx) AS members
FROM m JOIN pred p ON p.image = m.image AND p.idx = m.other GROUP BY m.image, m.idx HAVING count(DISTINCT p.model) >= 2"""


def mask_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nms(views.image_rows(spark, sf_dir, CONF), NMS_IOU, CONF)


#: Ranked predictions over the confidence floor; earlier ones each overlaps by more than the threshold; recursion over ranks.
_NMS = f"""{views.INST}, sel AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, idx) AS rank FROM pred WHERE conf >= {CONF}),
bad AS (SELECT image, rank, list(other) AS others FROM (
  SELECT n.image, greatest(a.rank, b.rank) AS rank, least(a.rank, b.rank) AS other FROM near n JOIN sel a ON a.image = n.image AND a.idx = n.a_idx JOIN sel b ON b.image = n.image AND b.idx = n.b_idx WHERE n.iou > {NMS_IOU}) GROUP BY image, rank),
step AS (SELECT sel.image, sel.rank, coalesce(bad.others, []::BIGINT[]) AS others FROM sel LEFT JOIN bad ON bad.image = sel.image AND bad.rank = sel.rank),
walk(image, rank, kept) AS (
  SELECT image, rank, [rank] FROM step WHERE rank = 1
  UNION ALL SELECT s.image, s.rank, CASE WHEN list_has_any(w.kept, s.others) THEN w.kept ELSE list_append(w.kept, s.rank) END FROM walk w JOIN step s ON s.image = w.image AND s.rank = w.rank + 1),
kept AS (SELECT image, unnest(kept) AS rank FROM (SELECT image, kept FROM walk QUALIFY row_number() OVER (PARTITION BY image ORDER BY rank DESC) = 1))"""
MASK_NMS = f"WITH RECURSIVE {_NMS} SELECT sel.image, sel.idx, sel.conf FROM kept JOIN sel ON sel.image = kept.image AND sel.rank = kept.rank"


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(views.image_rows(spark, sf_dir, CONF), MATCH_IOU, CONF).select("image", "idx", "gt", F.round("iou", 6).alias("iou"))


GREEDY_MATCH = f"""WITH RECURSIVE {views.INST}, sel AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, idx) AS rank FROM pred WHERE conf >= {CONF}),
cand AS (SELECT image, p_idx, list({{'g': g_idx, 'iou': iou}} ORDER BY iou DESC, g_idx) AS gs FROM pair WHERE iou > 0 GROUP BY image, p_idx),
step AS (SELECT sel.image, sel.rank, sel.idx, coalesce(cand.gs, []) AS gs FROM sel LEFT JOIN cand ON cand.image = sel.image AND cand.p_idx = sel.idx),
walk(image, rank, idx, used, gt, iou) AS (
  SELECT image, rank, idx, CASE WHEN len(gs) > 0 AND gs[1].iou >= {MATCH_IOU} THEN [gs[1].g] ELSE []::INT[] END, CASE WHEN len(gs) > 0 AND gs[1].iou >= {MATCH_IOU} THEN gs[1].g ELSE -1 END, CASE WHEN len(gs) > 0 AND gs[1].iou >= {MATCH_IOU} THEN gs[1].iou ELSE 0.0 END FROM step WHERE rank = 1
  UNION ALL SELECT image, rank, idx, CASE WHEN f.iou >= {MATCH_IOU} THEN list_append(used, f.g) ELSE used END, CASE WHEN f.iou >= {MATCH_IOU} THEN f.g ELSE -1 END, CASE WHEN f.iou >= {MATCH_IOU} THEN f.iou ELSE 0.0 END FROM (
    SELECT s.image, s.rank, s.idx, w.used, list_filter(s.gs, lambda z: NOT list_contains(w.used, z.g))[1] AS f FROM walk w JOIN step s ON s.image = w.image AND s.rank = w.rank + 1))
SELECT image, idx, gt, round(iou, 6) AS iou FROM walk"""


def grid(spark: SparkSession) -> DataFrame:
    rows = [(c, n, a, -1.0) for c in GRID_CONF for n in GRID_NMS for a in GRID_AREA]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_seq int, conf double, nms_iou double, min_area double, min_edge double")


def grid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_rates(matching.evaluated_totals(views.image_rows(spark, sf_dir, min(GRID_CONF)), grid(spark), ["grid_seq", "conf", "nms_iou", "min_area"], MATCH_IOU))


def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: parse, overlap joins, suppression and matching under every setting, totals and rates."""
    out = grid_totals(spark, sf_dir)
    return out.select("grid_seq", "conf", "nms_iou", "min_area", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


_GRID = f"""{views.INST}, grid AS (SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS grid_seq, {list(GRID_CONF)}[i] AS conf, {list(GRID_NMS)}[j] AS nms_iou, {list(GRID_AREA)}[k] AS min_area FROM range(1, {len(GRID_CONF) + 1}) a(i), range(1, {len(GRID_NMS) + 1}) b(j), range(1, {len(GRID_AREA) + 1}) c(k)),
sel AS (SELECT g.grid_seq, g.nms_iou, p.*, row_number() OVER (PARTITION BY g.grid_seq, p.image ORDER BY p.conf DESC, p.idx) AS rank FROM pred p, grid g WHERE p.conf >= g.conf::DOUBLE AND p.area >= g.min_area::DOUBLE),
bad AS (SELECT grid_seq, image, rank, list(other) AS others FROM (
  SELECT a.grid_seq, n.image, greatest(a.rank, b.rank) AS rank, least(a.rank, b.rank) AS other FROM near n JOIN sel a ON a.image = n.image AND a.idx = n.a_idx JOIN sel b ON b.image = n.image AND b.idx = n.b_idx AND b.grid_seq = a.grid_seq WHERE n.iou > a.nms_iou::DOUBLE) GROUP BY grid_seq, image, rank),
cand AS (SELECT image, p_idx, list({{'g': g_idx, 'iou': iou}} ORDER BY iou DESC, g_idx) AS gs FROM pair WHERE iou > 0 GROUP BY image, p_idx),
step AS (SELECT sel.grid_seq, sel.image, sel.rank, coalesce(bad.others, []::BIGINT[]) AS others, coalesce(cand.gs, []) AS gs FROM sel LEFT JOIN bad ON bad.grid_seq = sel.grid_seq AND bad.image = sel.image AND bad.rank = sel.rank LEFT JOIN cand ON cand.image = sel.image AND cand.p_idx = sel.idx),
walk(grid_seq, image, rank, kept, used) AS (
  SELECT grid_seq, image, rank, [rank], CASE WHEN len(gs) > 0 AND gs[1].iou >= {MATCH_IOU} THEN [gs[1].g] ELSE []::INT[] END FROM step WHERE rank = 1
  UNION ALL SELECT grid_seq, image, rank, CASE WHEN hit THEN kept ELSE list_append(kept, rank) END, CASE WHEN NOT hit AND f.iou >= {MATCH_IOU} THEN list_append(used, f.g) ELSE used END FROM (
    SELECT s.grid_seq, s.image, s.rank, w.kept, w.used, list_has_any(w.kept, s.others) AS hit, list_filter(s.gs, lambda z: NOT list_contains(w.used, z.g))[1] AS f FROM walk w JOIN step s ON s.grid_seq = w.grid_seq AND s.image = w.image AND s.rank = w.rank + 1)),
last AS (SELECT grid_seq, image, len(kept) AS n_kept, len(used) AS tp FROM walk QUALIFY row_number() OVER (PARTITION BY grid_seq, image ORDER BY rank DESC) = 1),
sums AS (SELECT g.grid_seq, g.conf::DOUBLE AS conf, g.nms_iou::DOUBLE AS nms_iou, g.min_area::DOUBLE AS min_area, coalesce(sum(tp), 0)::BIGINT AS tp, (coalesce(sum(n_kept), 0) - coalesce(sum(tp), 0))::BIGINT AS fp, ((SELECT count(*) FROM truth) - coalesce(sum(tp), 0))::BIGINT AS fn FROM grid g LEFT JOIN last l ON l.grid_seq = g.grid_seq GROUP BY ALL),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE ELSE 0 END AS accuracy FROM sums),
full_ AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates)"""
GRID_METRICS = f"WITH RECURSIVE {_GRID} SELECT grid_seq, conf, nms_iou, min_area, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM full_"


def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.four_selections(grid_totals(spark, sf_dir), 0.2, 0.1)
    return out.select("selection", "grid_seq", "conf", "nms_iou", "min_area", "tp", "fp", "fn")


BEST_CONFIG = f"""WITH RECURSIVE {_GRID}
SELECT * FROM (SELECT 'best_f1' AS selection, grid_seq, conf, nms_iou, min_area, tp, fp, fn FROM full_ ORDER BY f1 DESC, recall DESC, precision DESC, grid_seq LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'best_target', grid_seq, conf, nms_iou, min_area, tp, fp, fn FROM full_ WHERE precision >= 0.2 AND recall >= 0.1 ORDER BY f1 DESC, recall DESC, grid_seq LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'best_recall', grid_seq, conf, nms_iou, min_area, tp, fp, fn FROM full_ WHERE precision >= 0.2 ORDER BY recall DESC, f1 DESC, grid_seq LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'best_precision', grid_seq, conf, nms_iou, min_area, tp, fp, fn FROM full_ WHERE recall >= 0.1 ORDER BY precision DESC, f1 DESC, grid_seq LIMIT 1)"""


def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([(0.1, 0.2, 0.0, -1.0)], "conf double, nms_iou double, min_area double, min_edge double")
    out = metrics.by_source(matching.evaluated(views.image_rows(spark, sf_dir, 0.1), one, MATCH_IOU))
    return out.select("source", "images", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "fp_ppm", "fn_ppm")


SOURCE_METRICS = f"""WITH RECURSIVE {_GRID}, im AS (SELECT DISTINCT image, source FROM inst), n AS (SELECT image, count(*) AS n_gt FROM truth GROUP BY image),
s AS (SELECT im.source, count(*) AS images, coalesce(sum(tp), 0)::BIGINT AS tp, (coalesce(sum(n_kept), 0) - coalesce(sum(tp), 0))::BIGINT AS fp, (coalesce(sum(n_gt), 0) - coalesce(sum(tp), 0))::BIGINT AS fn FROM im LEFT JOIN (SELECT * FROM last WHERE grid_seq = 0) l ON l.image = im.image LEFT JOIN n ON n.image = im.image GROUP BY im.source)
SELECT source, images, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round_even(1000000.0::DOUBLE * fp / images, 0)::BIGINT AS fp_ppm, round_even(1000000.0::DOUBLE * fn / images, 0)::BIGINT AS fn_ppm FROM s"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unmatched prediction (FP) and truth (FN): image, source, type, idx, best partner, cause of a miss."""
    return curate.errors(views.image_rows(spark, sf_dir, form=matching.with_truths), CONF, MATCH_IOU, ERROR_AREA)


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(spark, sf_dir).select("image", "source", "type", "idx", "best_idx", F.round("best_iou", 6).alias("best_iou"), "cause")


_ERRORS = GREEDY_MATCH[: GREEDY_MATCH.rindex("SELECT image, idx, gt")] + f""", bp AS (SELECT image, p_idx, arg_max(g_idx, (iou, -g_idx)) AS best_idx, max(iou) AS best_iou FROM pair WHERE iou > 0 GROUP BY image, p_idx),
bg AS (SELECT image, g_idx, arg_max(p_idx, (iou, -p_idx)) AS best_idx, max(iou) AS best_iou FROM pair WHERE iou > 0 GROUP BY image, g_idx),
err AS (
  SELECT w.image, p.source, 'FP' AS type, w.idx, coalesce(bp.best_idx, -1) AS best_idx, coalesce(bp.best_iou, 0.0) AS best_iou, '' AS cause FROM walk w JOIN pred p ON p.image = w.image AND p.idx = w.idx LEFT JOIN bp ON bp.image = w.image AND bp.p_idx = w.idx WHERE w.gt < 0
  UNION ALL SELECT t.image, t.source, 'FN', t.idx, coalesce(bg.best_idx, -1), coalesce(bg.best_iou, 0.0), CASE WHEN coalesce(bg.best_iou, 0.0) >= 0.5 AND p.conf < {CONF} THEN '{curate.CAUSES[0]}' WHEN coalesce(bg.best_iou, 0.0) >= 0.5 AND p.area < {ERROR_AREA} THEN '{curate.CAUSES[1]}' ELSE '{curate.CAUSES[2]}' END
  FROM truth t LEFT JOIN bg ON bg.image = t.image AND bg.g_idx = t.idx LEFT JOIN pred p ON p.image = bg.image AND p.idx = bg.best_idx WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.image = t.image AND w.gt = t.idx))"""
ERROR_TABLE = _ERRORS + " SELECT image, source, type, idx, best_idx, round(best_iou, 6) AS best_iou, cause FROM err"


def error_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_pivot(errors(spark, sf_dir))


ERROR_PIVOT = _ERRORS + " SELECT source, count(*) FILTER (WHERE type = 'FP') AS FP, count(*) FILTER (WHERE type = 'FN') AS FN FROM err GROUP BY source"


def max_cardinality_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.maximum_tp(views.image_rows(spark, sf_dir, form=matching.with_truths), MATCH_IOU)


def matching_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matching_curve(views.image_rows(spark, sf_dir, form=matching.with_truths), MATCH_IOU)


#: The thresholds over which average precision is averaged.
COCO_STEPS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def coco_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threshold, ap, ar with at most 100 predictions an image."""
    rows = views.image_rows(spark, sf_dir).persist()
    steps = spark.createDataFrame([(t,) for t in COCO_STEPS], "threshold double")
    n = rows.agg(F.sum("n_gt")).first()[0] or 0
    hits = matching.coco_matches(rows, steps)
    return metrics.average_precisions(hits, n).select("threshold", F.round("ap", 6).alias("ap"), F.round("ar", 6).alias("ar"))


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.precision_recall(views.scored(spark, sf_dir))
    return out.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_CURVE = f"""{views.SCORED}, e AS (SELECT score, sum(target) AS hits, count(*) AS n FROM scored GROUP BY score),
c AS (SELECT score AS threshold, (sum(hits) OVER w)::BIGINT AS tp, (sum(n) OVER w - sum(hits) OVER w)::BIGINT AS fp, (sum(hits) OVER () - sum(hits) OVER w)::BIGINT AS fn FROM e WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM c), curve AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""
PR_CURVE = f"WITH {_CURVE} SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve"


def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.best(metrics.precision_recall(views.scored(spark, sf_dir)).withColumn("minus", -F.col("threshold")), ["f1", "recall"], "minus")
    return metrics.acceptance(out).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "p90_r90", "p95_r90")


BEST_F1 = f"WITH {_CURVE} SELECT round(threshold, 6) AS threshold, tp, fp, fn, precision >= 0.9 AND recall >= 0.9 AS p90_r90, precision >= 0.95 AND recall >= 0.9 AS p95_r90 FROM curve ORDER BY f1 DESC, recall DESC, threshold DESC LIMIT 1"


def ap_101(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(metrics.precision_recall(views.scored(spark, sf_dir))).select(F.round("ap", 6).alias("ap"))


AP_101 = f"WITH {_CURVE} SELECT round(avg(coalesce((SELECT max(precision) FROM curve WHERE tp > 0 AND floor(recall * 100 + 1e-9) >= k), 0)), 6) AS ap FROM range(0, 101) g(k)"


def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.top_k(views.preds(spark, sf_dir), 3).select("image", "idx", "conf", F.col("rank").cast("long").alias("rank"))


TOPK_CANDIDATES = f"WITH {views.INST} SELECT image, idx, conf, row_number() OVER (PARTITION BY image ORDER BY conf DESC, idx) AS rank FROM pred QUALIFY rank <= 3"


def conf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.worst_rank(views.preds(spark, sf_dir)).select("image", "idx", "conf_rank")


CONF_RANK = f"WITH {views.INST} SELECT image, idx, count(*) OVER (PARTITION BY image ORDER BY conf DESC) AS conf_rank FROM pred"

_WITH_SQL = {
    "polygon_area_bbox_edge": (polygon_measures, POLYGON_MEASURES), "pixel_boxes": (pixel_boxes, PIXEL_BOXES), "rect_iou_pairs": (iou_pairs, IOU_PAIRS),
    "best_overlap_per_gt": (best_overlap_per_gt, BEST_OVERLAP_PER_GT), "max_reachable_recall": (max_recall, MAX_RECALL), "support_semi_join": (support_semi_join, SUPPORT_SEMI_JOIN),
    "consensus_members": (consensus_members, CONSENSUS_MEMBERS), "mask_nms": (mask_nms, MASK_NMS), "greedy_match": (greedy_match, GREEDY_MATCH), "grid_metrics": (grid_metrics, GRID_METRICS),
    "best_config": (best_config, BEST_CONFIG), "source_metrics": (source_metrics, SOURCE_METRICS), "error_table": (error_table, ERROR_TABLE), "error_pivot": (error_pivot, ERROR_PIVOT),
    "pr_curve": (pr_curve, PR_CURVE), "best_f1": (best_f1, BEST_F1), "ap_101": (ap_101, AP_101), "topk_candidates": (topk_candidates, TOPK_CANDIDATES), "conf_rank": (conf_rank, CONF_RANK),
}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()} | {"max_cardinality_match": max_cardinality_match, "matching_curve": matching_curve, "coco_ap": coco_ap}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
