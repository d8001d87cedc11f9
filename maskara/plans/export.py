"""Queries on the export of two models' agreement and on the COCO summary of masks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import masks, matching, metrics, policy
from ..operators.order import cut
from . import evaluation, views

MODELS = ("A", "N")
#: Of one source the policy is the default.
POLICIES = [("alpha", 0.3, 0.05, 1, 0.35, 0.2), ("beta", 0.1, 0.0, 2, 0.2, 0.5), ("gamma", 0.05, 0.07, 2, 0.4, 0.3)]


def source_policy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(POLICIES, "source string, confidence_threshold double, min_area_ratio double, min_support int, support_iou_threshold double, nms_iou_threshold double")
    lists = matching.gathered(views.masked(spark, sf_dir), 0.0, "source", also=("points",))
    out = policy.exported(lists, table, masks.looked_up, MODELS)
    return out.select("image", "source", "selected_a", "selected_b", "candidates", "kept", "kept_a", "kept_b", "confidence_threshold", "min_support", "labels")


def source_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.export_summary(source_policy_export(spark, sf_dir))
    return out.select(F.when(F.col("whole"), "*").otherwise(F.col("source")).alias("source"), "images", "selected_a", "selected_b", "candidates", "kept", "kept_a", "kept_b")


_D = policy.EXPORT_DEFAULT
_XY = [("x0 * 3 + c0", "y0 * 3"), ("x1 * 3 - c1", "y0 * 3"), ("x1 * 3", "y0 * 3 + c1"), ("x1 * 3", "y1 * 3 - c2"), ("x1 * 3 - c2", "y1 * 3"), ("x0 * 3 + c3", "y1 * 3"), ("x0 * 3", "y1 * 3 - c3"), ("x0 * 3", "y0 * 3 + c0")]
_LINE = "'0 ' || " + " || ' ' || ".join(f"printf('%.6f', ({v}) / 120.0::DOUBLE)" for xy in _XY for v in xy) + " || ' ' || printf('%.6f', conf) || chr(10)"
_EXPORT = f"""{views.MASK_INST}, pol AS (SELECT * FROM (VALUES {", ".join(map(str, POLICIES))}) AS t(source, ct, art, sup, st, nt)),
image AS (SELECT i.image, i.source, coalesce(ct, {_D["confidence_threshold"]})::DOUBLE AS ct, coalesce(art, {_D["min_area_ratio"]})::DOUBLE AS art, coalesce(sup, {_D["min_support"]}) AS sup, coalesce(st, {_D["support_iou_threshold"]})::DOUBLE AS st, coalesce(nt, {_D["nms_iou_threshold"]})::DOUBLE AS nt FROM (SELECT DISTINCT image, source FROM inst) i LEFT JOIN pol ON pol.source = i.source),
chosen AS (SELECT p.*, m.sup, m.st, m.nt FROM pred p JOIN image m ON m.image = p.image WHERE model IN {MODELS} AND conf >= ct AND p.area >= art),
sides AS (SELECT image, a_idx AS idx, b_idx AS other, iou FROM near UNION ALL SELECT image, b_idx, a_idx, iou FROM near),
backed AS (SELECT * FROM chosen c WHERE sup <> 2 OR EXISTS (SELECT 1 FROM sides s JOIN chosen o ON o.image = s.image AND o.idx = s.other WHERE s.image = c.image AND s.idx = c.idx AND s.iou >= c.st AND o.model <> c.model)),
sel AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, model <> '{MODELS[0]}', idx) AS rank FROM backed),
bad AS (SELECT a.image, a.rank, list(b.rank) AS others FROM sides s JOIN sel a ON a.image = s.image AND a.idx = s.idx JOIN sel b ON b.image = s.image AND b.idx = s.other AND b.rank < a.rank WHERE s.iou > a.nt GROUP BY a.image, a.rank),
step AS (SELECT sel.image, sel.rank, coalesce(bad.others, []::BIGINT[]) AS others FROM sel LEFT JOIN bad ON bad.image = sel.image AND bad.rank = sel.rank),
walk(image, rank, kept) AS (
  SELECT image, rank, [rank] FROM step WHERE rank = 1
  UNION ALL SELECT s.image, s.rank, CASE WHEN list_has_any(w.kept, s.others) THEN w.kept ELSE list_append(w.kept, s.rank) END FROM walk w JOIN step s ON s.image = w.image AND s.rank = w.rank + 1),
kept AS (SELECT image, unnest(kept) AS rank FROM (SELECT image, kept FROM walk QUALIFY row_number() OVER (PARTITION BY image ORDER BY rank DESC) = 1)),
line AS (SELECT s.image, s.rank, s.model, {_LINE} AS text FROM (SELECT s.*, c0, c1, c2, c3 FROM sel s JOIN kept k ON k.image = s.image AND k.rank = s.rank JOIN cutted c ON c.image = s.image AND c.idx = s.idx) s),
export AS (SELECT i.image, i.source, coalesce(c.a, 0) AS selected_a, coalesce(c.b, 0) AS selected_b, coalesce(s.n, 0) AS candidates, coalesce(k.n, 0) AS kept, coalesce(k.a, 0) AS kept_a, coalesce(k.b, 0) AS kept_b, i.ct AS confidence_threshold, i.sup AS min_support, coalesce(k.labels, '') AS labels FROM image i
  LEFT JOIN (SELECT image, count(*) FILTER (WHERE model = '{MODELS[0]}') AS a, count(*) FILTER (WHERE model = '{MODELS[1]}') AS b FROM chosen GROUP BY image) c ON c.image = i.image LEFT JOIN (SELECT image, count(*) AS n FROM sel GROUP BY image) s ON s.image = i.image
  LEFT JOIN (SELECT image, count(*) AS n, count(*) FILTER (WHERE model = '{MODELS[0]}') AS a, count(*) FILTER (WHERE model = '{MODELS[1]}') AS b, string_agg(text, '' ORDER BY rank) AS labels FROM line GROUP BY image) k ON k.image = i.image)"""
SOURCE_POLICY_EXPORT = f"WITH RECURSIVE {_EXPORT} SELECT * FROM export"
SOURCE_POLICY_SUMMARY = f"WITH RECURSIVE {_EXPORT} SELECT coalesce(source, '*') AS source, count(*) AS images, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('selected_a', 'selected_b', 'candidates', 'kept', 'kept_a', 'kept_b'))} FROM export GROUP BY ROLLUP (source)"

STEPS = evaluation.COCO_STEPS


def coco_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP over all thresholds, at 0.5 and 0.75, and AR with 1, 10 and 100 detections, of masks."""
    rows = cut(views.mask_rows(spark, sf_dir).select("image", "n_gt", "preds"))
    out = metrics.coco_summary_of(cut(matching.coco_hits_of(rows, STEPS)), rows.agg(F.sum("n_gt")).first()[0] or 0, STEPS)
    return out.select(*(F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75", "ar1", "ar10", "ar100")))


_USED = "CASE WHEN f.g IS NULL THEN used ELSE list_append(used, f.g) END"
COCO_SUMMARY = f"""WITH RECURSIVE {views.MASK_INST}, thr AS (SELECT unnest({list(STEPS)})::DOUBLE AS t), recalls AS (SELECT unnest({list(metrics.RECALLS)})::DOUBLE AS r),
cand AS (SELECT image, p_idx, list({{'g': g_idx, 'iou': iou}} ORDER BY iou DESC, g_idx DESC) AS gs FROM pair WHERE iou > 0 GROUP BY image, p_idx),
step AS (SELECT t, p.image, p.conf, row_number() OVER (PARTITION BY t, p.image ORDER BY p.conf DESC, p.idx) AS rank, list_filter(coalesce(c.gs, []), lambda z: z.iou >= t) AS gs FROM pred p CROSS JOIN thr LEFT JOIN cand c ON c.image = p.image AND c.p_idx = p.idx),
walk(t, image, rank, conf, used, hit) AS (
  SELECT t, image, rank, conf, CASE WHEN len(gs) > 0 THEN [gs[1].g] ELSE []::INT[] END, len(gs) > 0 FROM step WHERE rank = 1
  UNION ALL SELECT t, image, rank, conf, {_USED}, f.g IS NOT NULL FROM (SELECT s.t, s.image, s.rank, s.conf, w.used, list_filter(s.gs, lambda z: NOT list_contains(w.used, z.g))[1] AS f FROM walk w JOIN step s ON s.t = w.t AND s.image = w.image AND s.rank = w.rank + 1)),
n AS (SELECT count(*)::DOUBLE AS n FROM truth),
curve AS (SELECT t, sum(hit::INT) OVER w AS tp, count(*) OVER w AS k FROM walk WINDOW w AS (PARTITION BY t ORDER BY conf DESC, image, rank ROWS UNBOUNDED PRECEDING)),
env AS (SELECT t, tp / n AS recall, max(tp / k::DOUBLE) AS p FROM curve, n WHERE tp > 0 GROUP BY t, tp / n),
ap AS (SELECT thr.t, avg(coalesce((SELECT max(p) FROM env WHERE env.t = thr.t AND env.recall >= r), 0)) AS ap FROM thr, recalls GROUP BY thr.t)
SELECT round((SELECT avg(ap) FROM ap), 6) AS ap, round((SELECT ap FROM ap WHERE t = 0.5::DOUBLE), 6) AS ap50, round((SELECT ap FROM ap WHERE t = 0.75::DOUBLE), 6) AS ap75, {', '.join(f"round((SELECT count(*) FROM walk WHERE hit AND rank <= {m}) / (SELECT n FROM n) / {len(STEPS)}, 6) AS ar{m}" for m in metrics.MOST_DETECTIONS)}"""

_WITH_SQL = {"source_policy_export": (source_policy_export, SOURCE_POLICY_EXPORT), "source_policy_summary": (source_policy_summary, SOURCE_POLICY_SUMMARY), "coco_summary": (coco_summary, COCO_SUMMARY)}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
