"""Queries on grids of areas and of consensus settings, worst images, limits and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import consensus, matching, metrics, pairs
from . import views

CONF, MATCH_IOU = 0.2, 0.5
SWEEP_MIN, SWEEP_MAX, SWEEP_CONF = (0.0, 0.1, 0.3), (0.2, 1.0), (0.1, 0.5)
TOP, TOP_AREA = 3, 0.2
#: A support of more models than there are is skipped.
MODELS = 3
AGREE_CONF, AGREE_AREA, AGREE_SUPPORT, AGREE_IOU, AGREE_NMS = (0.1, 0.4), (0.0, 0.1), (1, 2, 4), (0.3, 0.5), (0.3, 0.6)

_RATES = """rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM sums),
full_ AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates)"""
#: Truths of each prediction by falling IoU; over settings with a rank, the truths that are used after each.
_CAND = "cand AS (SELECT image, p_idx, list({'g': g_idx, 'iou': iou} ORDER BY iou DESC, g_idx) AS gs FROM pair WHERE iou > 0 GROUP BY image, p_idx)"


def _used(before: str) -> str:
    return f"CASE WHEN f.iou >= {MATCH_IOU} THEN list_append({before}, f.g) ELSE {before} END"


_FIRST = f"CASE WHEN len(gs) > 0 AND gs[1].iou >= {MATCH_IOU} THEN [gs[1].g] ELSE []::INT[] END"
_FREE = "list_filter(s.gs, lambda z: NOT list_contains(w.used, z.g))[1] AS f"


def _counts(df: DataFrame) -> list:
    return ["tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1"))]


def area_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b, c) for a in SWEEP_MIN for b in SWEEP_MAX if a <= b for c in SWEEP_CONF]
    grid = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_seq int, min_area double, max_area double, conf double")
    out = metrics.totals(matching.swept(views.image_rows(spark, sf_dir, min(SWEEP_CONF)), grid, MATCH_IOU), ["grid_seq", "min_area", "max_area", "conf"])
    return out.select("grid_seq", "min_area", "max_area", "conf", *_counts(out))


AREA_THRESHOLD_GRID = f"""WITH RECURSIVE {views.INST}, {_CAND},
grid AS (SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS grid_seq, {list(SWEEP_MIN)}[i]::DOUBLE AS min_area, {list(SWEEP_MAX)}[j]::DOUBLE AS max_area, {list(SWEEP_CONF)}[k]::DOUBLE AS conf FROM range(1, {len(SWEEP_MIN) + 1}) a(i), range(1, {len(SWEEP_MAX) + 1}) b(j), range(1, {len(SWEEP_CONF) + 1}) c(k) WHERE {list(SWEEP_MIN)}[i] <= {list(SWEEP_MAX)}[j]),
step AS (SELECT g.grid_seq, p.image, row_number() OVER (PARTITION BY g.grid_seq, p.image ORDER BY p.conf DESC, p.idx) AS rank, coalesce(cand.gs, []) AS gs FROM pred p JOIN grid g ON p.conf >= g.conf AND p.area >= g.min_area AND p.area <= g.max_area LEFT JOIN cand ON cand.image = p.image AND cand.p_idx = p.idx),
walk(grid_seq, image, rank, used) AS (
  SELECT grid_seq, image, rank, {_FIRST} FROM step WHERE rank = 1
  UNION ALL SELECT grid_seq, image, rank, {_used("used")} FROM (SELECT s.grid_seq, s.image, s.rank, w.used, {_FREE} FROM walk w JOIN step s ON s.grid_seq = w.grid_seq AND s.image = w.image AND s.rank = w.rank + 1)),
last AS (SELECT grid_seq, image, rank AS n_kept, len(used) AS tp FROM walk QUALIFY row_number() OVER (PARTITION BY grid_seq, image ORDER BY rank DESC) = 1),
sums AS (SELECT g.*, coalesce(sum(tp), 0)::BIGINT AS tp, (coalesce(sum(n_kept), 0) - coalesce(sum(tp), 0))::BIGINT AS fp, ((SELECT count(*) FROM truth) - coalesce(sum(tp), 0))::BIGINT AS fn FROM grid g LEFT JOIN last l ON l.grid_seq = g.grid_seq GROUP BY ALL), {_RATES}
SELECT grid_seq, min_area, max_area, conf, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_"""


def consensus_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, a, k, s, n) for c in AGREE_CONF for a in AGREE_AREA for k in AGREE_SUPPORT if k <= MODELS for s in AGREE_IOU for n in AGREE_NMS]
    grid = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_seq int, conf double, min_area double, min_support int, support_iou double, nms_iou double")
    out = metrics.with_rates(consensus.evaluated_totals(views.image_rows(spark, sf_dir, min(AGREE_CONF), consensus.of_lists), grid, ["grid_seq", "conf", "min_area", "min_support", "support_iou", "nms_iou"], MATCH_IOU))
    return out.select("grid_seq", "conf", "min_area", "min_support", "support_iou", "nms_iou", *_counts(out))


_AXES = {"conf": AGREE_CONF, "min_area": AGREE_AREA, "min_support": AGREE_SUPPORT, "support_iou": AGREE_IOU, "nms_iou": AGREE_NMS}
CONSENSUS_GRID = f"""WITH RECURSIVE {views.INST}, {_CAND},
grid AS (SELECT row_number() OVER (ORDER BY {", ".join(f"i_{c}" for c in _AXES)}) - 1 AS grid_seq, {", ".join(f"{list(v)}[i_{c}]::{'INT' if c == 'min_support' else 'DOUBLE'} AS {c}" for c, v in _AXES.items())} FROM {", ".join(f"range(1, {len(v) + 1}) r_{c}(i_{c})" for c, v in _AXES.items())} WHERE {list(AGREE_SUPPORT)}[i_min_support] <= {MODELS}),
both_ AS (SELECT image, a_idx AS idx, b_idx AS other, iou FROM near UNION ALL SELECT image, b_idx, a_idx, iou FROM near UNION ALL SELECT image, idx, idx, 1.0 FROM pred),
sel AS (SELECT g.*, p.image, p.idx, p.model, p.conf AS own FROM pred p JOIN grid g ON p.conf >= g.conf AND p.area >= g.min_area),
seed AS (SELECT a.grid_seq, a.image, a.idx AS seed, a.min_support, a.nms_iou, count(DISTINCT b.model) AS support, arg_max(b.idx, (b.own, -b.idx)) AS idx, max(b.own) AS score FROM sel a JOIN both_ m ON m.image = a.image AND m.idx = a.idx AND m.iou >= a.support_iou JOIN sel b ON b.grid_seq = a.grid_seq AND b.image = a.image AND b.idx = m.other GROUP BY ALL),
enough AS (SELECT *, row_number() OVER (PARTITION BY grid_seq, image ORDER BY score DESC, seed) AS rank FROM seed WHERE support >= min_support),
bad AS (SELECT a.grid_seq, a.image, a.rank, list(b.rank) AS others FROM enough a JOIN both_ m ON m.image = a.image AND m.idx = a.idx AND m.iou > a.nms_iou JOIN enough b ON b.grid_seq = a.grid_seq AND b.image = a.image AND b.idx = m.other AND b.rank < a.rank GROUP BY ALL),
step AS (SELECT e.grid_seq, e.image, e.rank, coalesce(bad.others, []::BIGINT[]) AS others, coalesce(cand.gs, []) AS gs FROM enough e LEFT JOIN bad ON bad.grid_seq = e.grid_seq AND bad.image = e.image AND bad.rank = e.rank LEFT JOIN cand ON cand.image = e.image AND cand.p_idx = e.idx),
walk(grid_seq, image, rank, kept, used) AS (
  SELECT grid_seq, image, rank, [rank], {_FIRST} FROM step WHERE rank = 1
  UNION ALL SELECT grid_seq, image, rank, CASE WHEN hit THEN kept ELSE list_append(kept, rank) END, CASE WHEN hit THEN used ELSE {_used("used")} END FROM (SELECT s.grid_seq, s.image, s.rank, w.kept, w.used, list_has_any(w.kept, s.others) AS hit, {_FREE} FROM walk w JOIN step s ON s.grid_seq = w.grid_seq AND s.image = w.image AND s.rank = w.rank + 1)),
last AS (SELECT grid_seq, image, len(kept) AS n_kept, len(used) AS tp FROM walk QUALIFY row_number() OVER (PARTITION BY grid_seq, image ORDER BY rank DESC) = 1),
sums AS (SELECT g.*, coalesce(sum(tp), 0)::BIGINT AS tp, (coalesce(sum(n_kept), 0) - coalesce(sum(tp), 0))::BIGINT AS fp, ((SELECT count(*) FROM truth) - coalesce(sum(tp), 0))::BIGINT AS fn FROM grid g LEFT JOIN last l ON l.grid_seq = g.grid_seq GROUP BY ALL), {_RATES}
SELECT grid_seq, conf, min_area, min_support, support_iou, nms_iou, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_"""


def _at_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([(CONF, 0.0, 1e9)], "conf double, min_area double, max_area double")
    return matching.swept(views.image_rows(spark, sf_dir, CONF), one, MATCH_IOU)


#: Per image at one confidence: n_gt, n_kept, tp.
_AT_CONF = f"""{views.INST}, {_CAND},
step AS (SELECT p.image, row_number() OVER (PARTITION BY p.image ORDER BY p.conf DESC, p.idx) AS rank, coalesce(cand.gs, []) AS gs FROM pred p LEFT JOIN cand ON cand.image = p.image AND cand.p_idx = p.idx WHERE p.conf >= {CONF}),
walk(image, rank, used) AS (
  SELECT image, rank, {_FIRST} FROM step WHERE rank = 1
  UNION ALL SELECT image, rank, {_used("used")} FROM (SELECT s.image, s.rank, w.used, {_FREE} FROM walk w JOIN step s ON s.image = w.image AND s.rank = w.rank + 1)),
last AS (SELECT image, rank AS n_kept, len(used) AS tp FROM walk QUALIFY row_number() OVER (PARTITION BY image ORDER BY rank DESC) = 1),
img AS (SELECT i.image, i.source, coalesce(n.n_gt, 0) AS n_gt, coalesce(l.n_kept, 0) AS n_kept, coalesce(l.tp, 0) AS tp FROM (SELECT DISTINCT image, source FROM inst) i LEFT JOIN (SELECT image, count(*) AS n_gt FROM truth GROUP BY image) n ON n.image = i.image LEFT JOIN last l ON l.image = i.image)"""


def worst_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worst_first(_at_conf(spark, sf_dir)).select("image", "source", "n_gt", "tp", "fp", "fn")


WORST_IMAGES = f"WITH RECURSIVE {_AT_CONF} SELECT image, source, n_gt, tp, n_kept - tp AS fp, n_gt - tp AS fn FROM img ORDER BY fn DESC, fp DESC, n_gt DESC, image"


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("image") % 10 == 8, "val").when(F.col("image") % 10 == 9, "test").otherwise("train")
    out = metrics.candidate_summary(_at_conf(spark, sf_dir).withColumn("split", split), ["split", "source"])
    return out.select("split", F.when(F.col("whole"), "*").otherwise(F.col("source")).alias("source"), "images", "gt", "candidates", "positives", "negatives")


CANDIDATE_SUMMARY = f"""WITH RECURSIVE {_AT_CONF}, s AS (SELECT *, CASE image % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM img)
SELECT split, coalesce(source, '*') AS source, count(*) AS images, sum(n_gt)::BIGINT AS gt, sum(n_kept)::BIGINT AS candidates, sum(tp)::BIGINT AS positives, sum(n_kept - tp)::BIGINT AS negatives FROM s GROUP BY GROUPING SETS ((split), (split, source))"""


def topk_then_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.top_k_then_area(views.preds(spark, sf_dir), TOP, TOP_AREA).select("image", "idx", "conf", F.col("rank").cast("long").alias("rank"))


_TOP = f"{views.INST}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, idx) AS rank FROM pred)"
TOPK_THEN_AREA = f"WITH {_TOP} SELECT image, idx, conf, rank FROM r WHERE rank <= {TOP} AND area >= {TOP_AREA}"


def topk_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.top_k_losses(views.preds(spark, sf_dir), TOP, TOP_AREA)


TOPK_LOSSES = f"""WITH {_TOP} SELECT image, count(*) AS found, count(*) FILTER (WHERE rank > {TOP}) AS truncated, count(*) FILTER (WHERE rank <= {TOP} AND area < {TOP_AREA}) AS filtered_by_area, count(*) FILTER (WHERE rank <= {TOP} AND area >= {TOP_AREA}) AS kept FROM r GROUP BY image"""


def latency_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.latency_by(views.table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("average", 6).alias("average"), F.round("peak", 6).alias("peak"))


LATENCY_BY_KIND = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS average, round(max(value), 6) AS peak FROM events GROUP BY event_type"

_WITH_SQL = {
    "area_threshold_grid": (area_threshold_grid, AREA_THRESHOLD_GRID), "consensus_grid": (consensus_grid, CONSENSUS_GRID), "worst_images": (worst_images, WORST_IMAGES), "candidate_summary": (candidate_summary, CANDIDATE_SUMMARY),
    "topk_then_area": (topk_then_area, TOPK_THEN_AREA), "topk_losses": (topk_losses, TOPK_LOSSES), "latency_by_kind": (latency_by_kind, LATENCY_BY_KIND),
}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
