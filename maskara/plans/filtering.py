"""Queries on the learned filter of candidates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import learned, masks, matching
from . import evaluation, masking, views

LEAST, MOST, MATCH_IOU = 0.05, 5, evaluation.MATCH_IOU
SOURCES = ("alpha", "beta", "gamma", "unknown")
#: A fit that SQL can follow: no hidden layer, few epochs at a high rate.
FIT = {"hidden": (), "epochs": 3, "rate": 0.1, "decay": 1e-4}
GRID = {"prob": (0.0, 0.45, 0.55), "conf": (0.05, 0.3), "nms_iou": (0.2, 0.5), "min_area": (0.0, 0.06)}


def _candidates(spark: SparkSession, sf_dir: str, images: str = "true") -> DataFrame:
    """Of those images, picked before their masks are drawn: a filter of later steps stays behind the drawing."""
    return learned.candidates(views.masked(spark, sf_dir, LEAST).filter(images), masks.looked_up, LEAST, MOST, MATCH_IOU, SOURCES)


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learned.flat(_candidates(spark, sf_dir))
    return rows.select("image", "idx", "label", *(F.round(F.get("x", F.lit(i)), 6).alias(c) for i, c in enumerate(learned.NAMES)), *(F.get("x", F.lit(len(learned.NAMES) + i)).alias(f"source_{s}") for i, s in enumerate(SOURCES)))


def filter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the images of the training split, the grid on those of the validation split."""
    network = learned.fit(learned.flat(_candidates(spark, sf_dir, "image % 10 < 8")), **FIT)
    settings = [(p, c, n, a) for p in GRID["prob"] for c in GRID["conf"] for n in GRID["nms_iou"] for a in GRID["min_area"]]
    grid = spark.createDataFrame([(i, *s) for i, s in enumerate(settings)], "grid_seq int, prob double, conf double, nms_iou double, min_area double")
    held = learned.scored(_candidates(spark, sf_dir, "image % 10 = 8"), network)
    out = matching.grid_totals(learned.evaluated_totals(held, grid, ["grid_seq", *GRID], MATCH_IOU), ["grid_seq", *GRID])
    return out.select("grid_seq", *GRID, "gt", "selected_predictions", "kept_predictions", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_WALK = evaluation.GREEDY_MATCH.replace(views.INST, views.MASK_INST).replace(f"WHERE conf >= {evaluation.CONF})", f"WHERE conf >= {LEAST} QUALIFY rank <= {MOST})").removeprefix("WITH RECURSIVE ")
_WALK = _WALK[: _WALK.rindex("SELECT image, idx, gt")]
_VALUES = [
    "conf", "ln(greatest(conf, 1e-6))", "area", "ln(greatest(area, 1e-8))", "w", "h", "w * h", "w / h", "area / greatest(w * h, 1e-6)", "cx", "cy", "edge", "around", "4 * pi() * area / greatest(around * around, 1e-9)", "8.0",
    "max_all", "max_higher", "n01", "n03", "h01", "h03", "n_all", "n_conf", *(f"(source = '{s}')::INT" for s in SOURCES[:-1]), f"(source NOT IN ({', '.join(repr(s) for s in SOURCES[:-1])}))::INT",
]
_FEATURES = f"""{_WALK}, both_sides AS (SELECT image, a_idx AS idx, b_idx AS other, iou FROM near UNION ALL SELECT image, b_idx, a_idx, iou FROM near),
lap AS (SELECT a.image, a.idx, max(iou) AS max_all, max(CASE WHEN b.conf > a.conf THEN iou END) AS max_higher, count(*) FILTER (WHERE iou >= 0.1) AS n01, count(*) FILTER (WHERE iou >= 0.3) AS n03, count(*) FILTER (WHERE b.conf > a.conf AND iou >= 0.1) AS h01, count(*) FILTER (WHERE b.conf > a.conf AND iou >= 0.3) AS h03
  FROM both_sides o JOIN sel a ON a.image = o.image AND a.idx = o.idx JOIN sel b ON b.image = o.image AND b.idx = o.other GROUP BY a.image, a.idx),
own AS (SELECT s.image, s.idx, s.rank AS conf_place, s.conf, s.area, s.edge, s.source, (s.x1 - s.x0) / 40.0::DOUBLE AS w, (s.y1 - s.y0) / 40.0::DOUBLE AS h, (4 * s.x0 + 4 * s.x1 + (c0 - c1 - c2 + c3) / {views.STEP}) / 320.0::DOUBLE AS cx, (4 * s.y0 + 4 * s.y1 + (c1 - c2 - c3 + c0) / {views.STEP}) / 320.0::DOUBLE AS cy,
    (2 * (s.x1 - s.x0) + 2 * (s.y1 - s.y0) + (sqrt(2) - 2) * (c0 + c1 + c2 + c3) / {views.STEP}) / 40 AS around, count(*) OVER (PARTITION BY s.image) AS n_all, count(*) OVER (PARTITION BY s.image ORDER BY s.conf DESC) AS n_conf
  FROM sel s JOIN cutted c ON c.image = s.image AND c.idx = s.idx),
feat AS (SELECT o.image, o.idx, (w_.gt >= 0)::INT AS label, o.conf, o.area, o.conf_place, [{", ".join(f"({v})::DOUBLE" for v in _VALUES)}] AS x
  FROM (SELECT o.*, coalesce(max_all, 0) AS max_all, coalesce(max_higher, 0) AS max_higher, coalesce(n01, 0) AS n01, coalesce(n03, 0) AS n03, coalesce(h01, 0) AS h01, coalesce(h03, 0) AS h03 FROM own o LEFT JOIN lap l ON l.image = o.image AND l.idx = o.idx) o JOIN walk w_ ON w_.image = o.image AND w_.idx = o.idx)"""
CANDIDATE_FEATURES = f"WITH RECURSIVE {_FEATURES} SELECT image, idx, label, {', '.join(f'round(x[{i + 1}], 6) AS {c}' for i, c in enumerate(learned.NAMES))}, {', '.join(f'x[{len(learned.NAMES) + 1 + i}] AS source_{s}' for i, s in enumerate(SOURCES))} FROM feat"

_W = len(_VALUES)
_R, _D = FIT["rate"], FIT["decay"]
_STEPS = "".join(
    f""",
grad{t} AS (SELECT j, sum(d * x[j]) / any_value(n) AS g FROM (SELECT x, n, unnest(range(1, {_W + 2})) AS j, CASE label WHEN 1 THEN -weight * (1 - p) ELSE p END AS d FROM (
    SELECT s.*, 1 / (1 + exp(-list_inner_product(s.x, (SELECT list(w ORDER BY j) FROM step{t - 1})))) AS p FROM learn s)) GROUP BY j),
step{t} AS (SELECT j, w * (1 - {_R} * {_D}::DOUBLE) - {_R}::DOUBLE * (m / (1 - 0.9::DOUBLE ** {t})) / (sqrt(v / (1 - 0.999::DOUBLE ** {t})) + 1e-8) AS w, m, v FROM (SELECT s.j, w, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v FROM step{t - 1} s JOIN grad{t} g ON g.j = s.j))"""
    for t in range(1, FIT["epochs"] + 1)
)
_FIT = f"""{_FEATURES}, scale AS (SELECT j, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END AS dev FROM (SELECT unnest(range(1, {_W + 1})) AS j, unnest(x) AS v FROM feat WHERE image % 10 < 8) GROUP BY j),
scales AS (SELECT list(mean ORDER BY j) AS mean, list(dev ORDER BY j) AS dev FROM scale),
std AS (SELECT image, idx, label, conf, area, conf_place, list_append(list_transform(range(1, {_W + 1}), lambda j: (x[j] - mean[j]) / dev[j]), 1.0) AS x FROM feat, scales),
learn AS (SELECT x, label, count(*) OVER () AS n, least(greatest((count(*) OVER () - sum(label) OVER ()) / greatest(sum(label) OVER (), 1)::DOUBLE, 1), 80) AS weight FROM std WHERE image % 10 < 8),
step0 AS (SELECT j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range(1, {_W + 2}) r(j)){_STEPS},
cand_ AS (SELECT image, idx, conf, area, conf_place, 1 / (1 + exp(-list_inner_product(x, (SELECT list(w ORDER BY j) FROM step{FIT["epochs"]})))) AS prob FROM std WHERE image % 10 = 8),
held AS (SELECT * FROM truth WHERE image % 10 = 8)"""
_G = masking._SQL
_G = _G[_G.index("grid AS (") :]
_G = f"""grid AS (SELECT row_number() OVER (ORDER BY {", ".join(f"i_{c}" for c in GRID)}) - 1 AS grid_seq, {", ".join(f"{list(v)}[i_{c}]::DOUBLE AS {c}" for c, v in GRID.items())} FROM {", ".join(f"range(1, {len(v) + 1}) r_{c}(i_{c})" for c, v in GRID.items())}),
sel_ AS (SELECT g.grid_seq, g.nms_iou, p.*, row_number() OVER (PARTITION BY g.grid_seq, p.image ORDER BY p.prob DESC, p.conf_place) AS rank FROM cand_ p, grid g WHERE p.conf >= g.conf AND p.area >= g.min_area AND p.prob >= g.prob),
""" + _G[_G.index("bad AS (") :].replace("JOIN sel ", "JOIN sel_ ").replace("FROM sel ", "FROM sel_ sel ").replace("cand AS (", "cand2 AS (").replace("JOIN cand ON", "JOIN cand2 cand ON").replace("step AS (", "steps AS (").replace("FROM step WHERE", "FROM steps WHERE").replace("JOIN step s", "JOIN steps s").replace("walk(", "walk2(").replace("FROM walk ", "FROM walk2 ").replace("FROM truth", "FROM held")
FILTER_GRID = f"WITH RECURSIVE {_FIT}, {_G} SELECT grid_seq, {', '.join(GRID)}, gt, selected_predictions, kept_predictions, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_"

_WITH_SQL = {"candidate_features": (candidate_features, CANDIDATE_FEATURES), "filter_grid": (filter_grid, FILTER_GRID)}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
