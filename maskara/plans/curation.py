"""Queries on validation, curation, features and frames, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import curate, features, frames, leakage, matching, metrics, policy, validate
from . import evaluation, views


def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_lines(views.label_lines(spark, sf_dir)).select("stem", "line", "severity", "code")


_ISSUES = f"""{views.INST}, {views.LINES}, w AS (SELECT *, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM line),
v AS (SELECT *, list_transform(w[2:], lambda x: try_cast(x AS DOUBLE)) AS xy, regexp_matches(coalesce(w[1], ''), '^[+-]?[0-9]+$') AS whole FROM w),
a AS (SELECT *, len(list_distinct(list_transform(range(0, len(xy) // 2), lambda i: [round(xy[2 * i + 1], 10), round(xy[2 * i + 2], 10)]))) AS points,
  abs(list_sum(list_transform(range(0, len(xy) // 2), lambda i: xy[2 * i + 1] * xy[(2 * i + 3) % len(xy) + 1] - xy[(2 * i + 2) % len(xy) + 1] * xy[2 * i + 2]))) / 2 AS area FROM v),
issue AS (SELECT stem, line, source, unnest(CASE
  WHEN trim(text) = '' THEN ['warning:blank_line'] WHEN len(w) < 7 THEN ['error:too_few_values'] WHEN len(w) % 2 = 0 THEN ['error:odd_coordinate_count'] WHEN NOT whole THEN ['error:invalid_class_id']
  WHEN list_bool_or(list_transform(xy, lambda x: x IS NULL)) THEN list_concat(CASE WHEN w[1] <> '0' THEN ['error:unexpected_class_id'] ELSE [] END, ['error:invalid_coordinate'])
  ELSE list_concat(CASE WHEN w[1] <> '0' THEN ['error:unexpected_class_id'] ELSE [] END, CASE WHEN list_min(xy) < 0 OR list_max(xy) > 1 THEN ['error:coordinate_out_of_range'] ELSE [] END,
    CASE WHEN points < 3 THEN ['error:too_few_unique_points'] ELSE [] END, CASE WHEN area <= 0 THEN ['error:zero_area_polygon'] WHEN area < 1e-6 THEN ['warning:tiny_polygon'] ELSE [] END) END) AS c FROM a)"""
VALIDATE_LINES = f"WITH {_ISSUES} SELECT stem, line, split_part(c, ':', 1) AS severity, split_part(c, ':', 2) AS code FROM issue"


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_counts(validate.check_lines(views.label_lines(spark, sf_dir)))


ISSUE_COUNTS = f"WITH {_ISSUES} SELECT c AS issue, count(*) AS n FROM issue GROUP BY c"


def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.line_totals(views.label_lines(spark, sf_dir).withColumnRenamed("source", "split"))


SPLIT_TOTALS = f"""WITH {_ISSUES}, r AS (
  SELECT source, 1 AS i, 0 AS n, 0 AS e, 0 AS w FROM (SELECT DISTINCT source, stem FROM line) UNION ALL SELECT source, 0, 1, 0, 0 FROM line
  UNION ALL SELECT source, 0, 0, (c LIKE 'error:%')::INT, (c LIKE 'warning:%')::INT FROM issue)
SELECT coalesce(source, 'total') AS split, sum(i)::BIGINT AS images, sum(n)::BIGINT AS instances, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings FROM r GROUP BY ROLLUP (source)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.instances(spark, sf_dir).withColumn("edge", F.col("edge") <= 0.02)
    return curate.label_stats(t, 0.09, 0.06)


def hard_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curate.repeats(_stats(spark, sf_dir), F.col("image") % 4 == 3)
    return out.select("image", "n", F.round("min_area", 6).alias("min_area"), "small", "tiny", "edge", "repeat", "reasons")


_REPEATS = f"""{views.INST}, st AS (SELECT image, count(*) AS n, min(area) AS min_area, count(*) FILTER (WHERE area < 0.09) AS small, count(*) FILTER (WHERE area < 0.06) AS tiny, count(*) FILTER (WHERE edge <= 0.02) AS edge FROM inst GROUP BY image),
ru AS (SELECT *, list_filter([CASE WHEN n >= 8 THEN 'dense_instances>=8' END, CASE WHEN n >= 5 AND n < 8 THEN 'multi_instances>=5' END, CASE WHEN small >= 3 THEN 'small_instances>=3' END, CASE WHEN small >= 1 AND small < 3 THEN 'small_instances>=1' END, CASE WHEN tiny >= 1 THEN 'tiny_instances>=1' END, CASE WHEN edge >= 2 THEN 'edge_instances>=2' END, CASE WHEN image % 4 = 3 AND (small >= 1 OR n >= 4) THEN 'team128_hard_source' END], lambda x: x IS NOT NULL) AS r FROM st),
rep AS (SELECT *, least(5, 1 + len(r) + list_contains(r, 'dense_instances>=8')::INT + list_contains(r, 'small_instances>=3')::INT)::INT AS repeat FROM ru)"""
HARD_OVERSAMPLE = f"WITH {_REPEATS} SELECT image, n, round(min_area, 6) AS min_area, small, tiny, edge, repeat, array_to_string(CASE WHEN repeat = 1 THEN list_append(r, 'base') ELSE r END, ',') AS reasons FROM rep"


def repeat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.oversampled(curate.repeats(_stats(spark, sf_dir), F.col("image") % 4 == 3)).groupBy("repeat").agg(F.count("*").alias("rows"), F.count_distinct("image").alias("images"))


REPEAT_HISTOGRAM = f"WITH {_REPEATS} SELECT repeat, (count(*) * repeat)::BIGINT AS rows, count(*) AS images FROM rep GROUP BY repeat"


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.duplicates(views.assets(spark, sf_dir))


EXACT_DUPLICATES = f"WITH {views.ASSETS} SELECT sha256, count(*) AS n, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS cross_split FROM asset GROUP BY sha256 HAVING count(*) > 1"


def leak_free_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_free(views.assets(spark, sf_dir)).select("image", "split", F.coalesce("why", F.lit("")).alias("why"))


_LEAKS = f"""{views.ASSETS}, te AS (SELECT * FROM asset WHERE split = 'test'),
va AS (SELECT a.*, a.scene IN (SELECT scene FROM te) AS s, a.sha256 IN (SELECT sha256 FROM te) AS h FROM asset a WHERE split = 'val'), cv AS (SELECT * FROM va WHERE NOT s AND NOT h),
tr AS (SELECT a.*, a.scene IN (SELECT scene FROM te) AS s, a.sha256 IN (SELECT sha256 FROM te) AS h, a.scene IN (SELECT scene FROM cv) AS s2, a.sha256 IN (SELECT sha256 FROM cv) AS h2 FROM asset a WHERE split = 'train'),
leak AS (SELECT image, source, name, scene, split, '' AS why FROM te
  UNION ALL SELECT image, source, name, scene, split, CASE WHEN s AND h THEN 'protected_test_scene_and_sha256' WHEN s THEN 'protected_test_scene' WHEN h THEN 'protected_test_sha256' ELSE '' END FROM va
  UNION ALL SELECT image, source, name, scene, split, CASE WHEN s AND h THEN 'protected_test_scene_and_sha256' WHEN s THEN 'protected_test_scene' WHEN h THEN 'protected_test_sha256' WHEN s2 AND h2 THEN 'clean_val_scene_and_sha256' WHEN s2 THEN 'clean_val_scene' WHEN h2 THEN 'clean_val_sha256' ELSE '' END FROM tr)"""
LEAK_FREE_SPLITS = f"WITH {_LEAKS} SELECT image, split, why FROM leak"


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leakage.leak_free(views.assets(spark, sf_dir)).filter("why IS NOT NULL")
    return out.groupBy(F.concat_ws("::", "split", "why").alias("reason")).agg(F.count("*").alias("n"))


EXCLUSION_COUNTS = f"WITH {_LEAKS} SELECT split || '::' || why AS reason, count(*) AS n FROM leak WHERE why <> '' GROUP BY ALL"


def scene_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.first_of(views.assets(spark, sf_dir), "scene").filter("first").select("image", "scene", "split")


SCENE_UNIQUE = f"WITH {views.ASSETS} SELECT image, scene, split FROM asset QUALIFY row_number() OVER (PARTITION BY scene ORDER BY lower(name), name, image) = 1"


def cross_split_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.assets(spark, sf_dir)
    out = None
    for x, y in (("train", "val"), ("train", "test"), ("val", "test")):
        for key in ("scene", "sha256"):
            one = leakage.shared_keys(a, x, y, key).agg(F.count("*").alias("n")).select(F.lit(f"{x}&{y}").alias("pair"), F.lit(key).alias("key"), "n")
            out = one if out is None else out.unionByName(one)
    return out


CROSS_SPLIT_INTERSECTIONS = f"WITH {views.ASSETS} " + " UNION ALL ".join(
    f"SELECT '{x}&{y}' AS pair, '{k}' AS key, count(*) AS n FROM (SELECT {k} FROM asset WHERE split = '{x}' INTERSECT SELECT {k} FROM asset WHERE split = '{y}')" for x, y in (("train", "val"), ("train", "test"), ("val", "test")) for k in ("scene", "sha256")
)


def cover_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents against all documents: what only one side has."""
    l, d = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image")), views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"))
    return curate.cover_gaps(l, d)


COVER_GAPS = """SELECT image, 'manifest' AS side FROM (SELECT doc_id AS image FROM labels EXCEPT ALL SELECT doc_id FROM documents)
UNION ALL SELECT image, 'directory' FROM (SELECT doc_id AS image FROM documents EXCEPT ALL SELECT doc_id FROM labels)"""


def scene_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.scene_manifest(views.assets(spark, sf_dir))


SCENE_MANIFEST = f"WITH {views.ASSETS} SELECT scene, string_agg(DISTINCT name, ' | ' ORDER BY name) AS members, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n, count(DISTINCT split) > 1 AS cross_split FROM asset GROUP BY scene"


def split_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.counts_cube(views.assets(spark, sf_dir), "split", "source")


SPLIT_SOURCE_COUNTS = f"WITH {views.ASSETS} SELECT coalesce(split, 'all') AS split, coalesce(source, 'all') AS source, count(*) AS n FROM asset GROUP BY CUBE (split, source)"


def fused_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.fused(views.assets(spark, sf_dir).withColumnRenamed("name", "n2")).select("image", "new_image")


FUSED_NAMES = f"WITH {views.ASSETS} SELECT image, source || '_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS new_image FROM (SELECT image, source, row_number() OVER (PARTITION BY source ORDER BY image) - 1 AS n FROM asset)"


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.error_counts(views.image_rows(spark, sf_dir, form=matching.with_truths), evaluation.CONF, evaluation.MATCH_IOU).withColumn("seq", F.col("image"))
    return curate.review_queue(rows, 50).select("image", "gt", "fp", "fn", "unreachable", "score", "action")


_QUEUE = (
    evaluation._ERRORS
    + """, q AS (SELECT im.image, (SELECT count(*) FROM truth t WHERE t.image = im.image) AS gt, count(*) FILTER (WHERE type = 'FP') AS fp, count(*) FILTER (WHERE type = 'FN') AS fn, count(*) FILTER (WHERE type = 'FN' AND best_iou < 0.5) AS unreachable FROM (SELECT DISTINCT image FROM inst) im LEFT JOIN err ON err.image = im.image GROUP BY im.image)
, queue AS (SELECT *, 5 * fn + 2 * fp + 8 * unreachable + gt AS score FROM q ORDER BY score DESC, unreachable DESC, fn DESC, fp DESC, image LIMIT 50)"""
)
_A, _S = (["'" + x + "'" for x in some] for some in (curate.ACTIONS, curate.SUGGESTIONS))
REVIEW_QUEUE = _QUEUE + f" SELECT *, CASE WHEN unreachable >= 2 THEN {_A[0]} WHEN fn >= 4 AND gt >= 8 THEN {_A[1]} WHEN fp >= 4 THEN {_A[2]} WHEN fn >= 2 THEN {_A[3]} ELSE {_A[4]} END AS action FROM queue"


def instance_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = views.image_rows(spark, sf_dir, form=matching.with_truths).select("image", F.explode(matching.best_of_truths(F.col("preds"), F.col("truths"))).alias("t"))
    side = lambda lo, hi: (F.col(f"t.shape.{hi}") - F.col(f"t.shape.{lo}")) / 40
    reachable = F.when(F.coalesce("t.best.iou", F.lit(0.0)) >= evaluation.MATCH_IOU, "True").otherwise("False")
    rows = each.select("image", "t.idx", "t.area", (F.col("t.edge") <= 0.02).alias("edge"), side("x0", "x1").alias("box_w"), side("y0", "y1").alias("box_h"), reachable.alias("reachable"))
    queued = F.broadcast(review_queue(spark, sf_dir).select("image", F.lit(True).alias("queued")))  # 50 rows
    rows = rows.join(queued, "image", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))
    return curate.instance_priority(rows, 0.09, 0.06).select("image", "idx", "priority", "suggestion")


INSTANCE_PRIORITY = _QUEUE + f""", r AS (SELECT t.image, t.idx, t.area, t.edge <= 0.02 AS edge, coalesce(bg.best_iou, 0.0) < 0.5 AS missed, t.image IN (SELECT image FROM queue) AS queued, least(t.x1 - t.x0, t.y1 - t.y0) / 40.0::DOUBLE <= 0.015 AS narrow FROM truth t LEFT JOIN bg ON bg.image = t.image AND bg.g_idx = t.idx)
SELECT image, idx, CASE WHEN missed THEN 100 ELSE 0 END + CASE WHEN area <= 0.06 THEN 40 WHEN area <= 0.09 THEN 20 ELSE 0 END + CASE WHEN edge THEN 15 ELSE 0 END + CASE WHEN queued THEN 10 ELSE 0 END AS priority,
  CASE WHEN missed AND area <= 0.09 THEN {_S[0]} WHEN missed AND edge THEN {_S[1]} WHEN missed THEN {_S[2]} WHEN area <= 0.06 THEN {_S[3]} WHEN edge AND queued THEN {_S[4]} WHEN narrow AND queued THEN {_S[5]} ELSE {_S[6]} END AS suggestion FROM r"""


def scheduler_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    out = frames.result_age(frames.scheduled(f, 10, ["track_id"]), ["track_id"])
    return out.select("frame_index", "track_id", "runs", "age")


SCHEDULER_AGE = f"""WITH {views.FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index) = 1 OR frame_index % 10 = 0 AS runs FROM frames)
SELECT frame_index, track_id, runs, frame_index - last_value(CASE WHEN runs THEN frame_index END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS age FROM r"""


def track_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.history(views.frames(spark, sf_dir), "frame_index", 30)
    return out.select("frame_index", "track_id", F.size("history").cast("long").alias("n"), F.element_at("history", 1).alias("oldest"))


TRACK_HISTORY = f"WITH {views.FRAMES} SELECT frame_index, track_id, count(*) OVER w AS n, first_value(frame_index) OVER w AS oldest FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.deltas(views.frames(spark, sf_dir), ["track_id"]).select("frame_index", F.round("delta_ms", 3).alias("delta_ms"))


FRAME_DELTA = f"WITH {views.FRAMES} SELECT frame_index, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY track_id ORDER BY frame_index)) / 1000.0::DOUBLE, 3) AS delta_ms FROM frames"


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank_of(views.table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


LATENCY_PERCENTILES = """WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL)
SELECT v[(greatest(0, (0.5 * n)::DECIMAL(18, 2)::DOUBLE // 1 - 1) + 1)::BIGINT] AS p50, v[(greatest(0, floor(0.95::DOUBLE * n) - 1) + 1)::BIGINT] AS p95, v[(greatest(0, floor(0.99::DOUBLE * n) - 1) + 1)::BIGINT] AS p99, n FROM s"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.summary(frames.scheduled(views.frames(spark, sf_dir), 10, ["track_id"]))
    return out.select("frames", "tracks", "runs", F.round("seconds", 3).alias("seconds"), F.round("fps", 6).alias("fps"))


RUN_SUMMARY = f"""WITH {views.FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index) = 1 OR frame_index % 10 = 0 AS runs FROM frames), s AS (SELECT count(*) AS frames, count(DISTINCT track_id) AS tracks, count(*) FILTER (WHERE runs) AS runs, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM r)
SELECT frames, tracks, runs, round(seconds, 3) AS seconds, round((frames - 1) / seconds, 6) AS fps FROM s"""


def timeout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).withColumn("timed_out", F.col("event_type") == "error")
    return frames.timeout_runs(f, ["track_id"], "timed_out", 2)


TIMEOUT_RUNS = f"""WITH {views.FRAMES}, m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY frame_index) AS island FROM frames)
SELECT track_id, min(frame_index) AS start, count(*) AS n, count(*) >= 2 AS aborts FROM m WHERE event_type = 'error' GROUP BY track_id, island"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.segments(views.frames(spark, sf_dir), 3600)
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


SEGMENTS = f"WITH {views.FRAMES} SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM frames GROUP BY ALL"


def token_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", text.token(F.col("url")).alias("token"))


TOKEN_SANITIZE = """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/\\s]+|[:*?"<>|]', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') AS token FROM pages"""


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", text.stable_id(F.col("url")).alias("id"))


STABLE_ID = """SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(CASE WHEN b LIKE '_%.%' THEN regexp_replace(b, '(.)\\.[^.]+$', '\\1') ELSE b END, '[^0-9A-Za-z_-]+', '_', 'g'), '_'), ''), 'image'), 1, 60) || '_' || substr(sha1(url), 1, 10) AS id FROM (SELECT page_id, url, list_last(string_split(url, '/')) AS b FROM pages)"""


def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source hints, label paths, digests of asset names."""
    a = views.assets(spark, sf_dir)
    path = F.concat(F.lit("data/images/"), F.col("split"), F.lit("/"), F.col("name"))
    return a.select("image", text.label_path(path).alias("label"), text.stem(F.col("name")).alias("stem"), text.suffix(F.col("name")).alias("suffix"), text.short_source(F.col("source")).alias("hint"), text.license_id(F.col("source")).cast("long").alias("license"), text.relative_path(path, F.lit("data/images")).alias("relative"))


TEXT_FIELDS = f"WITH {views.ASSETS} SELECT image, 'data/labels/' || split || '/' || replace(name, '.jpg', '.txt') AS label, replace(name, '.jpg', '') AS stem, '.jpg' AS suffix, 'unknown' AS hint, 2::BIGINT AS license, split || '/' || name AS relative FROM asset"


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.assets(spark, sf_dir)
    return a.groupBy("source").agg(text.fingerprint(F.col("split"), F.col("name"), F.col("sha256")).alias("fingerprint"))


CONTENT_FINGERPRINT = f"WITH {views.ASSETS} SELECT source, sha256(string_agg(split || chr(0) || name || chr(0) || sha256 || chr(10), '' ORDER BY split, name, sha256)) AS fingerprint FROM asset GROUP BY source"

FEATURES = ["conf", "conf_rank", "rank_share", "over_mean", "under_top", "cx", "cy", "w", "h", "aspect", "area", "root_area", "edge", "max_iou", "sum_iou", "n_iou50", "n_iou10", "n_other_model", "best_near_conf"]


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.one_hot(features.box_features_of(views.instances(spark, sf_dir)), ("alpha", "beta", "gamma", "unknown"))
    return out.select("image", "idx", *(F.round(c, 6).alias(c) for c in (*FEATURES, "n", "at_edge")), "source_alpha", "source_beta", "source_gamma", "source_unknown")


_FEATURES = f"""{views.INST}, o AS (SELECT image, a_idx AS idx, a_model AS model, b_model AS other, b_conf AS other_conf, iou FROM near UNION ALL SELECT image, b_idx, b_model, a_model, a_conf, iou FROM near),
nr AS (SELECT image, idx, max(iou) AS max_iou, sum(iou) AS sum_iou, count(*) FILTER (WHERE iou >= 0.5) AS n_iou50, count(*) FILTER (WHERE iou >= 0.1) AS n_iou10, count(*) FILTER (WHERE model <> other) AS n_other_model, max(CASE WHEN iou >= 0.5 THEN other_conf END) AS best_near_conf FROM o GROUP BY ALL),
rk AS (SELECT *, count(*) OVER (PARTITION BY image ORDER BY conf DESC)::DOUBLE AS conf_rank, count(*) OVER (PARTITION BY image)::DOUBLE AS n_all, avg(conf) OVER (PARTITION BY image) AS mean_conf, max(conf) OVER (PARTITION BY image) AS top_conf FROM pred),
feat AS (SELECT rk.image, rk.idx, source, conf, conf_rank, conf_rank / n_all AS rank_share, n_all AS n, conf - mean_conf AS over_mean, top_conf - conf AS under_top, (x0 + x1 + 1) / 80.0::DOUBLE AS cx, (y0 + y1 + 1) / 80.0::DOUBLE AS cy, (x1 - x0 + 1) / 40.0::DOUBLE AS w, (y1 - y0 + 1) / 40.0::DOUBLE AS h, (x1 - x0 + 1) / (y1 - y0 + 1)::DOUBLE AS aspect, area, sqrt(area) AS root_area, edge, (edge <= 0.02)::INT::DOUBLE AS at_edge,
  coalesce(max_iou, 0)::DOUBLE AS max_iou, coalesce(sum_iou, 0)::DOUBLE AS sum_iou, coalesce(n_iou50, 0)::DOUBLE AS n_iou50, coalesce(n_iou10, 0)::DOUBLE AS n_iou10, coalesce(n_other_model, 0)::DOUBLE AS n_other_model, coalesce(best_near_conf, 0)::DOUBLE AS best_near_conf FROM rk LEFT JOIN nr ON nr.image = rk.image AND nr.idx = rk.idx)"""
FEATURE_TABLE = f"WITH {_FEATURES} SELECT image, idx, {', '.join(f'round({c}, 6) AS {c}' for c in (*FEATURES, 'n', 'at_edge'))}, (source = 'alpha')::INT::DOUBLE AS source_alpha, (source = 'beta')::INT::DOUBLE AS source_beta, (source = 'gamma')::INT::DOUBLE AS source_gamma, (source NOT IN ('alpha', 'beta', 'gamma'))::INT::DOUBLE AS source_unknown FROM feat"


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.box_features_of(views.instances(spark, sf_dir)).select("image", "idx", *FEATURES)
    scale = features.scaling(rows.filter("image % 5 <> 0"), FEATURES)
    return features.standardized(rows, scale, FEATURES).select("image", "idx", *(F.round(c, 4).alias(c) for c in FEATURES))


STANDARDIZE = f"""WITH {_FEATURES}, sc AS (SELECT {', '.join(f'avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s' for c in FEATURES)} FROM feat WHERE image % 5 <> 0)
SELECT image, idx, {', '.join(f'round(({c} - {c}_m) / {c}_s, 4) AS {c}' for c in FEATURES)} FROM feat, sc"""


def pareto_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of (tp, fp) that no other beats, by part of the orders' keys."""
    rows = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("tp"), F.count_if(F.col("l_linestatus") != "F").alias("fp"))
    return policy.pareto(rows.select((F.col("l_suppkey") % 5).alias("part"), "tp", "fp", F.format_string("%06d", "l_suppkey").alias("path")), ["part"]).select("part", "tp", "fp", "path")


PARETO_POLICIES = """WITH r AS (SELECT l_suppkey % 5 AS part, count(*) FILTER (WHERE l_linestatus = 'F') AS tp, count(*) FILTER (WHERE l_linestatus <> 'F') AS fp, lpad(l_suppkey::VARCHAR, 6, '0') AS path FROM lineitem GROUP BY l_suppkey),
f AS (SELECT part, tp, min(fp) AS fp, arg_min(path, (fp, path)) AS path FROM r GROUP BY part, tp)
SELECT part, tp, fp, path FROM (SELECT *, min(fp) OVER (PARTITION BY part ORDER BY tp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM f) WHERE least IS NULL OR fp < least"""


def source_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every total that one setting per source can reach and none beats."""
    grid = spark.createDataFrame([(i, c, n, 0.0, -1.0) for i, (c, n) in enumerate((c, n) for c in evaluation.GRID_CONF for n in (0.3, 0.5))], "grid_seq int, conf double, nms_iou double, min_area double, min_edge double")
    per = matching.evaluated_totals(views.image_rows(spark, sf_dir), grid, ["source", "grid_seq"]).select("source", "grid_seq", "tp", "fp", "fn").persist()
    n = per.filter("grid_seq = 0").agg(F.sum(F.col("tp") + F.col("fn"))).first()[0] or 0
    return policy.source_policies(per, n).select("tp", "fp", "fn", "path", F.round("f1", 6).alias("f1"))


_WITH_SQL = {
    "validate_lines": (validate_lines, VALIDATE_LINES), "issue_counts": (issue_counts, ISSUE_COUNTS), "split_totals": (split_totals, SPLIT_TOTALS), "hard_oversample": (hard_oversample, HARD_OVERSAMPLE), "repeat_histogram": (repeat_histogram, REPEAT_HISTOGRAM),
    "exact_duplicates": (exact_duplicates, EXACT_DUPLICATES), "leak_free_splits": (leak_free_splits, LEAK_FREE_SPLITS), "exclusion_counts": (exclusion_counts, EXCLUSION_COUNTS), "scene_unique": (scene_unique, SCENE_UNIQUE), "cross_split_intersections": (cross_split_intersections, CROSS_SPLIT_INTERSECTIONS), "cover_gaps": (cover_gaps, COVER_GAPS),
    "scene_manifest": (scene_manifest, SCENE_MANIFEST), "split_source_counts": (split_source_counts, SPLIT_SOURCE_COUNTS), "fused_names": (fused_names, FUSED_NAMES), "review_queue": (review_queue, REVIEW_QUEUE), "instance_priority": (instance_priority, INSTANCE_PRIORITY),
    "scheduler_age": (scheduler_age, SCHEDULER_AGE), "track_history": (track_history, TRACK_HISTORY), "frame_delta": (frame_delta, FRAME_DELTA), "latency_percentiles": (latency_percentiles, LATENCY_PERCENTILES), "run_summary": (run_summary, RUN_SUMMARY), "timeout_runs": (timeout_runs, TIMEOUT_RUNS), "segments": (segments, SEGMENTS),
    "token_sanitize": (token_sanitize, TOKEN_SANITIZE), "stable_id": (stable_id, STABLE_ID), "text_fields": (text_fields, TEXT_FIELDS), "content_fingerprint": (content_fingerprint, CONTENT_FINGERPRINT), "feature_table": (feature_table, FEATURE_TABLE), "standardize": (standardize, STANDARDIZE), "pareto_policies": (pareto_policies, PARETO_POLICIES),
}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()} | {"source_policies": source_policies}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
