"""Counts to rates, curves and selections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import cut


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.when(b > 0, a / b).otherwise(0.0)


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and instance accuracy of tp, fp, fn."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    out = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("accuracy", ratio(tp, tp + fp + fn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def totals(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Sums over images, then rates."""
    return with_rates(evaluated.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("images")))


def image_rates(evaluated: DataFrame) -> DataFrame:
    """Per image; recall is over the number of truths, 0 without any."""
    tp = F.col("tp")
    return evaluated.withColumn("precision", ratio(tp, tp + F.col("fp"))).withColumn("recall", ratio(tp, F.col("n_gt")))


def best(df: DataFrame, keys: list[str], seq: str = "grid_seq", where: Column | None = None) -> DataFrame:
    """The row with the largest keys, in order; of equals the first of the grid. No row if none qualifies."""
    return (df.filter(where) if where is not None else df).orderBy(*(F.desc(k) for k in keys), seq).limit(1)


def four_selections(df: DataFrame, precision: float = 0.95, recall: float = 0.90, seq: str = "grid_seq") -> DataFrame:
    """best_f1; best over both floors; best recall over the precision floor; best precision over the recall floor."""
    p, r = F.col("precision") >= precision, F.col("recall") >= recall
    picks = (("best_f1", ["f1", "recall", "precision"], None), ("best_target", ["f1", "recall"], p & r), ("best_recall", ["recall", "f1"], p), ("best_precision", ["precision", "f1"], r))
    out = None
    for name, keys, where in picks:
        one = best(df, keys, seq, where).withColumn("selection", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def running(each: DataFrame, score: str, sums: dict[str, str], buckets: int = 64) -> DataFrame:
    """Running totals by falling score. Distinct scores can be many, so they are cut into ranges: totals of the ranges
    are added up first, and each range is then a window of its own."""
    cuts = each.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = sum(((F.col(score) < c).cast("int") for c in cuts), F.lit(0))
    rows = each.withColumn("_b", bucket)
    before = rows.groupBy("_b").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = before.select("_b", *(F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), "_b")
    return out.select(score, *((F.sum(v).over(inside) + F.col(f"_{k}")).alias(k) for k, v in sums.items()))


def precision_recall(scored: DataFrame, positives: int | None = None) -> DataFrame:
    """score, target (0 or 1) -> threshold, tp, fp, precision, recall, f1 at every distinct score, ties together."""
    each = scored.groupBy("score").agg(F.sum("target").cast("long").alias("hits"), F.count("*").alias("n"))
    n = positives if positives is not None else each.agg(F.sum("hits")).first()[0] or 0
    rows = running(each, "score", {"tp": "hits", "chosen": "n"}).select(F.col("score").alias("threshold"), "tp", (F.col("chosen") - F.col("tp")).alias("fp"), (F.lit(n) - F.col("tp")).alias("fn"))
    return with_rates(rows)


def average_precision(curve: DataFrame, points: int = 101) -> DataFrame:
    """ap: mean over evenly spaced recalls of the best precision at that recall or more (0 beyond the last). Points and ranges of the
    curve meet by one aggregation: of each point, the largest precision among rows at or right of it."""
    step = points - 1
    reach = curve.filter("tp > 0").select("precision", F.floor(F.col("recall") * step + 1e-9).cast("int").alias("k")).groupBy("k").agg(F.max("precision").alias("precision"))
    grid = curve.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    right = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)  # ``points`` rows
    return grid.join(reach, "k", "left").select(F.coalesce(F.max("precision").over(right), F.lit(0.0)).alias("p")).agg(F.avg("p").alias("ap"))


def average_precisions(hits: DataFrame, n_gt: int, points: int = 101) -> DataFrame:
    """threshold, conf, hit -> threshold, ap (interpolated at evenly spaced recalls) and ar (the last recall).

    Scores are distinct values of each threshold, ties together; the running totals are over them, not over predictions.
    """
    each = hits.groupBy("threshold", "conf").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    falling = Window.partitionBy("threshold").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    curve = each.withColumn("tp", F.sum("hits").over(falling)).withColumn("chosen", F.sum("n").over(falling)).withColumn("recall", ratio(F.col("tp"), F.lit(n_gt)))
    step = points - 1
    reach = curve.groupBy("threshold", F.floor(F.col("recall") * step + 1e-9).cast("int").alias("k")).agg(F.max(F.when(F.col("tp") > 0, F.col("tp") / F.col("chosen"))).alias("precision"), F.max("recall").alias("recall"))
    right = Window.partitionBy("threshold").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    # a row stands for the points after the row before it, up to its own
    before = F.coalesce(F.lag("k").over(Window.partitionBy("threshold").orderBy("k")), F.lit(-1))
    parts = reach.withColumn("best", F.coalesce(F.max("precision").over(right), F.lit(0.0))).withColumn("held", F.col("k") - before)
    return parts.groupBy("threshold").agg((F.sum(F.col("best") * F.col("held")) / points).alias("ap"), F.max("recall").alias("ar"))


#: Where average precision is taken, and the numbers of detections an image may have for average recall.
RECALLS = tuple(float(x) for x in np.linspace(0.0, 1.0, 101))
MOST_DETECTIONS = (1, 10, 100)


def reached(recall: Column) -> Column:
    """How many of RECALLS (the numbers as they are stored, not multiples of 1/100) are at or below it, less one."""
    at, k = F.array(*map(F.lit, RECALLS)), F.least(F.floor(recall * (len(RECALLS) - 1)).cast("int"), F.lit(len(RECALLS) - 1))
    return F.when((k < len(RECALLS) - 1) & (F.get(at, k + 1) <= recall), k + 1).when(F.get(at, k) > recall, k - 1).otherwise(k)


def coco_summary(hits: DataFrame, n_gt: int, thresholds: tuple[float, ...], buckets: int = 64) -> DataFrame:
    """threshold, conf, image, rank, hit of each detection at every threshold -> coco_summary_of()."""
    at = lambda t: F.coalesce(F.bool_or(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("hit"))), F.lit(False))
    return coco_summary_of(hits.groupBy("image", "rank", "conf").agg(F.array(*map(at, thresholds)).alias("hits")), n_gt, thresholds, buckets)


def coco_summary_of(hits: DataFrame, n_gt: int, thresholds: tuple[float, ...], buckets: int = 64) -> DataFrame:
    """image, rank, conf, hits (at each threshold) of each detection -> one row: ap (mean over thresholds), ap50, ap75, ar1, ar10, ar100. All 0 without a truth.

    Detections enter one by one, by falling confidence, then image and rank, so ties keep their order; it is the same at all thresholds, so they are sorted
    once. Running totals are by range of confidence: what stands in the ranges before is added up first. Of the curves, only the best precision at each of
    RECALLS goes on.
    """
    n, places = max(n_gt, 1), range(len(thresholds))
    cuts = sorted(set(hits.agg(F.percentile_approx("conf", [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []))
    rows = hits.withColumn("_b", sum(((F.col("conf") < c).cast("int") for c in cuts), F.lit(0)))
    each = rows.groupBy("_b").agg(*(F.count_if(F.get("hits", F.lit(i))).alias(f"_tp{i}") for i in places), F.count("*").alias("_n"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = each.select("_b", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in each.columns if c != "_b"))
    inside = Window.partitionBy("_b").orderBy(F.desc("conf"), "image", "rank").rowsBetween(Window.unboundedPreceding, 0)
    own = [F.sum(F.get("hits", F.lit(i)).cast("long")).over(inside).alias(f"tp{i}") for i in places]
    curve = rows.select("_b", "hits", *own, F.count("*").over(inside).alias("n")).join(F.broadcast(before), "_b")
    curve = curve.select(F.col("n") + F.col("_n"), F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.get("hits", F.lit(i)).alias("hit"), (F.col(f"tp{i}") + F.col(f"_tp{i}")).alias("tp")) for i, t in enumerate(thresholds)))).alias("z")).toDF("n", "z").select("n", "z.*")
    best = curve.filter("hit").groupBy("threshold", reached(F.col("tp") / n).alias("k")).agg(F.max(F.col("tp") / F.col("n")).alias("precision"))  # a row a recall at most
    right, before_k = Window.partitionBy("threshold").orderBy("k").rowsBetween(0, Window.unboundedFollowing), F.lag("k").over(Window.partitionBy("threshold").orderBy("k"))
    parts = best.withColumn("held", F.col("k") - F.coalesce(before_k, F.lit(-1))).withColumn("precision", F.max("precision").over(right))
    ap = parts.groupBy("threshold").agg((F.sum(F.col("precision") * F.col("held")) / len(RECALLS)).alias("ap"))
    at = lambda t: F.coalesce(F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap"))), F.lit(0.0))
    precision = ap.agg((F.coalesce(F.sum("ap"), F.lit(0.0)) / len(thresholds)).alias("ap"), at(0.5).alias("ap50"), at(0.75).alias("ap75"))
    found = F.size(F.filter("hits", lambda h: h))
    recall = hits.agg(*((F.coalesce(F.sum(F.when(F.col("rank") <= m, found)), F.lit(0)) / F.lit(float(n * len(thresholds)))).alias(f"ar{m}") for m in MOST_DETECTIONS))
    return precision.crossJoin(F.broadcast(recall))  # a row each


def nearest_rank(values: Column, share: float) -> Column:
    """Of an array: the value at place min(n - 1, max(0, int(share * n) - 1)) in ascending order; 0 if empty."""
    ordered, n = F.array_sort(values), F.size(values)
    at = F.least(n - 1, F.greatest(F.lit(0), F.floor(F.lit(share) * n).cast("int") - 1))
    return F.when(n > 0, F.get(ordered, at)).otherwise(0.0)


def nearest_rank_of(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """The same over a column of any size, by range partitioning: a rank is found by counts of partitions, and only the
    partition that holds it is looked into."""
    ordered = cut(df.filter(F.col(value).isNotNull()).select(value).repartitionByRange(value).sortWithinPartitions(value)).withColumn("_at", F.monotonically_increasing_id())  # kept: places and counts are of one order
    here, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["count"]) for r in ordered.groupBy(here.alias("p")).count().collect())  # a row a partition
    n = sum(c for _, c in counts)
    wanted = {}
    for name, share in shares.items():
        at = min(n - 1, max(0, int(share * n) - 1))
        for p, c in counts:
            if at < c:
                wanted[name] = (p, at)
                break
            at -= c
    picks = [F.coalesce(F.max(F.when((here == wanted[k][0]) & (inside == wanted[k][1]), F.col(value))), F.lit(0.0)).alias(k) if k in wanted else F.lit(0.0).alias(k) for k in shares]
    return ordered.agg(*picks, F.count("*").alias("n"))


def by_source(evaluated: DataFrame) -> DataFrame:
    """Totals per source, with false positives and negatives a million images."""
    out = totals(evaluated, ["source"])
    return out.withColumn("fp_ppm", F.rint(1_000_000 * F.col("fp") / F.col("images")).cast("long")).withColumn("fn_ppm", F.rint(1_000_000 * F.col("fn") / F.col("images")).cast("long"))


def error_pivot(errors: DataFrame) -> DataFrame:
    """source, FP, FN from rows of source and type."""
    return errors.groupBy("source").pivot("type", ["FP", "FN"]).count().na.fill(0)


def acceptance(df: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("p90_r90", (p >= 0.90) & (r >= 0.90)).withColumn("p95_r90", (p >= 0.95) & (r >= 0.90))


def epoch_loss(logs: DataFrame) -> DataFrame:
    """Mean loss of each epoch, weighted by batch size."""
    return logs.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("batch")) / F.sum("batch")).alias("loss"))


def run_status(df: DataFrame) -> DataFrame:
    """complete, partial or failed from counts of successes and errors."""
    done, bad = F.sum("succeeded"), F.sum("errors")
    return df.agg(done.alias("succeeded"), bad.alias("errors"), F.when(bad == 0, "complete").when(done > 0, "partial").otherwise("failed").alias("status"))


def worst_first(evaluated: DataFrame) -> DataFrame:
    """Images by falling fn, fp and truths; ties by image."""
    return evaluated.orderBy(F.desc("fn"), F.desc("fp"), F.desc("n_gt"), "image")


def candidate_summary(labelled: DataFrame, by: list[str]) -> DataFrame:
    """images, gt, candidates, positives, negatives per group and per all but the last key (null there, with ``whole`` true, as a key may be null
    itself), from rows of images with n_gt, n_kept and tp."""
    out = labelled.rollup(*by).agg(F.count("*").alias("images"), *(F.sum(c).cast("long").alias(n) for c, n in (("n_gt", "gt"), ("n_kept", "candidates"), ("tp", "positives"))), F.grouping_id().alias("_level"))
    return out.filter("_level <= 1").withColumn("whole", F.col("_level") == 1).drop("_level").withColumn("negatives", F.col("candidates") - F.col("positives"))


def latency_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """rows, average and peak of a measure per group; nulls take no part."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("average"), F.max(value).alias("peak"))
