"""Overlap pairs within an image, and best partners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import box_iou, boxes_overlap

BOX = ("x0", "y0", "x1", "y1")


def _side(df: DataFrame, p: str, extra=()) -> DataFrame:
    return df.select("image", *(F.col(c).alias(p + c) for c in ("idx", *BOX, *extra)))


def pred_gt(preds: DataFrame, gts: DataFrame) -> DataFrame:
    """image, p_idx, g_idx, iou of predictions and truths whose boxes meet. The equal image makes it a hash or merge join, the
    boxes a condition on it; pairs apart have IoU 0 and no row."""
    both = _side(preds, "p_").join(_side(gts, "g_"), "image").filter(boxes_overlap("p_", "g_"))
    return both.select("image", "p_idx", "g_idx", box_iou("p_", "g_").alias("iou"))


def pred_pred(preds: DataFrame) -> DataFrame:
    """image, a_idx, b_idx, iou, models of predictions that overlap, a_idx < b_idx."""
    both = _side(preds, "a_", ("model",)).join(_side(preds, "b_", ("model",)), "image").filter((F.col("a_idx") < F.col("b_idx")) & boxes_overlap("a_", "b_"))
    return both.select("image", "a_idx", "b_idx", "a_model", "b_model", box_iou("a_", "b_").alias("iou"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from either side, as idx and other."""
    one = pairs.select("image", F.col("a_idx").alias("idx"), F.col("b_idx").alias("other"), F.col("a_model").alias("model"), F.col("b_model").alias("other_model"), "iou")
    return one.unionByName(pairs.select("image", F.col("b_idx").alias("idx"), F.col("a_idx").alias("other"), F.col("b_model").alias("model"), F.col("a_model").alias("other_model"), "iou"))


def best_partner(rows: DataFrame, pairs: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """rows with the partner of largest IoU (of equals, the smallest idx): ``name``_idx, -1 for none, and ``name``_iou, 0 for none."""
    best = pairs.filter("iou > 0").groupBy("image", own).agg(F.min(F.struct((-F.col("iou")).alias("m"), F.col(other).alias("i"))).alias("b"))
    out = rows.join(best.withColumnRenamed(own, "idx"), ["image", "idx"], "left")
    return out.withColumn(f"{name}_idx", F.coalesce("b.i", F.lit(-1))).withColumn(f"{name}_iou", F.coalesce(-F.col("b.m"), F.lit(0.0))).drop("b")


def best_per_gt(gts: DataFrame, preds: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every truth with its best prediction over all of them, that one's confidence and whether it is reachable."""
    out = best_partner(gts.select("image", "idx", "source"), pairs, "g_idx", "p_idx", "best")
    conf = preds.select("image", F.col("idx").alias("best_idx"), F.col("conf").alias("best_conf"))
    return out.join(conf, ["image", "best_idx"], "left").withColumn("reachable", F.col("best_iou") >= threshold)


def reachable_recall(best: DataFrame) -> DataFrame:
    """n_gt, unreachable, max_recall (0 without truths)."""
    sums = best.agg(F.count("*").alias("n_gt"), F.count_if(~F.col("reachable")).alias("unreachable"))
    return sums.withColumn("max_recall", F.when(F.col("n_gt") > 0, (F.col("n_gt") - F.col("unreachable")) / F.col("n_gt")).otherwise(0.0))


def supported(preds: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Predictions that some prediction of another model overlaps at the threshold or more: a semi-join."""
    witness = both_ways(pairs).filter((F.col("iou") >= threshold) & (F.col("model") != F.col("other_model"))).select("image", "idx")
    return preds.join(witness, ["image", "idx"], "left_semi")


def consensus(preds: DataFrame, pairs: DataFrame, threshold: float, min_support: int) -> DataFrame:
    """A candidate per prediction whose members (itself and what overlaps it at the threshold) come from enough models: its
    most confident member (of equals, the first) with the number of models as support."""
    own = preds.select("image", "idx", F.col("idx").alias("other"), F.col("model").alias("other_model"))
    members = both_ways(pairs).filter(F.col("iou") >= threshold).select("image", "idx", "other", "other_model").unionByName(own)
    scores = preds.select("image", F.col("idx").alias("other"), "conf")
    met = members.join(scores, ["image", "other"]).groupBy("image", "idx").agg(F.count_distinct("other_model").alias("support"), F.min(F.struct((-F.col("conf")).alias("m"), F.col("other").alias("i"))).alias("best"), F.array_sort(F.collect_set("other")).alias("members"))
    return met.filter(F.col("support") >= min_support).select("image", "idx", "support", F.col("best.i").alias("representative"), (-F.col("best.m")).alias("score"), "members")


def ranked(preds: DataFrame) -> DataFrame:
    """rank (from 1) by falling confidence, ties in the order of idx."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("conf"), "idx")))


def worst_rank(preds: DataFrame) -> DataFrame:
    """conf_rank: how many predictions of the image are as confident or more; ties share the last place."""
    return preds.withColumn("conf_rank", F.count("*").over(Window.partitionBy("image").orderBy(F.desc("conf")).rangeBetween(Window.unboundedPreceding, 0)))


def top_k(preds: DataFrame, k: int) -> DataFrame:
    return ranked(preds).filter(F.col("rank") <= k)


def top_k_then_area(preds: DataFrame, k: int, min_area: float) -> DataFrame:
    """Of the k most confident predictions of an image, those of area ``min_area`` or more: the area takes part after the limit."""
    return top_k(preds, k).filter(F.col("area") >= min_area)


def top_k_losses(preds: DataFrame, k: int, min_area: float) -> DataFrame:
    """image, found, truncated (beyond the k), filtered_by_area (within the k, too small), kept."""
    inside = F.col("rank") <= k
    out = ranked(preds).groupBy("image").agg(F.count("*").alias("found"), F.count_if(~inside).alias("truncated"), F.count_if(inside & (F.col("area") < min_area)).alias("filtered_by_area"))
    return out.withColumn("kept", F.col("found") - F.col("truncated") - F.col("filtered_by_area"))
