"""Splits, fusion, oversampling, review queues."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

SEED = 20260707
SPLITS = ("train", "val", "test")


def split_order(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "val", 1).when(split == "test", 2).otherwise(3)


def _dealt(samples: DataFrame, keys: list[str], seed: int, counts) -> DataFrame:
    """Deals rows to splits by the permutation that a seeded shuffle of their sorted keys gives. Only row numbers are
    permuted, on the driver, as the generator is sequential; rows meet them by number."""
    numbered = samples.withColumn("_n", F.row_number().over(Window.orderBy(*keys)) - 1)
    n = samples.count()
    order = list(range(n))
    random.Random(seed).shuffle(order)
    train, val = counts(n)
    split = ["train" if i < train else "val" if i < train + val else "test" for i in range(n)]
    table = samples.sparkSession.createDataFrame(list(zip(order, range(n), split)) or [(0, 0, "train")], "_n int, shuffled int, split string")
    return numbered.join(F.broadcast(table) if n <= 1_000_000 else table, "_n").drop("_n")


def shuffled_split(samples: DataFrame, seed: int = SEED) -> DataFrame:
    """80 / 10 / 10 by (source, image); what the floors leave goes to test."""
    return _dealt(samples, ["source", "image"], seed, lambda n: (int(n * 0.8), int(n * 0.1)))


def clamped_split(samples: DataFrame, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """No split is empty where there are three rows or more."""

    def counts(n):
        a = min(max(1, round(n * train)), max(n - 2, 1))
        return a, min(max(1, round(n * val)), max(n - a - 1, 0))

    return _dealt(samples, ["image"], seed, counts)


def counted_split(samples: DataFrame, seed: int = SEED, train: int = 8, val: int = 1) -> DataFrame:
    return _dealt(samples, ["image"], seed, lambda n: (train, val))


def without_rejected(samples: DataFrame, stems: list[str], low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): listed stems, and in train names whose six-digit prefix is in low..high."""
    from ..functions.text import stem, visual_prefix

    bad = stem(F.col("image")).isin(*stems) | ((F.col("split") == "train") & F.coalesce(visual_prefix(F.col("image")).between(low, high), F.lit(False)))
    return samples.filter(~bad), samples.filter(bad).orderBy("split", "image")


def fused(samples: DataFrame) -> DataFrame:
    """new_image: source and a number of four digits within it, in the order of image."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("image")) - 1
    return samples.withColumn("new_image", F.format_string("%s_%04d", "source", n))


def replaced_source(manifest: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """The manifest with one source's rows replaced."""
    return manifest.filter(F.col("source") != source).unionByName(fresh).orderBy(split_order(F.col("split")), "source", "image")


def with_manifest(samples: DataFrame, manifest: DataFrame, inferred: Column) -> DataFrame:
    """The manifest's source where it has the image, else the inferred one."""
    m = manifest.select("image", F.col("source").alias("_source"))
    return samples.join(m, "image", "left").withColumn("source", F.coalesce("_source", inferred)).drop("_source")


def cover_gaps(manifest: DataFrame, listing: DataFrame, key: str = "image") -> DataFrame:
    """key, side of what only the manifest or only the directory has: a symmetric difference."""
    a, b = manifest.select(key), listing.select(key)
    return a.exceptAll(b).withColumn("side", F.lit("manifest")).unionByName(b.exceptAll(a).withColumn("side", F.lit("directory")))


def label_stats(instances: DataFrame, small: float = 0.005, tiny: float = 0.001) -> DataFrame:
    """image, area, edge -> image, n, min_area (0 for none), small, tiny, edge; areas strictly under the bounds."""
    return instances.groupBy("image").agg(F.count("*").alias("n"), F.coalesce(F.min("area"), F.lit(0.0)).alias("min_area"), F.count_if(F.col("area") < small).alias("small"), F.count_if(F.col("area") < tiny).alias("tiny"), F.count_if("edge").alias("edge"))


#: Reasons in order, and what each adds to the repeat.
REPEAT_RULES = (("dense_instances>=8", 2), ("multi_instances>=5", 1), ("small_instances>=3", 2), ("small_instances>=1", 1), ("tiny_instances>=1", 1), ("edge_instances>=2", 1), ("team128_hard_source", 1))


def repeats(stats: DataFrame, hard_source: Column, most: int = 5) -> DataFrame:
    """repeat (1..most) and reasons. Rules add up; ``base`` is the reason of what none raises."""
    n, small, tiny, edge = (F.col(c) for c in ("n", "small", "tiny", "edge"))
    when = [n >= 8, (n >= 5) & (n < 8), small >= 3, (small >= 1) & (small < 3), tiny >= 1, edge >= 2, hard_source & ((small >= 1) | (n >= 4))]
    rules = [(w, plus, name) for w, (name, plus) in zip(when, REPEAT_RULES)]
    total = F.lit(1)
    for when, plus, _ in rules:
        total = total + F.when(when, plus).otherwise(0)
    out = stats.withColumn("repeat", F.least(F.lit(most), F.greatest(F.lit(1), total)))
    found = F.filter(F.array(*(F.when(when, F.lit(name)) for when, _, name in rules)), lambda x: x.isNotNull())
    return out.withColumn("reasons", F.array_join(F.when(F.col("repeat") == 1, F.concat(found, F.array(F.lit("base")))).otherwise(found), ","))


def oversampled(rows: DataFrame) -> DataFrame:
    """Each path as often as its repeat says."""
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("repeat"))).alias("copy"))


def with_negatives(paths: DataFrame, negatives: DataFrame) -> DataFrame:
    """Training paths, then negatives, in order."""
    return paths.withColumn("part", F.lit(0)).unionByName(negatives.withColumn("part", F.lit(1)))


def large_targets(images: DataFrame, instances: DataFrame, least: float, drop_edge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images with the instances kept, empty ones too; counters by split)."""
    good = (F.col("area") >= least) & (~F.col("edge") if drop_edge else F.lit(True)) & F.col("parsed")
    kept = instances.filter(good)
    counters = instances.groupBy("split").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("removed"))
    return images.join(kept, ["split", "image"], "left"), counters


#: What a reviewer is asked to do, by the first rule that holds: two or more unreachable truths; four or more missed of
#: eight or more; four or more false; two or more missed; else.
ACTIONS = (
    "复核不可达 GT：优先确认是否为极小碎片、边缘截断或非抓取目标",
    "补充同类密集/遮挡场景，并复核漏标或实例边界",
    "复核误检来源：叶片、藤蔓、阴影、局部纹理或半目标",
    "复核小目标和遮挡目标是否符合全实例标注口径",
    "抽检确认标注口径一致",
)
#: What is suggested for an instance: unreachable and small; unreachable at the edge; unreachable; tiny; at the edge in a queued
#: image; narrow in a queued image; else. And the width or height up to which it is narrow.
SUGGESTIONS = (
    "优先复核：不可达且极小，可能是碎片/非目标/口径不一致",
    "优先复核：不可达且贴边，可能是截断目标或边界口径问题",
    "优先复核：模型无可匹配预测，需确认标注边界或补充同类样本",
    "抽检：极小实例，确认是否应进入全实例标注",
    "抽检：错误高发图中的贴边实例",
    "抽检：错误高发图中的细长/局部实例",
    "保留观察",
)
NARROW = 0.015
#: Why a truth was missed: its best prediction lacks confidence; it lacks area; else.
CAUSES = (
    "漏检来自置信度不足：补充相似样本或考虑局部降低阈值",
    "漏检来自面积门控过滤：复核目标面积阈值或标注尺寸",
    "真实漏检/形状不匹配：优先补充同类遮挡、密集或视角样本",
)


def miss_cause(iou: Column, conf: Column, area: Column, match_iou: float, least_conf: float, least_area: float) -> Column:
    """Why a truth was missed, from its best prediction (0 for none)."""
    return F.when((iou >= match_iou) & (conf < least_conf), CAUSES[0]).when((iou >= match_iou) & (area < least_area), CAUSES[1]).otherwise(CAUSES[2])


def errors(rows: DataFrame, conf: float, match_iou: float, least_area: float) -> DataFrame:
    """``matching.of_lists`` rows with all predictions -> image, source, type, idx, best_idx, best_iou, cause: the predictions of that confidence that no
    truth is matched with (FP) and the truths missed (FN), each with the partner it overlaps most. All within the row."""
    from . import matching

    made = rows.withColumn("done", matching.greedily_matched(matching.selected(F.col("preds"), conf), match_iou)).withColumn("truths", matching.best_of_truths(F.col("preds"), F.col("truths")))
    row = lambda kind, idx, best, cause: F.struct(F.lit(kind).alias("type"), idx.alias("idx"), F.coalesce(best["idx"], F.lit(-1)).alias("best_idx"), F.coalesce(best["iou"], F.lit(0.0)).alias("best_iou"), cause.alias("cause"))
    gts_of = lambda idx: F.get(F.filter("preds", lambda p: p["idx"] == idx), F.lit(0))["gts"]
    fp = F.transform(F.filter("done", lambda d: d["gt"] < 0), lambda d: row("FP", d["idx"], F.get(gts_of(d["idx"]), F.lit(0)), F.lit("")))
    taken = F.transform("done", lambda d: d["gt"])
    zero = lambda b, c: F.coalesce(b[c], F.lit(0.0))
    fn = F.transform(F.filter("truths", lambda t: ~F.array_contains(taken, t["idx"])), lambda t: row("FN", t["idx"], t["best"], miss_cause(zero(t["best"], "iou"), zero(t["best"], "conf"), zero(t["best"], "area"), match_iou, conf, least_area)))
    return made.select("image", "source", F.explode(F.concat(fp, fn)).alias("e")).select("image", "source", "e.*")


def error_counts(rows: DataFrame, conf: float, match_iou: float) -> DataFrame:
    """``matching.of_lists`` rows with all predictions -> image, gt, fp, fn, unreachable (truths that no prediction overlaps at the threshold)."""
    from . import matching

    done = matching.counted(rows.withColumn("kept", matching.selected(F.col("preds"), conf)), ["image", "preds", "truths"], match_iou)
    lost = F.filter(matching.best_of_truths(F.col("preds"), F.col("truths")), lambda t: F.coalesce(t["best"]["iou"], F.lit(0.0)) < match_iou)
    return done.select("image", F.col("n_gt").alias("gt"), "fp", "fn", F.size(lost).alias("unreachable"))


def review_queue(images: DataFrame, most: int | None = None) -> DataFrame:
    """image, gt, fp, fn, unreachable -> score, action, in order of score, unreachable, fn, fp (falling), then as given (seq)."""
    fn, fp, un = F.col("fn"), F.col("fp"), F.col("unreachable")
    out = images.withColumn("score", 5 * fn + 2 * fp + 8 * un + F.col("gt"))
    a = ACTIONS
    action = F.when(un >= 2, a[0]).when((fn >= 4) & (F.col("gt") >= 8), a[1]).when(fp >= 4, a[2]).when(fn >= 2, a[3]).otherwise(a[4])
    ordered = out.withColumn("action", action).orderBy(F.desc("score"), F.desc("unreachable"), F.desc("fn"), F.desc("fp"), "seq")
    return ordered.limit(most) if most else ordered


def instance_priority(rows: DataFrame, small: float = 0.005, tiny: float = 0.001) -> DataFrame:
    """area, edge, box_w, box_h, reachable (text; only ``False`` is unreachable, a missing row is not), queued -> priority and suggestion."""
    missed, area = F.coalesce(F.col("reachable") == "False", F.lit(False)), F.col("area")
    score = F.when(missed, 100).otherwise(0) + F.when(area <= tiny, 40).when(area <= small, 20).otherwise(0) + F.when(F.col("edge"), 15).otherwise(0) + F.when(F.col("queued"), 10).otherwise(0)
    t, narrow = SUGGESTIONS, F.least("box_w", "box_h") <= NARROW
    text = F.when(missed & (area <= small), t[0]).when(missed & F.col("edge"), t[1]).when(missed, t[2]).when(area <= tiny, t[3]).when(F.col("edge") & F.col("queued"), t[4]).when(narrow & F.col("queued"), t[5]).otherwise(t[6])
    return rows.withColumn("priority", score).withColumn("suggestion", text)


def audit_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("priority"), F.asc("area"), F.desc("image"), F.desc("idx"))


def scene_manifest(assets: DataFrame) -> DataFrame:
    """scene, members, splits, n, cross_split."""
    return assets.groupBy("scene").agg(F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("members"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("n"), (F.count_distinct("split") > 1).alias("cross_split"))


def counts_cube(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by each of the columns, all of them, and in all; what is summed over is ``all``."""
    return rows.cube(*by).agg(F.count("*").alias("n")).select(*(F.coalesce(c, F.lit("all")).alias(c) for c in by), "n")


def largest(images: DataFrame) -> DataFrame:
    """The image of most pixels, of equals the first by name."""
    return images.withColumn("pixels", F.col("width").cast("long") * F.col("height")).orderBy(F.desc("pixels"), "image").limit(1)


def hard_negatives(rows: DataFrame, conf: float, low: float, high: float, max_iou: float) -> DataFrame:
    """Predictions confident enough, of a size in low..high, that overlap no truth by more than max_iou."""
    return rows.filter((F.col("conf") >= conf) & F.col("area").between(low, high) & (F.col("best_iou") <= max_iou))
