"""Two-model policies and the search for a policy per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sinks import label_line
from .matching import met, suppressed
from .metrics import with_rates
from .order import small
from .pairs import supported

#: The policy of a source that has none: confidence, suppression IoU and least area.
DEFAULT_POLICY = (0.5, 0.075, 0.0)


def policy_of(rows: DataFrame, policies: DataFrame, default=DEFAULT_POLICY) -> DataFrame:
    """rows with conf_t, nms_t, area_t of their source's policy (source, conf_t, nms_t, area_t), or the default."""
    out = rows.join(F.broadcast(policies), "source", "left")  # a row a source, as many as were tuned
    for name, value in zip(("conf_t", "nms_t", "area_t"), default):
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


#: What an export does with a source that has no policy: confidence, area, support, support IoU, suppression IoU.
EXPORT_DEFAULT = {"confidence_threshold": 0.4, "min_area_ratio": 0.0004, "min_support": 1, "support_iou_threshold": 0.35, "nms_iou_threshold": 0.3}
#: Rows of policies that are broadcast; more are joined by source.
FEW_POLICIES = 100_000


def exported(lists: DataFrame, policies: DataFrame | None, shared, models: tuple[str, str], default: dict = EXPORT_DEFAULT) -> DataFrame:
    """``matching.gathered`` rows (source, p with points) -> image, source, the policy that held, selected_a, selected_b, candidates, kept, kept_a, kept_b,
    and labels: the text of the image's label file, empty where nothing is kept.

    policies: source and the columns of EXPORT_DEFAULT; a source without a row goes by the default, and None is one policy for all. They
    are values of the image's row, so thresholds differ from row to row in one plan. Support 2 asks for a candidate of the other model; suppression goes
    by falling confidence, of equals model A's first.
    """
    rows = lists
    if policies is not None:
        rows = lists.join(small(policies.select("source", *(F.col(c).alias(f"_{c}") for c in default)), FEW_POLICIES), "source", "left")
    rows = rows.select("image", "source", "p", *(F.coalesce(F.col(f"_{c}"), F.lit(v)).alias(c) if policies is not None else F.lit(v).alias(c) for c, v in default.items()))
    place = lambda x: F.when(x["model"] == models[0], 0).otherwise(1)
    able = F.filter("p", lambda x: x["model"].isin(*models) & (x["shape"]["n"] > 0) & (x["conf"] >= F.col("confidence_threshold")) & (x["area"] >= F.col("min_area_ratio")))
    ordered = F.array_sort(F.transform(able, lambda x: F.struct(x["m"].alias("m"), place(x).alias("place"), x["idx"].alias("idx"), x["points"].alias("points"), x["shape"].alias("shape"))))
    rows = rows.withColumn("s", ordered).withColumn("s", F.transform("s", lambda x, i: x.withField("rank", i + 1)))
    over = lambda x: met(x, F.filter(F.col("s"), lambda y: y["rank"] != x["rank"]), shared, "rank", "place")
    rows = rows.withColumn("s", F.transform("s", lambda x: F.struct(x["rank"].alias("rank"), x["place"].alias("place"), (-x["m"]).alias("conf"), x["points"].alias("points"), over(x).alias("near"))))
    t = F.col("support_iou_threshold")
    other = lambda x: F.exists(x["near"], lambda y: (y["place"] != x["place"]) & (y["iou"] >= t)) | ((t <= 0) & F.exists("s", lambda y: y["place"] != x["place"]))
    rows = rows.withColumn("c", F.filter("s", lambda x: (F.col("min_support") != 2) | other(x)))
    rows = rows.withColumn("k", suppressed(F.col("c"), F.col("nms_iou_threshold")))
    count = lambda c, k: F.size(F.filter(c, lambda x: x["place"] == k))
    line = lambda x: F.concat(label_line(x["points"], F.lit(0), x["conf"]), F.lit("\n"))
    return rows.select("image", "source", *default, count("s", 0).alias("selected_a"), count("s", 1).alias("selected_b"), F.size("c").alias("candidates"), F.size("k").alias("kept"), count("k", 0).alias("kept_a"), count("k", 1).alias("kept_b"), F.array_join(F.transform("k", line), "").alias("labels"))


def export_summary(manifest: DataFrame) -> DataFrame:
    """exported() -> a row per source and one (source null, whole true) of all: images, selected, candidates and kept."""
    sums = ("selected_a", "selected_b", "candidates", "kept", "kept_a", "kept_b")
    return manifest.rollup("source").agg(F.count("*").alias("images"), *(F.sum(c).alias(c) for c in sums), (F.grouping("source") == 1).alias("whole"))


def two_model_candidates(preds: DataFrame, pairs: DataFrame, conf: float, area: float, min_support: int, support_iou: float) -> DataFrame:
    """What suppression then works on: confident and large enough, and with min_support 2 only those that the other
    model supports; seq orders model A's before B's."""
    chosen = preds.filter((F.col("conf") >= conf) & (F.col("area") >= area))
    if min_support >= 2:
        on = lambda k: [F.col("p.image") == F.col("c.image"), F.col(f"p.{k}") == F.col("c.idx")]
        among = pairs
        for k in ("a_idx", "b_idx"):
            among = among.alias("p").join(chosen.select("image", "idx").alias("c"), on(k), "left_semi")
        chosen = supported(chosen, among, support_iou)
    return chosen.withColumn("seq", F.row_number().over(Window.partitionBy("image").orderBy("model", "idx")))


def pareto(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States (tp, fp, path) that no other beats: falling tp, rising fp, kept where fp is below every one before. Per
    (tp, fp) the first path stays. One row per distinct tp enters the running minimum."""
    by = by or []
    firsts = states.groupBy(*by, "tp").agg(F.min(F.struct("fp", "path")).alias("s")).select(*by, "tp", "s.fp", "s.path")
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("tp")).rowsBetween(Window.unboundedPreceding, -1)
    return firsts.withColumn("least", F.min("fp").over(before)).filter("least IS NULL OR fp < least").drop("least")


def source_policies(per_source: DataFrame, n_gt: int) -> DataFrame:
    """source, grid_seq, tp, fp -> tp, fp, path and rates of every total that a choice of one setting per source can reach
    and none beats. Sources are added in order, and what is beaten goes after each: a state is a pair of totals, so there are
    at most as many as true positives."""
    now = None
    for r in per_source.select("source").distinct().orderBy("source").collect():  # a row a source
        own = per_source.filter(F.col("source") == r["source"]).select("tp", "fp", F.format_string("%05d", "grid_seq").alias("path"))
        own = pareto(own)
        if now is None:
            now = own
            continue
        both = now.crossJoin(F.broadcast(own.select(F.col("tp").alias("t"), F.col("fp").alias("f"), F.col("path").alias("q"))))  # a setting's grid
        now = pareto(both.select((F.col("tp") + F.col("t")).alias("tp"), (F.col("fp") + F.col("f")).alias("fp"), F.concat_ws(",", "path", "q").alias("path")))
    return with_rates(now.withColumn("fn", F.lit(n_gt) - F.col("tp")))


def transferred(tuned: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Each policy's result on the data it was tuned on beside that on the other: a join by name."""
    own = tuned.select("policy", *(F.col(c).alias(f"tuned_{c}") for c in ("precision", "recall", "f1")))
    return evaluated.join(own, "policy")


def frozen_threshold(curve: DataFrame, other: DataFrame) -> DataFrame:
    """The row of the other curve at the threshold that is best on the first (by f1, recall, threshold): the lowest of its
    thresholds not below it."""
    best = curve.orderBy(F.desc("f1"), F.desc("recall"), F.desc("threshold")).limit(1).select(F.col("threshold").alias("chosen"))
    return other.crossJoin(F.broadcast(best)).filter(F.col("threshold") >= F.col("chosen")).orderBy("threshold").limit(1)


def grid(spark, **values: list) -> DataFrame:
    """Every combination, numbered in order; distinct values, ascending."""
    out = spark.range(1).select()
    for name, given in values.items():
        out = out.crossJoin(spark.createDataFrame([(float(v),) for v in sorted(set(given))], f"{name} double"))
    return out.withColumn("grid_seq", F.row_number().over(Window.orderBy(*values)) - 1)


def merged_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Model A's rows, then model B's, with seq over both."""
    both = a.withColumn("_m", F.lit(0)).unionByName(b.withColumn("_m", F.lit(1)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("image").orderBy("_m", "idx")) - 1).drop("_m")


def priority_order(preds: DataFrame) -> DataFrame:
    """rank by priority, confidence and area, falling: the order in which prompts' candidates suppress each other."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("priority"), F.desc("conf"), F.desc("area"), "idx")))


def learned_order(preds: DataFrame, score: Column) -> DataFrame:
    """rank by a learned score (a probability, or it times the confidence)."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(score.desc(), "idx")))


def ignoring(matched: DataFrame, pairs: DataFrame, ignored: DataFrame, threshold: float, best_only: bool = False) -> DataFrame:
    """Unmatched predictions (gt -1) that overlap an ignored truth at the threshold are neither right nor wrong: any such
    truth, or with best_only only if it is the one they overlap most."""
    over = pairs.filter(F.col("iou") >= threshold)
    if best_only:
        best = pairs.groupBy("image", "p_idx").agg(F.max(F.struct("iou", (-F.col("g_idx")).alias("m"))).alias("b"))
        over = best.select("image", "p_idx", (-F.col("b.m")).alias("g_idx"), F.col("b.iou").alias("iou")).filter(F.col("iou") >= threshold)
    hit = over.join(ignored.select("image", F.col("idx").alias("g_idx")), ["image", "g_idx"], "left_semi").select("image", F.col("p_idx").alias("idx")).distinct().withColumn("_hit", F.lit(True))
    return matched.join(hit, ["image", "idx"], "left").withColumn("ignored", (F.col("gt") < 0) & F.coalesce("_hit", F.lit(False))).drop("_hit")


def target_truths(truths: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(targets, ignored): of an area in low..high and clear of the edge. Touching the image's edge always ignores."""
    good = F.col("area").between(low, high) & (F.col("edge") > 0)
    return truths.filter(good), truths.filter(~good)
