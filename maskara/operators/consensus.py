"""Agreement of models under a grid of settings, as folds over an image's predictions.

Overlaps are made once for the whole grid, and so are members, representatives, suppression and matching: settings are bits (``settings``).
An image without predictions takes part with none; a prediction without a model counts no support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import matching, pairs as overlaps, settings

NEAR = "array<struct<idx: int, iou: double>>"
PREDS = f"array<struct<rank: int, idx: int, conf: double, area: double, model: string, near: {NEAR}, gts: array<struct<iou: double, idx: int>>>>"


def per_image(images: DataFrame, preds: DataFrame, gts: DataFrame, pairs: DataFrame, pred_pairs: DataFrame) -> DataFrame:
    """One row per image of the list: n_gt and preds in order of rank, each with all that overlap it and its truths by falling IoU."""
    order = overlaps.ranked(preds).select("image", "idx", "rank", "conf", "area", "model")
    near = overlaps.both_ways(pred_pairs.filter("iou > 0")).groupBy("image", "idx").agg(F.collect_list(F.struct(F.col("other").alias("idx"), "iou")).alias("near"))
    rows = order.join(near, ["image", "idx"], "left").join(matching.truth_lists(pairs), ["image", "idx"], "left")
    lists = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "conf", "area", "model", F.coalesce("near", F.array().cast(NEAR)).alias("near"), "gts"))).cast(PREDS).alias("preds"))
    n = gts.groupBy("image").agg(F.count("*").cast("int").alias("n_gt"))
    return images.join(n, "image", "left").join(lists, "image", "left").select(*images.columns, F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("preds", F.array().cast(PREDS)).alias("preds"))


def of_lists(lists: DataFrame, shared) -> DataFrame:
    """The same from ``matching.gathered`` rows, with overlaps made within the row by ``shared``."""
    kept = [c for c in lists.columns if c not in ("p", "t")]
    own = lambda x, i: F.struct((i + 1).alias("rank"), x["idx"].alias("idx"), x["conf"].alias("conf"), x["area"].alias("area"), x["model"].alias("model"), matching.met(x, F.filter(F.col("p"), lambda y: y["idx"] != x["idx"]), shared, "idx").alias("near"), matching.falling(matching.met(x, F.col("t"), shared, "idx")).alias("gts"))
    return lists.select(*kept, F.size("t").alias("n_gt"), F.transform("p", own).cast(PREDS).alias("preds"))


def _each_near(near: Column, idx: Column, values: list, holds) -> Column:
    """Bits of the settings under which a prediction of that idx is among the neighbours with an IoU that holds."""
    return settings.any_of(F.filter(near, lambda z: z["idx"] == idx), lambda z: settings.where(values, lambda v: holds(z["iou"], v)))


def _enough(members: Column, least: list) -> Column:
    """Bits of the settings whose least support the members' models reach; a counter of bits: place k says where k models or more were seen."""
    levels = [max(v, 0) for v in least if v is not None]
    models = F.array_distinct(F.filter(F.transform(members, lambda m: m["model"]), lambda x: x.isNotNull()))

    def step(seen, model):
        own = settings.any_of(F.filter(members, lambda m: m["model"] == model), lambda m: m["bits"])
        return F.transform(seen, lambda a, k: F.when(k == 0, a).otherwise(a.bitwiseOR(F.get(seen, k - 1).bitwiseAND(own))))

    def of(seen):
        out = settings.long(0)
        for k in sorted(set(levels)):
            out = out.bitwiseOR(F.get(seen, F.lit(k)).bitwiseAND(settings.long(sum(1 << i for i, v in enumerate(least) if v is not None and max(v, 0) == k))))
        return out

    return F.aggregate(models, F.array(settings.long(-1), *(settings.long(0) for _ in range(max(levels, default=0)))), step, of)


def with_bits(rows: DataFrame, parts: list[list], match_iou: float) -> tuple[DataFrame, dict[str, list[str]]]:
    """rows with the bits of the settings (``settings.words``) under which each candidate is kept and each pair is matched; and the columns of each.

    A candidate is a seed whose members (itself and those at the threshold) come from enough models, and their most confident one; both depend on the setting, so
    each seed stands once with each member that speaks for it under some. Candidates go by falling score, then by seed; one whose speaker overlaps that of
    another kept before by more than the threshold, or is the same, is not kept.
    """
    names = {k: [f"_{k}_{w}" for w in range(len(parts))] for k in ("n_kept", "tp")}
    most = "array<struct<rank: int, bits: bigint>>"
    for w, some in enumerate(parts):
        of = lambda c: [r[c] for r in some]
        sel, seeds, chosen, kept, tp = f"_sel_{w}", f"_seeds_{w}", f"_chosen_{w}", names["n_kept"][w], names["tp"][w]
        rows = rows.withColumn(sel, F.transform("preds", lambda p: settings.where(of("conf"), lambda v: p["conf"] >= v).bitwiseAND(settings.where(of("min_area"), lambda v: p["area"] >= v))))

        def members(p):
            same = lambda m: F.when(m["idx"] == p["idx"], settings.long(-1)).otherwise(_each_near(p["near"], m["idx"], of("support_iou"), lambda iou, v: iou >= v))
            bits = lambda m: same(m).bitwiseAND(F.get(F.col(sel), m["rank"] - 1)).bitwiseAND(F.get(F.col(sel), p["rank"] - 1))
            return F.filter(F.transform("preds", lambda m: F.struct(m["rank"].alias("rank"), m["model"].alias("model"), bits(m).alias("bits"))), lambda m: m["bits"] != 0)

        def speakers(x):
            def step(done, m):
                before = settings.any_of(done, lambda d: d["bits"])
                return F.array_append(done, F.struct(m["rank"].alias("rank"), settings.less(m["bits"], before).alias("bits")))

            return F.aggregate(x["members"], F.array().cast(most), step)

        def candidates(x):
            speaks = lambda d: F.struct((-F.get("preds", d["rank"] - 1)["conf"]).alias("m"), x["seed"].alias("seed"), d["rank"].alias("rank"), d["bits"].bitwiseAND(x["enough"]).alias("bits"))
            return F.filter(F.transform(speakers(x), speaks), lambda d: d["bits"] != 0)

        rows = rows.withColumn(seeds, F.transform("preds", lambda p: F.struct(p["idx"].alias("seed"), members(p).alias("members"))))
        rows = rows.withColumn(seeds, F.transform(seeds, lambda x: x.withField("enough", _enough(x["members"], of("min_support")))))
        rows = rows.withColumn(chosen, F.array_sort(F.flatten(F.transform(seeds, candidates))))

        def step(done, c):
            own = F.get("preds", c["rank"] - 1)
            shut = lambda d: F.when(d["rank"] == c["rank"], settings.long(-1)).otherwise(_each_near(own["near"], F.get("preds", d["rank"] - 1)["idx"], of("nms_iou"), lambda iou, v: iou > v))
            hit = settings.any_of(done, lambda d: d["bits"].bitwiseAND(shut(d)))
            return F.array_append(done, F.struct(c["rank"].alias("rank"), settings.less(c["bits"], hit).alias("bits")))

        rows = rows.withColumn(f"_{kept}", F.aggregate(chosen, F.array().cast(most), step))
        gts = lambda c: F.filter(F.coalesce(F.get("preds", c["rank"] - 1)["gts"], F.array().cast("array<struct<iou: double, idx: int>>")), lambda z: z["iou"] >= match_iou)
        pairs = F.flatten(F.transform(f"_{kept}", lambda c, i: F.transform(gts(c), lambda z: F.struct(i.alias("p"), z["idx"].alias("t"), c["bits"].alias("bits")))))
        rows = rows.withColumn(tp, settings.won(pairs)).withColumn(kept, F.transform(f"_{kept}", lambda c: c["bits"]))
    return rows, names


def evaluated(rows: DataFrame, grid: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """image columns, grid columns, n_gt, n_kept, tp, fp, fn under every setting (conf, min_area, min_support, support_iou, nms_iou); the grid is broadcast."""
    keep = [c for c in rows.columns if c not in ("preds", "n_gt")]
    table, parts = settings.words(grid)
    made, names = with_bits(rows, parts, match_iou)
    return matching.with_misses(settings.per_setting(made, table, [*keep, "n_gt"], names)).select(*keep, *grid.columns, "n_gt", "n_kept", "tp", "fp", "fn")


def evaluated_totals(rows: DataFrame, grid: DataFrame, by: list[str], match_iou: float = 0.5) -> DataFrame:
    """``by``, n_kept, tp, n_gt, images, fp, fn: sums of evaluated(), without a row for each image and setting."""
    table, parts = settings.words(grid)
    made, names = with_bits(rows, parts, match_iou)
    return matching.with_misses(settings.totals(made, table, by, names))
