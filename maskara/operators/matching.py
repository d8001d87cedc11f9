"""Suppression and matching. Greedy forms are folds over an image's predictions in order of confidence, in the JVM; maximum
matchings need augmenting paths and run in Python, an image at a time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import settings
from .masks import compared, over_union
from .order import each_of, sorted_groups
from .pairs import ranked

RANKED = "array<struct<rank: int, idx: int, conf: double, area: double, edge: double, near: array<struct<rank: int, iou: double>>, gts: array<struct<iou: double, idx: int>>>>"


def truth_lists(pairs: DataFrame) -> DataFrame:
    """image, idx, gts: the truths each prediction overlaps, by falling IoU."""
    return pairs.filter("iou > 0").groupBy("image", F.col("p_idx").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("m"), F.col("g_idx").alias("idx")))), lambda x: F.struct((-x["m"]).alias("iou"), x["idx"].alias("idx"))).alias("gts"))


def per_image(images: DataFrame, preds: DataFrame, gts: DataFrame, pairs: DataFrame, pred_pairs: DataFrame) -> DataFrame:
    """One row per image of the list: n_gt and preds, in order of rank, each with the earlier-ranked ones it overlaps and
    its truths by falling IoU. Everything a grid of settings needs is computed here once.

    preds: image, idx, conf, area, edge; gts: image, idx; pairs, pred_pairs: as of module ``pairs``.
    """
    order = ranked(preds).select("image", "idx", "rank", "conf", "area", "edge")
    rank = order.select("image", F.col("idx").alias("i"), F.col("rank").alias("r"))
    met = pred_pairs.filter("iou > 0").join(rank.select("image", F.col("i").alias("a_idx"), F.col("r").alias("ra")), ["image", "a_idx"]).join(rank.select("image", F.col("i").alias("b_idx"), F.col("r").alias("rb")), ["image", "b_idx"])
    near = met.groupBy("image", F.greatest("ra", "rb").alias("rank")).agg(F.collect_list(F.struct(F.least("ra", "rb").alias("rank"), "iou")).alias("near"))
    rows = order.join(near, ["image", "rank"], "left").join(truth_lists(pairs), ["image", "idx"], "left")
    lists = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "conf", "area", "edge", "near", "gts"))).cast(RANKED).alias("preds"))
    n = gts.groupBy("image").agg(F.count("*").cast("int").alias("n_gt"))
    return images.join(n, "image", "left").join(lists, "image", "left").select(*images.columns, F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("preds", F.array().cast(RANKED)).alias("preds"))


def gathered(rows: DataFrame, least: float = 0.0, *keep: str, also: tuple[str, ...] = (), strips: bool = False) -> DataFrame:
    """One row per image, by one shuffle of what takes part: its ``keep`` columns, ``p`` (predictions of that confidence or more, in
    order of rank, with the columns ``also``) and ``t`` (truths by idx).

    rows: image, idx, gt, model, conf, area, edge, shape, and columns that an image's rows share. A prediction without a confidence takes no part.
    Shapes of ``masks.with_outlines`` are drawn and compared here, and keep their words only if ``strips``.
    """
    sorted_groups(rows.sparkSession)
    p = F.when(~F.col("gt") & (F.col("conf") >= least), F.struct((-F.col("conf")).alias("m"), "idx", "conf", "model", "area", "edge", "shape", *also))
    t = F.when(F.col("gt"), F.struct("idx", "area", "edge", "shape"))
    lists = (F.array_sort(F.collect_list(x)) for x in (p, t))
    out = rows.groupBy("image").agg(*(F.min(c).alias(c) for c in keep), *(x.alias(n) for x, n in zip(lists, "pt")))
    return compared(out, strips) if "points" in rows.schema["shape"].dataType.fieldNames() else out


def met(x: Column, others: Column, shared, *names: str) -> Column:
    """Of an array, the elements that share pixels with x: their names and iou."""
    found = F.filter(F.transform(others, lambda y: F.struct(*(y[c].alias(c) for c in names), shared(x["shape"], y["shape"]).alias("n"), y["shape"]["n"].alias("of"))), lambda y: y["n"] > 0)
    return F.transform(found, lambda y: F.struct(*(y[c].alias(c) for c in names), over_union(y["n"], x["shape"]["n"], y["of"]).alias("iou")))


def falling(found: Column) -> Column:
    """(iou, idx) by falling IoU, ties by idx."""
    order = F.array_sort(F.transform(found, lambda y: F.struct((-y["iou"]).alias("m"), y["idx"].alias("idx"))))
    return F.transform(order, lambda y: F.struct((-y["m"]).alias("iou"), y["idx"].alias("idx")))


def with_truths(lists: DataFrame, shared) -> DataFrame:
    """As of_lists(), where nothing is suppressed: predictions are not compared with each other, and ``near`` is null."""
    return of_lists(lists, shared, near=False)


def of_lists(lists: DataFrame, shared, near: bool = True) -> DataFrame:
    """``gathered`` rows -> the rows of ``per_image``, and ``truths`` (idx, area, edge, shape); overlaps are made within the row by
    ``shared``, the pixels that two shapes have in common, so nothing is joined."""
    ranks = F.transform("p", lambda x, i: F.struct((i + 1).alias("rank"), x["idx"].alias("idx"), x["conf"].alias("conf"), x["area"].alias("area"), x["edge"].alias("edge"), x["shape"].alias("shape")))
    kept = [c for c in lists.columns if c not in ("p", "t")]
    ranked_ = lists.select(*kept, "t", ranks.alias("p"))
    one = lambda x: F.struct(x["rank"].alias("rank"), x["idx"].alias("idx"), x["conf"].alias("conf"), x["area"].alias("area"), x["edge"].alias("edge"), (met(x, F.slice(F.col("p"), 1, x["rank"] - 1), shared, "rank") if near else F.lit(None)).alias("near"), falling(met(x, F.col("t"), shared, "idx")).alias("gts"))
    return ranked_.select(*kept, F.size("t").alias("n_gt"), F.transform("p", one).cast(RANKED).alias("preds"), F.col("t").alias("truths"))


def best_of_truths(preds: Column, truths: Column) -> Column:
    """Each truth (its fields), with best: (idx, iou, conf, area) of the prediction that overlaps it most, of equals the first; null for none."""

    def best(t):
        over = F.flatten(F.transform(preds, lambda p: F.transform(F.filter(p["gts"], lambda z: z["idx"] == t["idx"]), lambda z: F.struct((-z["iou"]).alias("m"), p["idx"].alias("idx"), z["iou"].alias("iou"), p["conf"].alias("conf"), p["area"].alias("area")))))
        return F.array_min(over)

    return F.transform(truths, lambda t: t.withField("best", best(t)))


def selected(preds: Column, conf, area=0.0, edge=-1.0, most=float("inf")) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.filter(preds, lambda p: (p["conf"] >= as_col(conf)) & (p["area"] >= as_col(area)) & (p["edge"] >= as_col(edge)) & (p["area"] <= as_col(most)))


def suppressed(preds: Column, threshold) -> Column:
    """What greedy suppression keeps: each prediction unless one kept before it overlaps it by more than the threshold. The fold carries ranks alone."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)

    def step(kept, p):
        hit = F.coalesce(F.exists(p["near"], lambda z: (z["iou"] > t) & F.array_contains(kept, z["rank"])), F.lit(False))
        return F.when(hit, kept).otherwise(F.array_append(kept, p["rank"]))

    kept = F.aggregate(preds, F.array().cast("array<int>"), step)
    return F.filter(preds, lambda p: F.array_contains(kept, p["rank"]))


#: Columns of a row per image that its settings make counts of.
IN_ROW = ("preds", "n_gt", "truths")
TAKEN = "array<struct<idx: int, gt: int, iou: double>>"


def greedily_matched(preds: Column, threshold) -> Column:
    """(idx, gt, iou) of each prediction in order: its best truth that none took before it, if it reaches the threshold; else gt -1."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    start = F.struct(F.array().cast(TAKEN).alias("done"), F.array().cast("array<int>").alias("used"))

    def step(s, p):
        free = F.get(F.filter(F.coalesce(p["gts"], F.array().cast("array<struct<iou: double, idx: int>>")), lambda z: ~F.array_contains(s["used"], z["idx"])), F.lit(0))
        hit = F.coalesce(free["iou"] >= t, F.lit(False))
        own = F.struct(p["idx"].alias("idx"), F.when(hit, free["idx"]).otherwise(F.lit(-1)).alias("gt"), F.when(hit, free["iou"]).otherwise(F.lit(0.0)).alias("iou"))
        return F.struct(F.array_append(s["done"], own).alias("done"), F.when(hit, F.array_append(s["used"], free["idx"])).otherwise(s["used"]).alias("used"))

    return F.aggregate(preds, start, step, lambda s: s["done"])


def nms(rows: DataFrame, threshold: float, conf: float = 0.0, area: float = 0.0) -> DataFrame:
    """image, idx, conf of what is kept."""
    return each_of(rows.select("image", F.explode_outer(suppressed(selected(F.col("preds"), conf, area), threshold)).alias("p")), "p").select("image", "p.idx", "p.conf")


def matches(rows: DataFrame, threshold: float, conf: float = 0.0, nms_iou: float | None = None) -> DataFrame:
    """image, idx, gt, iou for every prediction that takes part."""
    chosen = selected(F.col("preds"), conf)
    chosen = suppressed(chosen, nms_iou) if nms_iou is not None else chosen
    return each_of(rows.select("image", F.explode_outer(greedily_matched(chosen, threshold)).alias("m")), "m").select("image", "m.idx", "m.gt", "m.iou")


#: Columns of a grid, and what of a prediction is to be no less.
LEASTS = {"conf": "conf", "min_area": "area", "min_edge": "edge"}


def with_bits(rows: DataFrame, parts: list[list], match_iou: float, leasts: dict[str, str] = LEASTS) -> tuple[DataFrame, dict[str, list[str]]]:
    """rows with the bits of the settings (``settings.words``) under which each prediction is selected and kept, and each pair is matched; and the columns of each."""
    names = {k: [f"_{k}_{w}" for w in range(len(parts))] for k in ("n_selected", "n_kept", "tp")}
    for w, some in enumerate(parts):
        of = lambda c: [r[c] for r in some]
        sel, kept, tp = (names[k][w] for k in names)
        rows = rows.withColumn(sel, F.transform("preds", lambda p: reduce(Column.bitwiseAND, (settings.where(of(c), lambda v, k=k: p[k] >= v) for c, k in leasts.items()))))

        def step(done, p):
            hit = settings.any_of(p["near"], lambda z: F.get(done, z["rank"] - 1).bitwiseAND(settings.where(of("nms_iou"), lambda v: z["iou"] > v)))
            return F.array_append(done, settings.less(F.get(F.col(sel), p["rank"] - 1), hit))

        rows = rows.withColumn(kept, F.aggregate("preds", F.array().cast(settings.NONE), step))
        pairs_ = F.flatten(F.transform("preds", lambda p: F.transform(F.filter(F.coalesce(p["gts"], F.array().cast("array<struct<iou: double, idx: int>>")), lambda z: z["iou"] >= match_iou), lambda z: F.struct(p["rank"].alias("p"), z["idx"].alias("t"), F.get(F.col(kept), p["rank"] - 1).alias("bits")))))
        rows = rows.withColumn(tp, settings.won(pairs_))
    return rows, names


def evaluated(rows: DataFrame, grid: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """image columns, grid columns, n_selected, n_gt, n_kept, tp, fp, fn: every image under every setting (conf, nms_iou, min_area, min_edge).

    The grid is a bounded relation of parameters and is broadcast; images are the rows that grow. Suppression and matching run once an image.
    """
    keep = [c for c in rows.columns if c not in IN_ROW]
    table, parts = settings.words(grid)
    made, names = with_bits(rows, parts, match_iou)
    return with_misses(settings.per_setting(made, table, [*keep, "n_gt"], names)).select(*keep, *grid.columns, "n_selected", "n_gt", "n_kept", "tp", "fp", "fn")


def evaluated_totals(rows: DataFrame, grid: DataFrame, by: list[str], match_iou: float = 0.5) -> DataFrame:
    """``by``, n_selected, n_kept, tp, n_gt, images, fp, fn: sums of evaluated(), without a row for each image and setting."""
    table, parts = settings.words(grid)
    made, names = with_bits(rows, parts, match_iou)
    return with_misses(settings.totals(made, table, by, names))


def with_misses(df: DataFrame) -> DataFrame:
    return df.withColumn("fp", F.col("n_kept") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def counted(rows: DataFrame, columns: list[str], match_iou: float) -> DataFrame:
    """The columns, n_gt, n_kept, tp, fp, fn of rows with n_gt and the predictions ``kept``."""
    done = rows.withColumn("tp", F.size(F.filter(greedily_matched(F.col("kept"), match_iou), lambda m: m["gt"] >= 0)))
    return done.select(*columns, "n_gt", F.size("kept").alias("n_kept"), "tp", (F.size("kept") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def grid_totals(done: DataFrame, by: list[str]) -> DataFrame:
    """Sums of evaluated() over images, with gt, selected_predictions and kept_predictions, then rates."""
    from .metrics import with_rates

    named = {"gt": "n_gt", "selected_predictions": "n_selected", "kept_predictions": "n_kept", "tp": "tp", "fp": "fp", "fn": "fn"}
    return with_rates(done.groupBy(*by).agg(*(F.sum(c).cast("long").alias(k) for k, c in named.items())))


def swept(rows: DataFrame, grid: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """As ``evaluated``, without suppression, under a grid of conf, min_area and max_area; it holds no setting of min_area over max_area."""
    keep = [c for c in rows.columns if c not in IN_ROW]
    wide = rows.repartition("image").crossJoin(F.broadcast(grid.filter("min_area <= max_area")))
    return counted(wide.withColumn("kept", selected(F.col("preds"), F.col("conf"), F.col("min_area"), -1.0, F.col("max_area"))), [*keep, *grid.columns], match_iou)


def _augment(adjacent: dict[int, list[int]], start: int, owner: dict[int, int], held: dict[int, int]) -> bool:
    """``held`` is the reverse of owner. Gives start a truth if some chain of reassignments allows it; a walk without recursion."""
    came: dict[int, int] = {}
    todo = [start]
    while todo:
        p = todo.pop()
        for g in adjacent.get(p, ()):
            if g in came:
                continue
            came[g] = p
            if g not in owner:
                while True:  # along the chain, back to start
                    p = came[g]
                    before = held.get(p)
                    owner[g], held[p] = p, g
                    if p == start:
                        return True
                    g = before
            todo.append(owner[g])
    return False


def maximum_matching(adjacent: dict[int, list[int]], order) -> dict[int, int]:
    """truth -> prediction of a maximum matching, by augmenting paths from each prediction in order."""
    owner: dict[int, int] = {}
    held: dict[int, int] = {}
    for p in order:
        if p in adjacent:
            _augment(adjacent, p, owner, held)
    return owner


def _adjacent(preds: list[dict], threshold: float) -> dict[int, list[int]]:
    out = {p["idx"]: [g["idx"] for g in p["gts"] or () if g["iou"] >= threshold] for p in preds}
    return {p: g for p, g in out.items() if g}


def maximum_tp(rows: DataFrame, threshold: float) -> DataFrame:
    """per_image() rows -> image, tp: size of the maximum matching over pairs at the threshold or more."""

    def count(batches):
        for batch in batches:
            tp = [len(maximum_matching(a := _adjacent(p, threshold), a)) for p in batch.column("preds").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(tp, pa.int64())], names=["image", "tp"])

    return rows.select("image", "preds").mapInArrow(count, "image long, tp long")


def matching_curve(rows: DataFrame, threshold: float) -> DataFrame:
    """per_image() rows -> score, tp, fp, fn at every distinct score: predictions enter by falling score, and each adds a
    true positive if the matching can be augmented. Per image one pass; then sums by score and a running total."""

    def gains(batches):
        for batch in batches:
            lists = batch.column("preds")
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy()).tolist()
            near, many = flat.field("gs"), flat.field("gs").value_lengths().to_numpy(zero_copy_only=False)
            gain, now, adjacent, owner, held = np.zeros(len(flat), dtype=np.int64), 0, {}, {}, {}
            for k in np.flatnonzero(many).tolist():  # in order of image and rank
                if k >= ends[now]:
                    adjacent, owner, held = {}, {}, {}
                    while k >= ends[now]:
                        now += 1
                adjacent[k] = near[k].as_py()
                gain[k] = _augment(adjacent, k, owner, held)
            sums = pa.table({"score": flat.field("conf"), "gain": gain}).group_by("score").aggregate([("gain", "sum"), ("gain", "count")])
            n = len(sums) + 1  # and a row of the truths
            columns = (sums.column("score").to_pylist() + [None], sums.column("gain_sum").to_pylist() + [0], sums.column("gain_count").to_pylist() + [0], [0] * (n - 1) + [sum(batch.column("n_gt").to_pylist())], [False] * (n - 1) + [True])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["score", "gain", "n", "n_gt", "whole"])

    from .metrics import running

    near = lambda p: F.transform(F.filter(F.coalesce(p["gts"], F.array().cast("array<struct<iou: double, idx: int>>")), lambda z: z["iou"] >= threshold), lambda z: z["idx"])
    slim = rows.select("n_gt", F.transform("preds", lambda p: F.struct(p["conf"].alias("conf"), near(p).alias("gs"))).alias("preds"))
    both = slim.mapInArrow(gains, "score double, gain long, n long, n_gt long, whole boolean").groupBy("score", "whole").agg(*(F.sum(c).alias(c) for c in ("gain", "n", "n_gt"))).persist()
    each = both.filter("NOT whole")
    n_gt = both.filter("whole").agg(F.sum("n_gt")).first()[0] or 0
    return running(each, "score", {"tp": "gain", "chosen": "n"}).select("score", "tp", (F.col("chosen") - F.col("tp")).alias("fp"), (F.lit(n_gt) - F.col("tp")).alias("fn"))


def perfect_matching(edges: DataFrame, sizes: DataFrame, threshold: float = 0.99) -> DataFrame:
    """group, perfect: whether two sets of equal size (sizes: group, n_left, n_right) match one to one at the threshold."""
    lists = edges.filter(F.col("iou") >= threshold).groupBy("group", "p_idx").agg(F.array_sort(F.collect_list("g_idx")).alias("gs")).groupBy("group").agg(F.collect_list(F.struct("p_idx", "gs")).alias("ps"))

    def count(batches):
        for batch in batches:
            n = [len(maximum_matching(a := {p["p_idx"]: p["gs"] for p in ps}, sorted(a))) for ps in batch.column("ps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(n, pa.int64())], names=["group", "n"])

    found = lists.mapInArrow(count, "group string, n long")
    return sizes.join(found, "group", "left").select("group", ((F.col("n_left") == F.col("n_right")) & (F.coalesce("n", F.lit(0)) == F.col("n_left"))).alias("perfect"))


def coco_hits(preds: Column, threshold: Column, most: int = 100) -> Column:
    """(conf, hit) of an image's first ``most`` predictions by the COCO rule: by falling confidence, the best free truth
    at or over the threshold; of equal IoUs the later truth wins. A fold."""
    kind = "array<struct<conf: double, gt: int>>"
    t = F.least(threshold, F.lit(1 - 1e-10))

    def step(done, p):
        free = F.filter(F.coalesce(p["gts"], F.array().cast("array<struct<iou: double, idx: int>>")), lambda z: (z["iou"] >= t) & ~F.array_contains(F.transform(done, lambda d: d["gt"]), z["idx"]))
        best = F.array_max(F.transform(free, lambda z: F.struct(z["iou"].alias("iou"), z["idx"].alias("idx"))))
        return F.array_append(done, F.struct(p["conf"].alias("conf"), F.coalesce(best["idx"], F.lit(-1)).alias("gt")))

    return F.transform(F.aggregate(F.slice(preds, 1, most), F.array().cast(kind), step), lambda d: F.struct(d["conf"].alias("conf"), (d["gt"] >= 0).alias("hit")))


def coco_matches(rows: DataFrame, thresholds: DataFrame, most: int = 100) -> DataFrame:
    """per_image() rows x thresholds -> threshold, image, rank (from 1), conf, hit. As matching goes by falling confidence, the first k of an
    image's detections are matched alike whatever comes after them."""
    hits = rows.crossJoin(F.broadcast(thresholds)).select("threshold", "image", F.posexplode_outer(coco_hits(F.col("preds"), F.col("threshold"), most)).alias("at", "h"))
    return each_of(hits, "h").select("threshold", "image", (F.col("at") + 1).alias("rank"), "h.conf", "h.hit")


def coco_hits_of(rows: DataFrame, thresholds: tuple[float, ...], most: int = 100) -> DataFrame:
    """As coco_matches(), a row a detection: image, rank, conf and hits, whether it is a hit at each threshold in turn."""
    made = rows.select("image", "preds", *(coco_hits(F.col("preds"), F.lit(float(t)), most).alias(f"_{i}") for i, t in enumerate(thresholds)))
    each = made.select("image", F.array(*(F.col(f"_{i}.hit") for i in range(len(thresholds)))).alias("all"), F.posexplode_outer(F.transform(F.slice("preds", 1, most), lambda p: p["conf"])).alias("at", "conf"))
    return each_of(each, "at").select("image", (F.col("at") + 1).alias("rank"), "conf", F.transform("all", lambda h: F.get(h, F.col("at"))).alias("hits"))


def packed_iou(a: np.ndarray, b: np.ndarray) -> float:
    """IoU of two masks packed to bits."""
    both = int(np.bitwise_count(a & b).sum())
    union = int(np.bitwise_count(a | b).sum())
    return both / union if both else 0.0


def spaced_crops(rows: DataFrame, per_image: int, share: float = 0.5) -> DataFrame:
    """image, conf, idx, x0, y0, x1, y1 -> the crops kept: by falling confidence, unless over ``share`` of a crop's own area lies in
    one kept before it; ``per_image`` at most. A fold, without Python."""
    listed = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("m"), "idx", "x0", "y0", "x1", "y1"))).alias("crops"))
    kind = "array<struct<m: double, idx: int, x0: int, y0: int, x1: int, y1: int>>"

    def step(kept, c):
        inter = lambda k: F.greatest(F.least(k["x1"], c["x1"]) - F.greatest(k["x0"], c["x0"]), F.lit(0)) * F.greatest(F.least(k["y1"], c["y1"]) - F.greatest(k["y0"], c["y0"]), F.lit(0))
        own = (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
        return F.when((F.size(kept) >= per_image) | F.exists(kept, lambda k: inter(k) > share * own), kept).otherwise(F.array_append(kept, c))

    return listed.select("image", F.explode(F.aggregate(F.col("crops").cast(kind), F.array().cast(kind), step)).alias("c")).select("image", "c.idx", (-F.col("c.m")).alias("conf"), "c.x0", "c.y0", "c.x1", "c.y1")


def first_in_order(rows: DataFrame, keys: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of the whole table in that order; a limit after a sort keeps only so many in each task."""
    return rows.orderBy(*keys).limit(most)
