"""Settings as bits against plain loops, setting by setting; more settings than a word holds."""

import random

from maskara.operators import consensus, matching

MATCH = 0.3
PREDS = "array<struct<rank: int, idx: int, conf: double, area: double, edge: double, near: array<struct<rank: int, iou: double>>, gts: array<struct<iou: double, idx: int>>>>"


def _image(rng):
    n, m = rng.randint(0, 6), rng.randint(0, 4)
    idx = rng.sample(range(10), n)
    conf = sorted((rng.choice((0.1, 0.3, 0.5, 0.7)) for _ in range(n)), reverse=True)
    iou = {(a, b): rng.choice((0.0, 0.25, 0.4, 0.6)) for a in range(n) for b in range(a)}
    over = [sorted(((rng.choice((0.1, 0.3, 0.4, 0.8)), t) for t in range(m) if rng.random() < 0.8), key=lambda z: (-z[0], z[1])) for _ in range(n)]
    return n, m, idx, conf, [rng.choice((0.05, 0.2)) for _ in range(n)], [rng.choice("aab") if rng.random() < 0.9 else None for _ in range(n)], iou, over


def _matched(order, over):
    used, tp = set(), 0
    for i in order:
        free = [z for z in over[i] if z[1] not in used]
        if free and free[0][0] >= MATCH:
            used.add(free[0][1])
            tp += 1
    return tp


def test_totals_of_many_settings(spark):
    rng = random.Random(3)
    images = [_image(rng) for _ in range(60)]
    rows = spark.createDataFrame(
        [(k, "ab"[k % 2], m, [(i + 1, idx[i], conf[i], area[i], 0.0, [(b + 1, iou[i, b]) for b in range(i)] or None, over[i] or None) for i in range(n)]) for k, (n, m, idx, conf, area, _, iou, over) in enumerate(images)],
        f"image int, source string, n_gt int, preds {PREDS}",
    )
    values = [(c, t, a, -1.0) for c in (0.1, 0.3, 0.4, 0.6, 0.9) for t in (0.0, 0.25, 0.3, 0.5, 0.55, 0.7, None) for a in (0.0, 0.1)]
    grid = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "grid_seq int, conf double, nms_iou double, min_area double, min_edge double")
    want, each = {}, {}
    for k, (n, m, idx, conf, area, _, iou, over) in enumerate(images):
        for s, (c, t, a, _) in enumerate(values):
            chosen, kept = [i for i in range(n) if conf[i] >= c and area[i] >= a], []
            for i in chosen:
                if t is None or not any(iou[i, b] > t for b in kept):
                    kept.append(i)
            each[k, s] = len(chosen), m, len(kept), _matched(kept, over)
            want["ab"[k % 2], s] = [x + y for x, y in zip(want.get(("ab"[k % 2], s), [0] * 5), (*each[k, s], 1))]
    got = matching.evaluated_totals(rows, grid, ["source", "grid_seq"], MATCH)
    assert {(r.source, r.grid_seq): [r.n_selected, r.n_gt, r.n_kept, r.tp, r.images] for r in got.collect()} == want
    assert got.filter("fp <> n_kept - tp OR fn <> n_gt - tp").count() == 0
    assert {(r.image, r.grid_seq): (r.n_selected, r.n_gt, r.n_kept, r.tp) for r in matching.evaluated(rows, grid, MATCH).collect()} == each


def test_consensus_totals_of_many_settings(spark):
    rng = random.Random(4)
    images = [_image(rng) for _ in range(60)]
    both = lambda iou, i, b: iou[max(i, b), min(i, b)]
    rows = spark.createDataFrame(
        [(k, m, [(i + 1, idx[i], conf[i], area[i], model[i], [(idx[b], both(iou, i, b)) for b in range(n) if b != i and both(iou, i, b) > 0], over[i] or None) for i in range(n)]) for k, (n, m, idx, conf, area, model, iou, over) in enumerate(images)],
        f"image int, n_gt int, preds {consensus.PREDS}",
    )
    values = [(c, a, k, s, t) for c in (0.1, 0.4) for a in (0.0, 0.1) for k in (0, 1, 2, 3) for s in (0.25, 0.5) for t in (0.2, 0.4, 0.6)]
    grid = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "grid_seq int, conf double, min_area double, min_support int, support_iou double, nms_iou double")
    want, each = {}, {}
    for im, (n, m, idx, conf, area, model, iou, over) in enumerate(images):
        for g, (c, a, k, s, t) in enumerate(values):
            chosen = [i for i in range(n) if conf[i] >= c and area[i] >= a]
            seeds = []
            for i in chosen:
                members = [b for b in chosen if b == i or both(iou, i, b) >= s]
                if len({model[b] for b in members} - {None}) >= k:
                    seeds.append((-conf[members[0]], idx[i], members[0]))
            kept = []
            for _, _, r in sorted(seeds):
                if not any(q == r or both(iou, q, r) > t for q in kept):
                    kept.append(r)
            each[im, g] = m, len(kept), _matched(kept, over)
            want[g] = [x + y for x, y in zip(want.get(g, [0] * 4), (*each[im, g], 1))]
    assert {r.grid_seq: [r.n_gt, r.n_kept, r.tp, r.images] for r in consensus.evaluated_totals(rows, grid, ["grid_seq"], MATCH).collect()} == want
    assert {(r.image, r.grid_seq): (r.n_gt, r.n_kept, r.tp) for r in consensus.evaluated(rows, grid, MATCH).collect()} == each


def test_no_row_for_an_image_and_a_setting(spark):
    """What meets the settings in ``grid_metrics`` are the few distinct words of bits, after a sum."""
    from maskara.plans import evaluation

    plan = evaluation.grid_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [_word") > plan.index("Join") and "Join Cross" not in plan


def test_one_shuffle_of_given_columns_and_no_sort_again(spark):
    """An image's rows are shuffled once, as they are read, and put into arrays in the order they have; features need no join of boxes."""
    from maskara.plans import curation, evaluation

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (evaluation.error_table, curation.feature_table, evaluation.max_cardinality_match):
            plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan parquet") == 1 and "ObjectHashAggregate" not in plan and "Join" not in plan
            assert "x0#" not in plan[plan.index("Exchange hashpartitioning") :]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_matching_curve_between_batches(spark):
    """Images that share a batch, images without predictions, truths in all batches: against the maximum matching of each prefix."""
    rng = random.Random(5)
    images = [_image(rng) for _ in range(40)]
    rows = spark.createDataFrame([(k, m, [(i + 1, idx[i], conf[i], area[i], 0.0, None, over[i] or None) for i in range(n)]) for k, (n, m, idx, conf, area, _, _, over) in enumerate(images)], f"image int, n_gt int, preds {PREDS}").repartition(3)
    got = {r.score: (r.tp, r.fp, r.fn) for r in matching.matching_curve(rows, MATCH).collect()}
    n_gt = sum(x[1] for x in images)
    for score in (0.1, 0.3, 0.5, 0.7):
        tp = n = 0
        for size, _, _, conf, _, _, _, over in images:
            some = [i for i in range(size) if conf[i] >= score]
            adjacent = {i: [t for v, t in over[i] if v >= MATCH] for i in some}
            tp, n = tp + len(matching.maximum_matching(adjacent, some)), n + len(some)
        assert got[score] == (tp, n - tp, n_gt - tp)
