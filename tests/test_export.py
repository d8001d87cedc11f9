"""Two-model export by per-source policies and the COCO summary, against plain loops over rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskara.functions import raster
from maskara.operators import masks, matching, metrics, policy

SIZE = 100
KEYS = list(policy.EXPORT_DEFAULT)
POLICIES = {"a": (0.2, 0.001, 2, 0.15, 0.3), "b": (0.0, 0.0, 2, 0.0, 0.9), "c": (0.5, 0.02, 1, 0.5, 0.1)}


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(21)
    rows = []
    for image in range(24):
        for idx in range(int(rng.integers(0, 12))):
            turn = np.sort(rng.random(int(rng.integers(3, 8)))) * 2 * np.pi
            p = np.clip(rng.random(2) * 0.4 + 0.3 + 0.35 * rng.random((len(turn), 1)) * np.stack([np.cos(turn), np.sin(turn)], 1), 0, 1)
            rows.append((image, idx, bool(rng.random() < 0.3), "ABC"[int(rng.integers(0, 3))], float(rng.integers(0, 7)) / 6, "abcz"[image % 4], [(float(x), float(y)) for x, y in np.round(p, 4)]))
    df = spark.createDataFrame(rows, "image long, idx int, gt boolean, model string, conf double, source string, points array<struct<x: double, y: double>>")
    mask = {r[:2]: raster.raster(np.array(r[6], dtype=np.float32), SIZE) for r in rows}
    return rows, masks.with_masks(df, SIZE), lambda a, b: raster.iou(mask[a[:2]], mask[b[:2]]), mask


def test_export_by_source(spark, scene):
    rows, df, iou, mask = scene
    table = spark.createDataFrame([(k, *v) for k, v in POLICIES.items()], "source string, " + ", ".join(f"{c} {'int' if c == 'min_support' else 'double'}" for c in KEYS))
    lists = matching.gathered(df, 0.0, "source", also=("points",)).persist()
    out = {r.image: r for r in policy.exported(lists, table, masks.shared, ("A", "B")).collect()}
    assert out.keys() == {r[0] for r in rows}
    backed = 0
    for image, got in out.items():
        conf, area, support, support_iou, nms = POLICIES.get(got.source, tuple(policy.EXPORT_DEFAULT.values()))
        sel = {m: [r for r in rows if r[0] == image and not r[2] and r[3] == m and r[4] >= conf and mask[r[:2]].sum() / SIZE**2 >= area] for m in "AB"}
        both = [*sel["A"], *sel["B"]]
        if support == 2:
            both = [r for r in both if any(iou(r, q) >= support_iou for q in sel["B" if r[3] == "A" else "A"])]
            backed += len(both)
        kept = []
        for r in sorted(both, key=lambda r: -r[4]):
            if all(iou(r, k) <= nms for k in kept):
                kept.append(r)
        text = "".join("0 " + " ".join(f"{v:.6f}" for p in r[6] for v in p) + f" {r[4]:.6f}\n" for r in kept)
        assert (got.selected_a, got.selected_b, got.candidates, got.kept, got.labels) == (len(sel["A"]), len(sel["B"]), len(both), len(kept), text), image
        assert got.kept_a == sum(r[3] == "A" for r in kept) and got.kept_a + got.kept_b == got.kept and got.confidence_threshold == conf
    assert backed and {r.source for r in out.values()} == set("abcz")
    one = policy.exported(lists, None, masks.shared, ("A", "B"), dict(zip(KEYS, POLICIES["c"])))  # one policy for all sources
    assert {r.image: r.labels for r in one.filter("source = 'c'").collect()} == {i: r.labels for i, r in out.items() if r.source == "c"} and one.select("min_support").distinct().count() == 1
    whole = policy.export_summary(policy.exported(lists, table, masks.shared, ("A", "B"))).filter("whole").first()
    assert (whole.images, whole.kept) == (len(out), sum(r.kept for r in out.values()))
    assert policy.exported(lists.limit(0), table, masks.shared, ("A", "B")).count() == 0


def test_coco_summary(spark, scene):
    """stats 0, 1, 2, 6, 7 and 8 as the rule has them: detections one by one, ties in the order of images."""
    rows, df, iou, _ = scene
    steps = tuple(float(t) for t in np.linspace(0.1, 0.9, 5)) + (0.75,)
    images = sorted({r[0] for r in rows})
    n_gt = sum(r[2] for r in rows)
    hits = {}
    for t in steps:
        found = []
        for i in images:
            gts = sorted((r for r in rows if r[0] == i and r[2]), key=lambda r: r[1])
            used = set()
            for rank, p in enumerate(sorted((r for r in rows if r[0] == i and not r[2]), key=lambda r: (-r[4], r[1])), 1):
                least, m = min(t, 1 - 1e-10), None
                for g in gts:
                    if g[1] not in used and iou(p, g) >= least:
                        least, m = iou(p, g), g[1]
                used |= {m} if m is not None else set()
                found.append((p[4], i, rank, m is not None))
        hits[t] = sorted(found, key=lambda h: (-h[0], h[1], h[2]))
    precision = {}
    for t, found in hits.items():
        tp = np.cumsum([h[3] for h in found])
        rc, pr = tp / n_gt, tp / np.arange(1, len(tp) + 1)
        pr = np.maximum.accumulate(pr[::-1])[::-1]
        at = np.searchsorted(rc, np.linspace(0, 1, 101), side="left")
        precision[t] = np.mean([pr[k] if k < len(pr) else 0.0 for k in at])
    rows_ = matching.of_lists(matching.gathered(df, 0.0, "source"), masks.shared)
    made = matching.coco_matches(rows_, spark.createDataFrame([(t,) for t in steps], "threshold double")).persist()
    for buckets in (1, 3, 64):
        got = metrics.coco_summary(made, n_gt, steps, buckets).first()
        assert abs(got.ap - np.mean(list(precision.values()))) < 1e-9 and abs(got.ap50 - precision[0.5]) < 1e-9 and abs(got.ap75 - precision[0.75]) < 1e-9
        for m in (1, 10, 100):
            assert abs(got[f"ar{m}"] - np.mean([sum(h[3] for h in found if h[2] <= m) / n_gt for found in hits.values()])) < 1e-9
    assert 0 < got.ap < 1 and got.ar1 < got.ar10
    nothing = metrics.coco_summary(made.limit(0), 0, steps).first()
    assert tuple(nothing) == (0.0,) * 6


def test_recalls_as_stored(spark):
    """A recall of 29/100 is the stored 0.29, which the evenly spaced numbers may be above."""
    values = [k / n for n in (1, 7, 100, 101, 300) for k in range(n + 1)]
    got = spark.createDataFrame([(v,) for v in values], "r double").select("r", metrics.reached(F.col("r")).alias("k")).collect()
    assert all(r.k == np.searchsorted(np.linspace(0, 1, 101), r.r, side="right") - 1 for r in got)
