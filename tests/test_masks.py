"""Masks of polygons: scan conversion by hand and by a plain loop, packing, overlaps, suppression and matching in plans."""

from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskara.functions import raster
from maskara.operators import masks, matching


def plain(points, height, width):
    """The same mask pixel by pixel, in exact numbers."""
    out = np.zeros((height, width), dtype=np.uint8)
    n = len(points)
    for i in range(n):
        a, b = sorted((tuple(points[i]), tuple(points[(i + 1) % n])), key=lambda p: p[0]) if points[i][0] != points[(i + 1) % n][0] else (tuple(points[i]), tuple(points[(i + 1) % n]))
        dx, dy = b[0] - a[0], abs(b[1] - a[1])
        way = 1 if b[1] >= a[1] else -1
        for k in range(max(dx, dy) + 1):
            m = ceil(Fraction(k * min(dx, dy), max(dx, dy, 1)) - Fraction(1, 2))
            out[a[1] + way * (k if dy > dx else m), a[0] + (m if dy > dx else k)] = 1
    for y in range(height):
        cross = []
        for i in range(n):
            a, b = points[i], points[(i + 1) % n]
            if min(a[1], b[1]) <= y < max(a[1], b[1]):
                cross.append(a[0] + Fraction((y - a[1]) * (b[0] - a[0]), b[1] - a[1]))
        cross.sort()
        for u, v in zip(cross[::2], cross[1::2]):
            out[y, ceil(u) : floor(v) + 1] = 1
    return out


def test_scan_conversion():
    show = lambda p, h, w: ["".join(".#"[v] for v in r) for r in raster.filled(np.array(p), h, w)]
    assert show([(0, 0), (4, 2)], 3, 5) == ["##...", "..##.", "....#"]  # a flat line; halves stay with the left end
    assert show([(4, 0), (0, 2)], 3, 5) == ["....#", "..##.", "##..."]
    assert show([(1, 0), (3, 0), (4, 1), (4, 3), (3, 4), (1, 4), (0, 3), (0, 1)], 5, 5) == [".###.", "#####", "#####", "#####", ".###."]
    assert show([(0, 0), (4, 4), (4, 0), (0, 4)], 5, 5) == ["#...#", "##.##", "#####", "##.##", "#...#"]  # a bow tie
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 7, 20):
        for _ in range(10):
            p = rng.integers(0, 40, (n, 2))
            assert (raster.filled(p, 40, 40) == plain(p.tolist(), 40, 40)).all()
    far = np.array([(-9, -9), (60, -9), (60, 60), (-9, 60)])
    assert raster.filled(far, 8, 8).all() and not raster.filled(np.zeros((0, 2)), 8, 8).any()


@pytest.fixture(scope="module")
def scene(spark):
    """Polygons of all sizes, one of one pixel, one on the border, one beyond it, with ties of confidence; images without truths, without predictions."""
    rng = np.random.default_rng(7)
    rows = []
    for image in range(12):
        for idx in range(int(rng.integers(0, 9))):
            gt = bool(rng.random() < 0.4) if image not in (3, 4) else image == 3
            centre, size = rng.random(2), rng.choice([0.0, 0.02, 0.2, 0.5])
            turn = np.sort(rng.random(int(rng.integers(3, 12)))) * 2 * np.pi
            p = centre + size * rng.random((len(turn), 1)) * np.stack([np.cos(turn), np.sin(turn)], 1)
            rows.append((image, idx, gt, "AB"[idx % 2], float(rng.integers(0, 5)) / 5, [(float(x), float(y)) for x, y in p]))
    return rows, spark.createDataFrame(rows, "image long, idx int, gt boolean, model string, conf double, points array<struct<x: double, y: double>>")


SIZE = 200


def drawn(points):
    return raster.raster(np.clip(np.array(points, dtype=np.float32), 0, 1), SIZE)


def test_packed_masks(spark, scene):
    rows, df = scene
    got = masks.with_masks(df, SIZE).collect()
    assert len(got) == len(rows)
    for r, (_, _, _, _, _, points) in zip(got, rows):
        m = drawn(points)
        y, x = np.nonzero(m)
        s = r["shape"]
        assert (s.x0, s.y0, s.x1, s.y1, s.n) == (x.min(), y.min(), x.max(), y.max(), m.sum()) and r["area"] == m.sum() / SIZE**2
        words = np.array(s.strips, dtype=np.int64)
        assert words.shape == (s.x1 // 64 - s.x0 // 64 + 1, s.y1 - s.y0 + 1)
        bits = np.unpackbits(np.ascontiguousarray(words.T).view(np.uint8).reshape(words.shape[1], -1), axis=1, bitorder="little")
        at = s.x0 // 64 * 64
        assert bits.sum() == s.n and (bits[:, s.x0 - at : s.x1 - at + 1] == m[s.y0 : s.y1 + 1, s.x0 : s.x1 + 1]).all()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [(0.5, 0.5)])], "i int, points array<struct<x: double, y: double>>")
    assert [(r.s.n, len(r.s.strips)) for r in odd.orderBy("i").select(masks.packed(F.col("points")).alias("s")).collect()] == [(0, 0), (0, 0), (1, 1)]
    assert masks.with_masks(df.limit(0), SIZE).count() == 0


def test_overlaps_of_masks(spark, scene):
    """IoU of all pairs, suppression, matching and the grid of four axes against loops over rasters."""
    rows, df = scene
    per, mask = {}, {(r[0], r[1]): drawn(r[5]) for r in rows}
    for r in rows:
        per.setdefault(r[0], ([], []))[r[2]].append(r)
    iou = {(a, b): raster.iou(mask[a], mask[b]) for a in mask for b in mask if a[0] == b[0]}
    lists = matching.gathered(masks.with_masks(df, SIZE)).persist()
    pairs = {(r.image, r.p_idx, r.g_idx): r.iou for r in masks.pairs_of(lists).collect()}
    want = {(i, p[1], g[1]): iou[(i, p[1]), (i, g[1])] for i, (ps, gs) in per.items() for p in ps for g in gs}
    assert pairs == {k: v for k, v in want.items() if v > 0}

    def outcome(i, conf, nms, area, edge, match):
        ps, gs = per[i]
        points = {p[1]: np.array(p[5]) for p in ps}
        sel = [p for p in sorted(ps, key=lambda p: (-p[4], p[1])) if p[4] >= conf and mask[i, p[1]].sum() / SIZE**2 >= area and min(points[p[1]].min(), 1 - points[p[1]].max()) >= edge]
        kept = []
        for p in sel:
            if all(iou[(i, p[1]), (i, k[1])] <= nms for k in kept):
                kept.append(p)
        used, tp = set(), 0
        for p in kept:
            best = max(((iou[(i, p[1]), (i, g[1])], -g[1]) for g in gs if g[1] not in used), default=(0.0, 0))
            if best[0] >= match:
                used.add(-best[1])
                tp += 1
        return [p[1] for p in kept], len(gs), len(sel), tp

    rows_ = matching.of_lists(lists, masks.shared).persist()
    kept = {}
    for r in matching.nms(rows_, 0.3, 0.2).collect():
        kept.setdefault(r.image, set()).add(r.idx)
    assert kept == {i: set(k) for i in per if (k := outcome(i, 0.2, 0.3, 0.0, -9, 0.5)[0])}
    grid = [(c, n, a, e) for c in (0.0, 0.4) for n in (0.1, 0.5) for a in (0.0, 0.01) for e in (-1.0, 0.05)]
    settings = spark.createDataFrame([(k, *g) for k, g in enumerate(grid)], "grid_seq int, conf double, nms_iou double, min_area double, min_edge double")
    got = {(r.grid_seq, r.image): (r.n_gt, r.n_selected, r.n_kept, r.tp) for r in matching.evaluated(rows_, settings, 0.2).collect()}
    for k, g in enumerate(grid):
        for i in per:
            k_, n_gt, n_sel, tp = outcome(i, *g, 0.2)
            assert got[k, i] == (n_gt, n_sel, len(k_), tp), (g, i)
    best = {(r.image, r.t.idx): (r.t.best.idx, r.t.best.iou) if r.t.best else None for r in rows_.select("image", F.explode(matching.best_of_truths(F.col("preds"), F.col("truths"))).alias("t")).collect()}
    for i, (ps, gs) in per.items():
        for g in gs:
            top = max(((iou[(i, p[1]), (i, g[1])], p[4], -p[1]) for p in ps), default=(0, 0, 0))
            assert (best[i, g[1]] or (0, 0.0))[1] == top[0]


def test_one_scan_and_one_exchange(spark):
    """What an image needs comes together once: no join, a single shuffle before the counts (with masks another, by the numbering of the view)."""
    from maskara.plans import evaluation, masking, views

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows, most in ((views.image_rows(spark, sf), 1), (views.mask_rows(spark, sf), 2), (evaluation.error_table(spark, sf), 1), (evaluation.grid_metrics(spark, sf), 2), (masking.mask_grid(spark, sf), 3)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1 and "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange hashpartitioning") <= most, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_masks_at_once():
    """filled_words() against filled(), of polygons of all kinds in one call."""
    rng = np.random.default_rng(5)
    polygons = [rng.integers(0, size, (n, 2)) for size in (3, 40, 200) for n in (0, 1, 2, 3, 4, 7, 20) for _ in range(8)]
    boxes, starts, words, n = raster.filled_words(np.concatenate(polygons), np.array([len(p) for p in polygons]))
    for i, p in enumerate(polygons):
        box, want = masks.pack(p)
        assert (*boxes[i].tolist(), n[i]) == box
        assert (words[starts[i] : starts[i + 1]].reshape(-1, max(len(want), 1)).T == want).all() if len(p) else starts[i] == starts[i + 1]
    assert len(raster.filled_words(np.zeros((0, 2)), np.zeros(3, dtype=int))[2]) == 0


def test_convex_masks_are_runs_of_rows():
    """Rows of convex polygons as runs, and what they share, against masks of words; polygons that are not convex are told apart."""
    rng = np.random.default_rng(8)
    turn = [np.sort(rng.random(n)) * 2 * np.pi for n in (1, 2, 3, 5, 9) for _ in range(60)]
    polygons = [np.rint(40 + rng.choice([2, 9, 40]) * np.stack([np.cos(t), np.sin(t)], 1)).astype(int)[:: rng.choice([1, -1])] for t in turn]
    polygons = [np.repeat(p, rng.integers(1, 3, len(p)), axis=0) for p in polygons]  # points given twice
    kept = [p for p in polygons if raster.all_convex(p, np.array([len(p)]))]
    assert len(kept) > 200
    points, counts = np.concatenate([*kept, np.zeros((0, 2), dtype=int)]), np.array([*map(len, kept), 0])
    assert raster.all_convex(points, counts)
    words, runs = raster.filled_words(points, counts), raster.convex_rows(points, counts)
    assert (words[0] == runs[0]).all() and (words[-1] == runs[-1]).all()
    a, b = (rng.integers(0, len(counts), 2000) for _ in range(2))
    want = masks._common(a, b, *words[:3])
    assert want.any() and (masks._common_rows(a, b, *runs[:4]) == want).all()
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    bent = [[*square, (2, 2)], [(0, 0), (8, 0), (4, 0), (4, 4), (0, 4)], square * 2, [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (4, 0), (4, 0), (1, 1), (1, 1), (0, 4)]]
    assert raster.all_convex(np.array(square), np.array([4])) and not any(raster.all_convex(np.array(p), np.array([len(p)])) for p in bent)


@pytest.mark.parametrize("few", [False, True])
def test_masks_drawn_by_image(spark, scene, monkeypatch, few):
    """Masks that are drawn after their image is together share what masks compared in the plan share, whatever a task takes at once."""
    if few:
        monkeypatch.setattr(masks, "AT_ONCE", 3)
    _, df = scene
    sides = [matching.gathered(masks.with_masks(df, SIZE)), matching.gathered(masks.with_outlines(df, SIZE), strips=True)]
    pairs = [sorted(masks.pairs_of(x, f).collect()) for x, f in zip(sides, (masks.shared, masks.looked_up))]
    assert pairs[0] == pairs[1] and pairs[0]
    rows = [sorted(matching.of_lists(x, f).select("image", "n_gt", "preds").collect()) for x, f in zip(sides, (masks.shared, masks.looked_up))]
    assert rows[0] == rows[1]
    kept = [sorted(x.select("image", F.explode("t").alias("t")).select("image", "t.idx", "t.area", "t.edge", "t.shape.n", "t.shape.strips").collect()) for x in sides]
    assert kept[0] == kept[1]
    assert "strips" not in matching.gathered(masks.with_outlines(df, SIZE)).schema["p"].simpleString()


def test_overlaps_in_small_parts(monkeypatch):
    """What is looked at at once changes nothing."""
    rng = np.random.default_rng(6)
    polygons = [rng.integers(0, 150, (int(rng.integers(1, 9)), 2)) for _ in range(60)]
    drawn_ = raster.filled_words(np.concatenate(polygons), np.array([len(p) for p in polygons]))[:3]
    n_p, n_t = np.array([5, 0, 20, 0, 1]), np.array([4, 3, 25, 0, 2])
    want = masks._laps(n_p, n_t, *drawn_)
    for name in ("PAIRS_AT_ONCE", "WORDS_AT_ONCE"):
        monkeypatch.setattr(masks, name, 7)
    assert all((a == b).all() for a, b in zip(want, masks._laps(n_p, n_t, *drawn_))) and len(want[0])


def test_hits_at_all_thresholds(spark, scene):
    """A row a detection says what a row a detection and threshold says; images without predictions give none."""
    rows = matching.of_lists(matching.gathered(masks.with_masks(scene[1], SIZE)), masks.shared).persist()
    steps = (0.05, 0.3, 0.75)
    long = matching.coco_matches(rows, spark.createDataFrame([(t,) for t in steps], "threshold double")).collect()
    wide = matching.coco_hits_of(rows, steps).collect()
    assert {(t, r.image, r["rank"], r.conf, h) for r in wide for t, h in zip(steps, r.hits)} == {(r.threshold, r.image, r["rank"], r.conf, r.hit) for r in long}
    assert len(wide) * len(steps) == len(long) > 0
