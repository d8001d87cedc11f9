import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from maskara.functions import geometry as g, raster, text
from maskara.operators import metrics


def poly(*xy):
    return [Row(x=float(x), y=float(y)) for x, y in xy]


def test_polygons(spark):
    df = spark.createDataFrame([(1, poly((0, 0), (1, 0), (0, 1))), (2, poly((0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4))), (3, poly((0, 0), (1, 1))), (4, poly((0, 0), (1, 1), (1, 0), (0, 1)))], "id int, p array<struct<x: double, y: double>>")
    p = F.col("p")
    got = {r["id"]: r for r in df.select("id", g.polygon_area(p).alias("a"), g.perimeter(p).alias("l"), g.centroid(p).alias("c"), g.touches_edge(p).alias("e"), g.edge_distance(p).alias("d"), g.self_intersects(p).alias("x")).collect()}
    assert got[1]["a"] == 0.5 and math.isclose(got[2]["a"], 0.04) and got[3]["a"] == 0
    assert math.isclose(got[2]["c"]["x"], 0.3) and math.isclose(got[1]["c"]["x"], 1 / 3) and math.isclose(got[3]["c"]["x"], 0.5)
    assert got[1]["e"] and not got[2]["e"] and math.isclose(got[2]["d"], 0.2) and math.isclose(got[2]["l"], 0.8)
    assert [got[i]["x"] for i in (1, 2, 3, 4)] == [False, False, False, True]


def test_roi(spark):
    """A box in the region (40, 10, 90, 50) of a frame of 100 x 60, clamped to the frame."""
    one = spark.range(1)
    at = lambda v, o, n: g.roi_to_frame(F.lit(float(v)), F.lit(float(o)), F.lit(n))
    assert one.select(at(-5, 40, 100), at(2, 10, 60), at(70, 40, 100), at(60, 10, 60)).first()[:] == (35.0, 12.0, 100.0, 60.0)
    assert one.select(g.roi_pixels(*map(F.lit, (0.0, 0.25, 0.5, 1.0)), F.lit(100), F.lit(60)).alias("r")).first()["r"][:] == (0, 15, 50, 60)
    assert one.select(g.valid_roi(*map(F.lit, (0.0, 0.0, 0.5, float("nan"))))).first()[0] is False


def test_tiles(spark):
    assert spark.range(1).select(g.tile_starts(F.lit(1000), F.lit(400), 0.25)).first()[0] == [0, 300, 600]
    assert spark.range(1).select(g.tile_starts(F.lit(300), F.lit(400), 0.25)).first()[0] == [0]


def test_nearest_rank(spark):
    df = spark.createDataFrame([([0.4, 0.1, 0.3, 0.2],), ([],)], "v array<double>")
    assert [r[:] for r in df.select(metrics.nearest_rank(F.col("v"), 0.5), metrics.nearest_rank(F.col("v"), 0.95)).collect()] == [(0.2, 0.3), (0.0, 0.0)]
    flat = spark.createDataFrame([(x,) for x in (0.4, 0.1, 0.3, 0.2)], "v double")
    assert metrics.nearest_rank_of(flat, "v", {"a": 0.5, "b": 0.95}).first()[:2] == (0.2, 0.3)
    assert metrics.nearest_rank_of(flat.limit(0), "v", {"a": 0.5}).first()[0] == 0.0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 20), st.integers(0, 20), st.integers(1, 12), st.integers(1, 12), st.integers(0, 20), st.integers(0, 20), st.integers(1, 12), st.integers(1, 12))
def test_raster_of_rectangles(x, y, w, h, x2, y2, w2, h2):
    box = lambda x, y, w, h: raster.filled(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), 40, 40)
    a, b = box(x, y, w, h), box(x2, y2, w2, h2)
    assert a.sum() == (w + 1) * (h + 1)
    inter = max(min(x + w, x2 + w2) - max(x, x2) + 1, 0) * max(min(y + h, y2 + h2) - max(y, y2) + 1, 0)
    assert math.isclose(raster.iou(a, b), inter / (a.sum() + b.sum() - inter))
    assert math.isclose(raster.iou_matrix([a], [b])[0, 0], raster.iou(a, b))
    counts = raster.run_lengths(a)
    assert raster.run_area(counts) == a.sum() and raster.run_box(counts, 40, 40) == (x, y, w + 1, h + 1)
    assert (raster.from_run_lengths(counts, 40, 40) == a).all()


def test_masks():
    m = np.zeros((20, 40), np.uint8)
    m[10:18, 20:28] = 1
    m[2, 2] = 1
    assert raster.labelled(m).max() == 2
    big = raster.largest_component(m)
    geo = raster.mask_geometry(big)
    assert geo["area"] == 64 and (geo["cx"], geo["cy"]) == (23.5, 13.5) and geo["components"] == 1 and geo["holes"] == 0 and geo["clearance"] == 4
    big[13, 23] = 0
    assert raster.mask_geometry(big)["holes"] == 1 and raster.mask_geometry(np.zeros((3, 3))) is None
    assert len(raster.d4(m)) == 8 and raster.ssim(m * 255, m * 255) == 1
    assert raster.crop_overlap((0, 0, 10, 10), 40, 40, [np.ones((40, 40))], 40) == 1 and raster.moments_centroid(m.astype(float)) is not None
    assert set(raster.colour_stats(np.full((4, 4, 3), 200, np.uint8), np.ones((4, 4)))) >= {"h_mean", "green"}


def test_raster_area(spark):
    df = spark.createDataFrame([(poly((0, 0), (1, 0), (1, 1), (0, 1)),), (None,)], "p array<struct<x: double, y: double>>")
    assert [r[0] for r in df.select(raster.raster_area(F.col("p"), 32)).collect()] == [1.0, None]


def test_text(spark):
    one = spark.range(1)
    get = lambda *c: one.select(*c).first()[:]
    assert get(text.token(F.lit("  a/b:c  ")), text.token(F.lit("...")), text.token(F.lit(None).cast("string"))) == ("a_b_c", "unknown", "unknown")
    assert get(text.scene_key(F.lit("Straße"), F.lit("x/Ab.rf.123.jpg"))) == ("strasse::ab",)
    assert get(text.number_list(F.lit("3, 1,2,1")), text.visual_prefix(F.lit("000816_x.jpg")), text.visual_prefix(F.lit("x"))) == ([1.0, 2.0, 3.0], 816, None)
    assert get(text.suffix(F.lit("a/b.JPG")), text.stem(F.lit("a/b.c.jpg")), text.stem(F.lit(".x"))) == (".jpg", "b.c", ".x")
    assert get(text.policy_source(F.lit("roboflow_drago_1")), text.full_source(F.lit("roboflow_drago_1")), text.short_source(F.lit("x"))) == ("roboflow_drago_v1", "unknown", "unknown")
    assert len(get(text.newline_hashes(F.lit(b"a\n").cast("binary"), F.lit("x.txt")))[0]) == 2
    assert get(text.d4_name(F.lit(1)), text.capture_name(F.lit("d"), F.lit("m"), F.lit("s"), F.array(F.lit(""), F.lit("q")), F.lit("l"), F.lit(7))) == ("flip_lr_rot0", "d_m_s_q_007")
