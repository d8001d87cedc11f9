"""Ids, manifests, duplicates with equal masks, and the COCO document in parts."""

import json

import numpy as np
from pyspark.sql import functions as F

from maskara import sinks
from maskara.functions import raster
from maskara.operators import manifest, masks

SIZE = 96
RING = lambda x, y, w, h: [(x / 95, y / 95), ((x + w) / 95, y / 95), ((x + w) / 95, (y + h) / 95), (x / 95, (y + h) / 95)]


def test_ids_within(spark):
    rows = spark.createDataFrame([(s, f"{n:03d}") for s in ("b", "a", None) for n in np.random.default_rng(0).permutation(150).tolist()], "split string, name string").repartition(9)
    got = manifest.ids_within(rows, "split", ["name"], "id").collect()
    assert len(got) == 450 and all(r.id == int(r.name) + 1 for r in got)
    assert manifest.ids_within(rows.limit(0), "split", ["name"], "id").count() == 0


def test_selection(spark):
    assets = spark.createDataFrame(
        [(1, "s", "B.jpg", "h1", "x", "train"), (2, "s", "a.jpg", "h1", "y", "train"), (3, "s", "c.jpg", "h2", "t1", "train"), (4, "s", "d.jpg", "h3", "t1", "test"), (5, "s", "e.jpg", "h4", "t1", "test"), (6, "s", "f.jpg", "h5", "v", "val"), (7, "s", "g.jpg", "h5", "w", "train")],
        "image long, source string, name string, sha256 string, scene string, split string",
    )
    ids = manifest.with_image_ids(manifest.selection(assets))
    assert {r.image: (r.derived, r.coco_image_id, r.unique_image_id) for r in ids.collect()} == {2: ("train_clean", 1, None), 4: ("test_frozen", 1, 1), 5: ("test_frozen", 2, None), 6: ("val_clean", 1, None)}
    lines = spark.createDataFrame([(5, 2), (5, 1), (4, 7), (3, 1)], "image long, line int").withColumn("pixels", F.expr("array(struct(0D AS x, 0D AS y), struct(2D AS x, 0D AS y), struct(2D AS x, 3D AS y))"))
    out = manifest.instance_manifest(ids, lines).collect()
    assert {(r.image, r.label_line): (r.coco_image_id, r.coco_annotation_id, r.area) for r in out} == {("d.jpg", 7): (1, 1, 3.0), ("e.jpg", 1): (2, 2, 3.0), ("e.jpg", 2): (2, 3, 3.0)}
    assert {r.image: r.instances for r in manifest.image_manifest(ids, lines).collect()} == {"a.jpg": 0, "d.jpg": 1, "e.jpg": 2, "f.jpg": 0}


def test_duplicate_groups(spark):
    """Equal masks in another order, masks moved a little, a mask too many, none at all, other sizes; against a loop over rasters."""
    big, small = [(0, 0, 80, 80), (85, 85, 8, 8)], [(0, 0, 80, 80), (20, 85, 8, 8)]
    moved = [(0, 0, 81, 80), (85, 85, 8, 8)]
    groups = {
        "exact": [big, big[::-1], big], "near": [big, moved, moved[::-1], big], "other": [big, small], "more": [big, big[:1]], "none": [[], []], "some": [[], big[:1]], "twice": [[big[0], moved[0]], [moved[0], big[0]]],
        "sizes": [big, big], "single": [big], "late": [big, moved, small],
    }
    images, instances, want = [], [], {}
    for g, members in groups.items():
        for m in members:
            i = len(images)
            images.append((i, g, 10 + (g == "sizes") * i, 10, i))
            instances += [(i, k, RING(*b)) for k, b in enumerate(m)]
        if len(members) > 1:
            mask = [[raster.raster(np.array(RING(*b), dtype=np.float32), SIZE) for b in m] for m in members]
            if all(sorted(x.tobytes() for x in m) == sorted(x.tobytes() for x in mask[0]) for m in mask):
                want[g] = (len(members), "dimension_conflict" if g == "sizes" else "exact_raster", 1.0)
                continue
            low = []
            for m in mask[1:]:
                best = [max((raster.iou(a, b) for b in m), default=0) for a in mask[0]]
                low.append(min(best, default=1.0) if len(m) == len(mask[0]) and min(best, default=1.0) >= 0.99 - 0.003 else None)
            want[g] = (len(members), "label_conflict", 1.0) if None in low else (len(members), "equivalent_raster", min(low))
    frame = spark.createDataFrame(images, "image long, sha256 string, width int, height int, place long")
    rows = spark.createDataFrame(instances, "image long, idx int, points array<struct<x: double, y: double>>").withColumn("shape", masks.packed(F.col("points"), SIZE))
    found = manifest.duplicate_groups(frame, rows, 0.987)
    got = {r.sha256: (r.n, r.kind, r.min_iou) for r in found.collect()}
    assert got == want and {v[1] for v in got.values()} == {"exact_raster", "equivalent_raster", "label_conflict", "dimension_conflict"}
    s = manifest.duplicate_summary(found).first()
    assert (s.groups, s.exact_raster_groups, s.equivalent_raster_groups, s.conflicts) == (len(want), sum(v[1] == "exact_raster" for v in want.values()), 1, sum("conflict" in v[1] for v in want.values())) and 0.987 <= s.minimum_matched_iou < 1
    nothing = manifest.duplicate_summary(manifest.duplicate_groups(frame.limit(0), rows)).first()
    assert (nothing.groups, nothing.rows, nothing.minimum_matched_iou) == (0, 0, 1.0)


def test_coco_in_parts(spark, tmp_path):
    """The part files, one after another, are the document."""
    images = spark.range(1, 301).select("id", F.format_string("%03d.jpg", "id").alias("file_name"), F.lit(None).cast("int").alias("width")).repartition(7)
    notes = spark.range(1, 40).select("id", F.lit(1).alias("image_id"), F.array(F.lit(0.5), F.col("id") / 2).alias("bbox"), F.struct(F.lit('a "b"').alias("source")).alias("extra"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows are one part
    for a, b, at in ((images, notes, "x"), (images.limit(0), notes.limit(0), "y")):
        sinks.coco_parts(a, b, {"info": {"description": "é"}, "categories": [{"id": 1}]}, str(tmp_path / at))
        doc = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / at).glob("part-*"))))
        assert doc["info"] == {"description": "é"} and [x["id"] for x in doc["images"]] == sorted(r.id for r in a.collect()) and [x["id"] for x in doc["annotations"]] == sorted(r.id for r in b.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert doc["categories"] == [{"id": 1}]
    first = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "x").glob("part-*"))))
    assert first["images"][0] == {"id": 1, "file_name": "001.jpg", "width": None} and first["annotations"][1] == {"id": 2, "image_id": 1, "bbox": [0.5, 1.0], "extra": {"source": 'a "b"'}}
    assert len(list((tmp_path / "x").glob("part-*"))) > 1


def test_duplicate_groups_shuffle_few_masks(spark):
    """Masks are shuffled of images that are compared only: not of images without a copy, nor of copies with equal masks or of other sizes."""
    rng = np.random.default_rng(4)
    words = lambda: [[int(x) for x in rng.integers(-(2**62), 2**62, 100)]]
    images = [(i, f"{i}", 640, 640, i) for i in range(200)] + [(1000 + i, f"{i}", 640, 640 + i % 2, 1000 + i) for i in range(100)]
    own = {i: words() for i in range(200)}
    shapes = [(i, 0, (0, 0, 63, 99, 3200, own[i % 1000])) for i, *_ in images]
    frame = spark.createDataFrame(images, "image long, sha256 string, width int, height int, place long")
    rows = spark.createDataFrame(shapes, "image long, idx int, shape struct<x0: int, y0: int, x1: int, y1: int, n: int, strips: array<array<bigint>>>").localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
    before = written()
    got = manifest.duplicate_groups(frame, rows).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"exact_raster": 50, "dimension_conflict": 50}
    assert written() - before < 300 * 100 * 8 / 3
