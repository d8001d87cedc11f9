import json
import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from maskara import sinks, streaming
from maskara.operators import curate, features, frames, leakage, matching, metrics, pairs, policy, validate
from maskara.sources import labels


@pytest.fixture
def folder(tmp_path):
    ring = "0.1 0.1 0.4 0.1 0.4 0.4"
    (tmp_path / "a.txt").write_text(f"0 {ring}\n\n1 {ring} 0.5\n0 {ring}\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text(f"﻿0 {ring}")
    for n in ("a.jpg", "b.jpg", "c.png", "d.jpg", "x.tif"):
        (tmp_path / n).write_bytes(b"")
    return str(tmp_path)


def test_label_files(spark, folder):
    inventory = labels.images(spark, folder)
    assert [r["name"] for r in inventory.collect()] == ["a.jpg", "b.jpg", "c.png", "d.jpg"]
    assert labels.images(spark, folder, labels.IMAGES_WIDE, include="*.t*").count() == 1
    lines = labels.label_lines(spark, folder, strip_mark=True)
    all_ = labels.with_labels(inventory, lines)
    assert all_.filter("line IS NULL").count() == 2 and lines.filter("stem = 'a'").count() == 4
    got = labels.instances(lines, confident=False).orderBy("stem", "idx").collect()
    assert [(r["stem"], r["idx"], r["line"]) for r in got] == [("a", 0, 1), ("a", 1, 4), ("c", 0, 1)]
    preds = labels.exported_predictions(lines).collect()
    assert [(r["line"], r["confidence"]) for r in preds] == [(3, 0.5)]
    ok, bad = labels.strict_instances(lines, confident=True)
    assert ok.count() == 1 and {r["code"] for r in bad.collect()} == {"invalid_coordinate_count"}
    assert labels.file_hashes(spark, folder, "*.txt").filter(F.col("sha256") == labels.EMPTY_SHA256).count() == 6
    one = spark.createDataFrame([("c", 1, "0 0.1 0.1 0.4 0.1 0.4 0.4"), ("c", 2, " ")], "stem string, line int, text string")
    rows = labels.training_instances(one, F.lit(100), F.lit(50)).collect()
    assert labels.benchmark_instances(one).count() == 1
    assert rows[0]["vertices"] == 3 and rows[0]["area"] > 0
    with pytest.raises(Exception, match="bad label line"):
        labels.training_instances(lines, F.lit(100), F.lit(50)).collect()
    stats = validate.check_lines(lines)
    assert {(r["stem"], r["line"], r["code"]) for r in stats.collect()} == {("a", 2, "blank_line"), ("a", 3, "odd_coordinate_count")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0, [Row(x=0.5, y=0.25)], 0.5)], "stem string, idx int, class_id int, points array<struct<x: double, y: double>>, confidence double")
    inventory = spark.createDataFrame([("a",), ("b",)], "stem string")
    files = {r["stem"]: r["content"] for r in sinks.label_files(inventory, rows, str(tmp_path / "labels")).collect()}
    assert files == {"a": "0 0.500000 0.250000 0.500000\n", "b": ""}
    (tmp_path / "out").mkdir()
    sinks.export_labels(spark.read.parquet(str(tmp_path / "labels")), str(tmp_path / "out"))
    assert (tmp_path / "out/b.txt").read_text() == ""
    sinks.fixed_table(rows.select("stem", "confidence"), str(tmp_path / "t"))
    assert "0.500000" in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    images = spark.createDataFrame([("b.jpg", 10, 10), ("a.jpg", 10, 10)], "file_name string, width int, height int")
    notes = spark.createDataFrame([("b.jpg", 1, [0.0, 0.0, 1.0, 1.0], 1.0, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0])], "file_name string, line int, box array<double>, area double, polygon array<double>")
    doc = sinks.coco(images, notes, "fruit")
    doc.write.json(str(tmp_path / "coco"))
    again = labels.document(spark, str(tmp_path / "coco"), labels.COCO)
    assert sinks.coco_counts(again).first()[:] == (2, 1) and again.selectExpr("annotations[0].image_id").first()[0] == 2
    assert [r["file_name"] for r in labels.coco_images(again, "").collect()] == ["a.jpg", "b.jpg"]
    sinks.json_summary(sinks.coco_counts(doc), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n_images": 2, "n_annotations": 1}
    assert sinks.markdown(images, 1).count("\n") == 3
    sinks.publish(spark, str(tmp_path / "coco"), str(tmp_path / "final"))
    with pytest.raises(FileExistsError):
        sinks.publish(spark, str(tmp_path / "labels"), str(tmp_path / "final"))


def _boxes(rng, n, gt):
    out = []
    for i in range(n):
        x, y, w, h = rng.integers(0, 30), rng.integers(0, 30), rng.integers(5, 20), rng.integers(5, 20)
        out.append((i, int(x), int(y), int(x + w), int(y + h), float(rng.integers(0, 20)) / 20, gt))
    return out


def _iou(a, b):
    w, h = min(a[3], b[3]) - max(a[1], b[1]) + 1, min(a[4], b[4]) - max(a[2], b[2]) + 1
    i = max(w, 0) * max(h, 0)
    area = lambda r: (r[3] - r[1] + 1) * (r[4] - r[2] + 1)
    return i / (area(a) + area(b) - i)


def test_suppression_and_matching(spark):
    """Against plain loops on random boxes."""
    rng = np.random.default_rng(2)
    data = {im: (_boxes(rng, rng.integers(0, 9), False), _boxes(rng, rng.integers(0, 6), True)) for im in range(40)}
    cols = "image long, idx int, x0 int, y0 int, x1 int, y1 int, conf double, gt boolean"
    rows = spark.createDataFrame([(im, *r) for im, (p, g) in data.items() for r in (*p, *g)], cols).withColumn("model", F.when(F.col("idx") % 2 == 0, "A").otherwise("B")).withColumn("area", F.lit(1.0)).withColumn("edge", F.lit(1.0))
    p, g = rows.filter("NOT gt"), rows.filter("gt")
    images = spark.createDataFrame([(im,) for im in data], "image long")
    per = matching.per_image(images, p, g, pairs.pred_gt(p, g), pairs.pred_pred(p)).persist()
    kept, met, maximum = {}, {}, {}
    for im, (ps, gs) in data.items():
        order = sorted(ps, key=lambda r: (-r[5], r[0]))
        k = []
        for r in order:
            if all(_iou(r, q) <= 0.3 for q in k):
                k.append(r)
        kept[im] = {r[0] for r in k}
        used: set = set()
        for r in order:
            best, at = 0.0, -1
            for q in gs:
                if q[0] not in used and _iou(r, q) > best:
                    best, at = _iou(r, q), q[0]
            if best >= 0.2:
                used.add(at)
            met[im, r[0]] = at if best >= 0.2 else -1
        from itertools import permutations

        hits = {(r[0], q[0]) for r in ps for q in gs if _iou(r, q) >= 0.2}
        maximum[im] = max((sum((a, b) in hits for a, b in zip(perm, [q[0] for q in gs])) for perm in permutations([r[0] for r in ps] + [-1] * len(gs), len(gs))), default=0) if len(gs) <= 3 else None
    got = {}
    for r in matching.nms(per, 0.3).collect():
        got.setdefault(r["image"], set()).add(r["idx"])
    assert {k: v for k, v in kept.items() if v} == got
    assert {(r["image"], r["idx"]): r["gt"] for r in matching.matches(per, 0.2).collect()} == met
    tp = {r["image"]: r["tp"] for r in matching.maximum_tp(per, 0.2).collect()}
    assert all(tp[im] == n for im, n in maximum.items() if n is not None)
    grid = spark.createDataFrame([(0.0, 0.3, 0.0, -1.0), (0.5, 1.0, 0.0, -1.0)], "conf double, nms_iou double, min_area double, min_edge double")
    done = matching.evaluated(per, grid, 0.2)
    assert done.filter("fp + tp <> n_kept OR tp + fn <> n_gt").count() == 0 and done.count() == 80
    curve = matching.matching_curve(per, 0.2).orderBy(F.desc("tp")).first()
    assert curve["tp"] == sum(tp.values())
    hits = matching.coco_matches(per, spark.createDataFrame([(0.2,)], "threshold double"))
    ap = metrics.average_precisions(hits, sum(len(g) for _, g in data.values())).first()
    assert 0 < ap["ap"] < 1 and 0 < ap["ar"] <= 1


def test_curation(spark):
    names = [(f"s{i % 3}", f"img_{i:03d}.jpg") for i in range(50)]
    df = spark.createDataFrame(names, "source string, image string")
    order = sorted(range(50), key=lambda i: names[i])
    index = list(range(50))
    random.Random(curate.SEED).shuffle(index)
    want = {names[order[k]][1]: ("train" if n < 40 else "val" if n < 45 else "test") for n, k in enumerate(index)}
    assert {r["image"]: r["split"] for r in curate.shuffled_split(df).collect()} == want
    few = {r["split"] for r in curate.clamped_split(df.limit(3), 1).collect()}
    assert few == {"train", "val", "test"} and curate.counted_split(df.limit(10)).filter("split = 'test'").count() == 1
    kept, gone = curate.without_rejected(spark.createDataFrame([("train", "000820_a.jpg"), ("val", "000820_a.jpg"), ("train", "bad.jpg")], "split string, image string"), ["bad"], 816, 845)
    assert kept.count() == 1 and gone.count() == 2
    queue = curate.review_queue(spark.createDataFrame([(1, 2, 1, 0, 0, 1), (2, 1, 0, 1, 1, 2)], "image long, gt int, fp int, fn int, unreachable int, seq int"))
    assert [(r["image"], r["score"], r["action"]) for r in queue.collect()] == [(2, 14, curate.ACTIONS[4]), (1, 4, curate.ACTIONS[4])]
    crops = spark.createDataFrame([(1, 0, 0.9, 0, 0, 10, 10), (1, 1, 0.8, 2, 2, 12, 12), (1, 2, 0.7, 30, 30, 40, 40)], "image long, idx int, conf double, x0 int, y0 int, x1 int, y1 int")
    assert [r["idx"] for r in matching.spaced_crops(crops, 3).orderBy("idx").collect()] == [0, 2]
    assert validate.next_free(spark, spark.createDataFrame([(1,), (2,), (4,)], "index long")) == 3
    assert validate.next_free(spark, spark.range(1, 1501).unionByName(spark.range(1, 10)).select(F.col("id").alias("index"))) == 1501 and validate.next_free(spark, spark.range(0).select(F.col("id").alias("index"))) == 1
    with pytest.raises(LookupError, match="ambiguous"):
        validate.pick_device(spark.createDataFrame([("a",), ("b",)], "serial string"), None)
    with pytest.raises(ValueError):
        validate.capture_arguments({"width": 3})


def test_perceptual(spark):
    rng = np.random.default_rng(0)
    base = np.kron(rng.integers(0, 255, (16, 16)), np.ones((8, 8))).astype(np.uint8)
    turned, other = np.rot90(base, 1), np.kron(rng.integers(0, 255, (16, 16)), np.ones((8, 8))).astype(np.uint8)
    df = spark.createDataFrame([("test", "a", "sa", bytearray(base.tobytes())), ("train", "b", "sb", bytearray(np.ascontiguousarray(turned).tobytes())), ("train", "c", "sb", bytearray(other.tobytes())), ("val", "d", "sd", bytearray(other.tobytes()))], "split string, key string, scene string, pixels binary")
    found = leakage.perceptual_pairs(df)
    assert {(r["a_key"], r["b_key"], r["turn"]) for r in found.collect()} == {("b", "a", 2), ("c", "d", 0)}  # train before test: it is the test image that is turned
    out = {r["key"]: r["removed"] for r in leakage.prioritized(df.select("split", "key", "scene"), found).collect()}
    assert out == {"a": False, "b": True, "c": True, "d": False}


def test_perceptual_pairs_are_all(spark):
    """Every pair that a comparison of all images finds, with its turn: planted near copies under all turns, at both sides of the threshold, in dense and
    sparse cells, in blocks of two; copies of one content stand for each other; images of one shade fit nothing."""
    from maskara.functions import raster

    rng = np.random.default_rng(3)
    grow = lambda x: np.kron(np.clip(x, 0, 255).astype(np.uint8), np.ones((8, 8), dtype=np.uint8))
    base = [rng.integers(0, 256, (16, 16)) for _ in range(6)] + [np.add.outer(np.arange(16), np.arange(16)) * 8 + rng.integers(0, 3, (16, 16)) for _ in range(4)]
    rows = []
    for i, b in enumerate(base):
        for j in range(8):
            noise = rng.normal(0, rng.choice([0, 3, 6, 9, 12]), (16, 16))
            rows.append((("train", "val", "test")[j % 3], f"{i:02d}_{j}", grow(raster.d4(b + noise)[(3 * j + i) % 8])))
    rows += [("val", "copy", rows[0][2]), ("train", "copy", rows[0][2]), ("train", "copy2", rows[0][2]), ("train", "flat", grow(np.full((16, 16), 7))), ("test", "flat", grow(np.full((16, 16), 7)))]
    df = spark.createDataFrame([(s, k, bytearray(p.tobytes())) for s, k, p in rows], "split string, key string, pixels binary")
    first, members = leakage.classes_of(df)
    rep = {(r.split, r.key): r.rep for r in members.collect()}
    assert len(rep) == len(rows) and rep["train", "copy"] == rep["train", "copy2"] == "00_0" and rep["val", "copy"] == "copy"
    small = {(s, k): p.reshape(16, 8, 16, 8).mean((1, 3)) for s, k, p in rows if rep[s, k] == k}
    order = ["train", "val", "test"]
    want = {}
    for a in small:
        for b in small:
            if order.index(a[0]) < order.index(b[0]):
                fit = [float(raster.unit(small[a]) @ raster.unit(v)) for v in raster.d4(small[b])]
                if max(fit) >= 0.995:
                    want[a, b] = (int(np.argmax(fit)), max(fit))
    for block in (512, 2):
        got = {((r.a_split, r.a_key), (r.b_split, r.b_key)): (r.turn, r.coarse) for r in leakage.coarse_pairs(leakage.coarse_vectors(first), block=block).collect()}
        assert got.keys() == want.keys() and 10 < len(got) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in got)
    found = leakage.perceptual_pairs(df).persist()
    assert 0 < found.count() <= len(want)
    scened = df.select("split", "key", F.substring("key", 1, 2).alias("scene"))
    done = leakage.prioritized(scened, found, members)
    leakage.check_priority(done, found, members)
    with pytest.raises(ValueError, match="remain"):
        leakage.check_priority(done.withColumn("removed", F.lit(False)), found, members)
    assert leakage.perceptual_pairs(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(150)] + [("x", "y")], "a string, b string")
    assert {r.root for r in leakage.components(edges).collect()} == {"000", "x"}


def test_summary_tells_no_source_from_all(spark):
    rows = spark.createDataFrame([("train", None, 1, 2, 1), ("train", "a", 1, 1, 0)], "split string, source string, n_gt int, n_kept int, tp int")
    got = {(r.split, r.source, r.whole): (r.images, r.candidates, r.negatives) for r in metrics.candidate_summary(rows, ["split", "source"]).collect()}
    assert got == {("train", None, True): (2, 3, 2), ("train", None, False): (1, 2, 1), ("train", "a", False): (1, 1, 1)}


def test_numbers_in_order(spark):
    from maskara.operators.order import numbered

    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    assert all(r.k == r.n for r in numbered(rows, ["k"], "n").collect()) and numbered(rows.limit(0), ["k"], "n").count() == 0


def test_policies(spark):
    grid = policy.grid(spark, conf=[0.5, 0.1, 0.5], nms_iou=[0.3])
    assert [(r["grid_seq"], r["conf"]) for r in grid.orderBy("grid_seq").collect()] == [(0, 0.1), (1, 0.5)]
    per = spark.createDataFrame([("a", 0, 3, 2), ("a", 1, 2, 0), ("a", 2, 1, 1), ("b", 0, 1, 0), ("b", 1, 2, 5)], "source string, grid_seq int, tp long, fp long")
    got = {(r["tp"], r["fp"]): r["path"] for r in policy.source_policies(per, 6).collect()}
    assert got == {(3, 0): "00001,00000", (4, 2): "00000,00000", (5, 7): "00000,00001"}
    rows = spark.createDataFrame([("a",), ("z",)], "source string")
    assert {r["source"]: r["conf_t"] for r in policy.policy_of(rows, spark.createDataFrame([("a", 0.3, 0.1, 0.0)], "source string, conf_t double, nms_t double, area_t double")).collect()} == {"a": 0.3, "z": 0.5}


def test_filter(spark):
    rng = np.random.default_rng(1)
    data = [(float(a), float(b), int(a > 0.5)) for a, b in rng.random((200, 2))]
    df = spark.createDataFrame(data, "a double, b double, label int")
    rows = features.standardized(df, features.scaling(df, ["a", "b"]), ["a", "b"])
    out = features.probabilities(features.fit_filter(rows, ["a", "b"]), rows, ["a", "b"])
    assert out.filter((F.col("prob") > 0.5) == (F.col("label") == 1)).count() > 190


def test_scheduler(spark):
    df = spark.createDataFrame([(i, "s", False) for i in range(21)], "frame_index long, stream string, refresh boolean")
    runs = lambda n: [r["frame_index"] for r in frames.scheduled(df, n, ["stream"], "refresh").filter("runs").orderBy("frame_index").collect()]
    assert runs(10) == [0, 10, 20] and runs(0) == [0]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(25).selectExpr("'s' AS stream", "id AS frame_index", "timestamp_micros(id * 40000) AS ts", "false AS refresh")
    rows.write.parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = streaming.schedule(spark.readStream.schema(streaming.FRAME).parquet(str(src)), 10)
    q = stream.writeStream.format("memory").queryName("scheduled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["frame_index"]: (r["runs"], r["age"]) for r in spark.table("scheduled").collect()}
    assert len(got) == 25 and [k for k, v in sorted(got.items()) if v[0]] == [0, 10, 20] and got[17] == (False, 7)
    assert streaming.newest(rows).first()["skipped"] == 24


def test_fixed_rules(spark):
    """Each rule of the review queue, the suggestions, the causes, the repeats and the ids, from rows that only it decides."""
    from maskara.functions import text
    from maskara.operators import curate, validate

    rows = [(1, 9, 9, 9, 2), (2, 8, 3, 4, 1), (3, 7, 4, 4, 1), (4, 7, 3, 2, 1), (5, 7, 3, 1, 1)]
    queue = curate.review_queue(spark.createDataFrame([(*r, r[0]) for r in rows], "image long, gt int, fp int, fn int, unreachable int, seq int"))
    assert {r["image"]: r["action"] for r in queue.collect()} == dict(zip(range(1, 6), curate.ACTIONS))
    some = [(0, 0.004, True, 0.5, 0.5, "False", True), (1, 0.5, True, 0.5, 0.5, "False", True), (2, 0.5, False, 0.5, 0.5, "False", True), (3, 0.001, True, 0.01, 0.5, "True", True), (4, 0.5, True, 0.01, 0.5, "True", True), (5, 0.5, False, 0.01, 0.5, "True", True), (6, 0.5, True, 0.01, 0.5, None, False)]
    out = curate.instance_priority(spark.createDataFrame(some, "i int, area double, edge boolean, box_w double, box_h double, reachable string, queued boolean"))
    assert {r["i"]: r["suggestion"] for r in out.collect()} == dict(enumerate(curate.SUGGESTIONS))
    causes = spark.createDataFrame([(0, 0.5, 0.1, 0.0), (1, 0.5, 0.2, 0.01), (2, 0.5, 0.2, 0.02), (2, 0.4, 0.1, 0.0)], "i int, iou double, conf double, area double")
    assert all(r["c"] == curate.CAUSES[r["i"]] for r in causes.select("i", curate.miss_cause(F.col("iou"), F.col("conf"), F.col("area"), 0.5, 0.2, 0.02).alias("c")).collect())
    stats = spark.createDataFrame([(0, 8, 3, 1, 2, True), (1, 5, 1, 0, 0, False), (2, 4, 0, 0, 0, True), (3, 4, 0, 0, 1, False)], "image int, n int, small int, tiny int, edge int, hard boolean")
    got = {r["image"]: (r["repeat"], r["reasons"]) for r in curate.repeats(stats, F.col("hard")).collect()}
    assert got == {0: (5, "dense_instances>=8,small_instances>=3,tiny_instances>=1,edge_instances>=2,team128_hard_source"), 1: (3, "multi_instances>=5,small_instances>=1"), 2: (2, "team128_hard_source"), 3: (1, "base")}
    ids = {r["p"]: r["i"][:-11] for r in spark.createDataFrame([("a/..é b.c_.jpg",), ("é.png",), ("x-1_y.z.png",)], "p string").select("p", text.stable_id(F.col("p")).alias("i")).collect()}
    assert ids == {"a/..é b.c_.jpg": "b_c", "é.png": "image", "x-1_y.z.png": "x-1_y_z"}
    files = lambda *splits: spark.createDataFrame([(x,) for x in splits], "split string")
    assert validate.ready(files("train", "val", "test"), files("train", "val", "test")) and not validate.ready(files("train", "val"), files("train", "val", "test"))


def test_consensus_by_hand(spark):
    """Two models agree on one object; a third prediction stands alone; two seeds of one representative count once."""
    from maskara.operators import consensus, pairs

    preds = spark.createDataFrame([(1, 0, 0.9, 0.1, "a", 0, 0, 9, 9), (1, 1, 0.8, 0.1, "b", 0, 0, 9, 8), (1, 2, 0.7, 0.1, "a", 30, 30, 39, 39)], "image int, idx int, conf double, area double, model string, x0 int, y0 int, x1 int, y1 int")
    gts = spark.createDataFrame([(1, 0, 0, 0, 9, 9), (2, 0, 0, 0, 9, 9)], "image int, idx int, x0 int, y0 int, x1 int, y1 int")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image int")
    rows = consensus.per_image(images, preds, gts, pairs.pred_gt(preds, gts), pairs.pred_pred(preds))
    grid = spark.createDataFrame([(0, 0.1, 0.0, 2, 0.5, 0.3), (1, 0.1, 0.0, 1, 0.5, 0.3), (2, 0.1, 0.0, 2, 0.95, 0.3)], "grid_seq int, conf double, min_area double, min_support int, support_iou double, nms_iou double")
    got = {(r.grid_seq, r.image): (r.tp, r.fp, r.fn) for r in consensus.evaluated(rows, grid).collect()}
    assert [got[k, 1] for k in range(3)] == [(1, 0, 0), (1, 1, 0), (0, 0, 1)]
    assert all(got[k, 2] == (0, 0, 1) and got[k, 3] == (0, 0, 0) for k in range(3))


def test_top_k_losses_add_up(spark):
    from maskara.operators import pairs

    preds = spark.createDataFrame([(1, i, 0.5, 0.1 * i) for i in range(5)], "image int, idx int, conf double, area double")
    assert pairs.top_k_losses(preds, 3, 0.15).first().asDict() == {"image": 1, "found": 5, "truncated": 2, "filtered_by_area": 2, "kept": 1}
    assert [r.idx for r in pairs.top_k_then_area(preds, 3, 0.15).collect()] == [2]


def test_long_chains_of_reassignment():
    from maskara.operators.matching import maximum_matching

    n = 400
    chain = {i: [i, i + 1] for i in range(n)} | {n: [0]}
    got = maximum_matching(chain, [*range(n), n])
    assert len(got) == n + 1 and sorted(got.values()) == list(range(n + 1)) and all(t in chain[p] for t, p in got.items())


def test_perceptual_pairs_shuffle_no_pixels(spark):
    """Images that no pair names go through no shuffle with their pixels: what is written is far less than the images."""
    rng = np.random.default_rng(5)
    rows = [(("train", "val", "test")[i % 3], f"{i:03d}", bytearray(rng.integers(0, 256, 128 * 128, dtype=np.uint8).tobytes())) for i in range(300)]
    rows.append(("test", "copy", rows[0][2]))
    df = spark.createDataFrame(rows, "split string, key string, pixels binary").localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
    before = written()
    assert [(r.a_key, r.b_key, r.turn) for r in leakage.perceptual_pairs(df).collect()] == [("000", "copy", 0)]
    assert written() - before < 300 * 128 * 128 / 2
    assert all(len(r.v) == 512 for r in leakage.coarse_vectors(df).select("v").collect())


def test_perceptual_pairs_shuffle_grows_with_images(spark):
    """Four times the images, of which none fit, in blocks of 32: what is shuffled grows by about four, as images meet only those that lie near."""
    rng = np.random.default_rng(6)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
    took = []
    for n in (300, 1200):
        rows = [(("train", "val", "test")[i % 3], f"{i:04d}", bytearray(np.kron(np.tile(rng.integers(0, 128, (2, 16)), (8, 1)), np.ones((8, 8))).astype(np.uint8).tobytes())) for i in range(n)]
        vectors = leakage.coarse_vectors(spark.createDataFrame(rows, "split string, key string, pixels binary")).localCheckpoint()
        before = written()
        assert leakage.coarse_pairs(vectors, block=32).count() == 0
        took.append(written() - before)
    assert took[1] < 6 * took[0]


def test_places_lose_no_pair(spark):
    """Places lie no further apart than images under any turn, and an image goes to the cell of every place within reach."""
    from maskara.functions import raster

    rng = np.random.default_rng(7)
    base = [rng.integers(0, 128, (16, 16)) for _ in range(60)] + [np.tile(rng.integers(0, 128, (2, 16)), (8, 1)) for _ in range(60)] + [np.add.outer(np.arange(16), np.arange(16)) * 3 + rng.integers(0, 9, (16, 16)) for _ in range(60)]
    near = [raster.d4(np.clip(x + rng.normal(0, rng.choice([0, 1, 3]), (16, 16)), 0, 127).round())[i % 8] for i, x in enumerate(base)]
    sums = [(np.asarray(x) * 64).astype("<u2").tobytes() for x in base + near]
    df = spark.createDataFrame([(bytearray(s),) for s in sums], "v binary")
    places = leakage.fitted(df, 40)
    unit = leakage._units(sums)
    apart = np.sqrt(np.maximum(2 - 2 * np.max([unit @ unit[:, turn].T for turn in leakage.turn_places()], axis=0), 0))
    y = places.of(sums).astype(np.float64)
    between = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    assert len(places.pivots) == 40 and (between <= apart + leakage.SLACK).all()
    for reach in (0.03, 0.103, 0.4):
        home, may = places.cells(y, reach)
        assert all(may[j, home[i]] for i, j in zip(*np.nonzero(between <= reach)))
    assert not places.cells(y, 0.103)[1].all()


def test_totals_of_lines_in_one_pass(spark):
    """Counts of label lines equal those of their issues row by row, with the lines read and ordered once."""
    from maskara.plans import curation

    ring = "0.1 0.1 0.4 0.1 0.4 0.4"
    texts = [f"0 {ring}", f"3 {ring} 0.5 1.5", "", "  ", None, "0 0.1", f"a {ring}", "0 0.1 0.1 0.1001 0.1 0.1 0.1001", f"0\t{ring} ", "3 2 2 2 2 2 2"]
    lines = spark.createDataFrame([("ab"[i % 2] if i < 8 else None, i // 2, i, t) for i, t in enumerate(texts)], "split string, stem int, line int, text string")
    want = validate.split_totals(lines.select("split", "stem").distinct(), lines, validate.check_lines(lines))
    assert sorted(map(str, validate.line_totals(lines).collect())) == sorted(map(str, want.collect()))
    assert validate.line_totals(lines.limit(0)).count() == 0
    plan = curation.split_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "format_string" not in plan
