"""Exact, scene and perceptual leaks between splits."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import raster
from .order import cut, numbered, small

PRIORITY = ("test", "val", "train")


def duplicates(assets: DataFrame) -> DataFrame:
    """sha256, n, splits, cross_split of content that several assets share."""
    return assets.groupBy("sha256").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), (F.count_distinct("split") > 1).alias("cross_split")).filter("n > 1")


def _conflicts(rows: DataFrame, protected: DataFrame, label: str) -> DataFrame:
    """rows with why: label_scene, label_sha256, label_scene_and_sha256 or null. Two joins on distinct keys, as one on either key
    would compare all rows."""
    scenes = protected.select("scene").distinct().withColumn("_scene", F.lit(True))
    hashes = protected.select("sha256").distinct().withColumn("_sha", F.lit(True))
    both = rows.join(scenes, "scene", "left").join(hashes, "sha256", "left")
    scene, sha = F.col("_scene").isNotNull(), F.col("_sha").isNotNull()
    why = F.when(scene & sha, f"{label}_scene_and_sha256").when(scene, f"{label}_scene").when(sha, f"{label}_sha256")
    return both.withColumn("why", why).drop("_scene", "_sha")


def leak_free(assets: DataFrame) -> DataFrame:
    """assets with why: null for what stays. Test is frozen; val gives way to test; train to test, then to the val rows that stay."""
    test = assets.filter("split = 'test'")
    val = _conflicts(assets.filter("split = 'val'"), test, "protected_test")
    clean = val.filter("why IS NULL").select(*assets.columns)
    train = _conflicts(assets.filter("split = 'train'"), test, "protected_test").withColumnRenamed("why", "_first")
    train = _conflicts(train, clean, "clean_val").withColumn("why", F.coalesce("_first", "why")).drop("_first")
    return test.withColumn("why", F.lit(None).cast("string")).unionByName(val).unionByName(train)


def first_of(assets: DataFrame, key: str) -> DataFrame:
    """assets with first: whether a row is the first of its key by lower-case name, then name."""
    order = Window.partitionBy(key).orderBy(F.lower("name"), "name", "image")
    return assets.withColumn("first", F.row_number().over(order) == 1)


def shared_keys(assets: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Keys in both splits; an invariant is that there are none."""
    side = lambda s: assets.filter(F.col("split") == s).select(key)
    return side(a).intersect(side(b))


#: Sides of the coarse and the full image; rows of a block on each side, and of a tile of it that is compared at a time; images that are broadcast by name.
COARSE, FINE = 16, 128
BLOCK_ROWS, TILE_ROWS = 8192, 256
BROADCAST_IMAGES = 500_000
#: Images that the axes of places are fitted on, axes, pivots, and pivots next to an image that rule out others; what rounding moves two places apart at most.
FIT_ROWS, AXES, PIVOTS, NEXT, SLACK = 4096, 32, 512, 8, 3e-3
PAIR = ("a_split", "a_key", "b_split", "b_key")


def _waves(n: int) -> np.ndarray:
    """Orthonormal cosines [frequency, place]."""
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def turn_places(n: int = COARSE) -> np.ndarray:
    """[turn, place]: where each place of a turned image comes from, by the order of ``raster.d4``."""
    return np.stack([v.ravel() for v in raster.d4(np.arange(n * n).reshape(n, n))])


def lengths(small: np.ndarray) -> np.ndarray:
    """Of images [row, n, n], a length for each pair of frequencies (the smaller first). A turn or a mirror swaps the two frequencies or flips signs, so it
    leaves them as they are; and as lengths of orthogonal parts, their inner product is at least that of the images, under any turn."""
    waves = _waves(small.shape[1])
    a = (waves @ small @ waves.T) ** 2
    i, j = np.triu_indices(small.shape[1])
    return np.sqrt(a[:, i, j] + np.where(i != j, a[:, j, i], 0))


def _units(sums: list[bytes]) -> np.ndarray:
    """Sums of the blocks of images -> [row, place], each less its mean, over its length; nan for one of one shade."""
    small = np.frombuffer(b"".join(sums), dtype="<u2").reshape(-1, COARSE * COARSE) / (FINE // COARSE) ** 2
    small -= small.mean(1, keepdims=True)
    length = np.linalg.norm(small, axis=1)
    return small / np.where(length > np.finfo(np.float64).eps, length, np.nan)[:, None]


def sketched(images: DataFrame) -> DataFrame:
    """split, key, pixels (gray, FINE x FINE bytes) -> split, key, content (SHA-256 of the pixels), v (the coarse image: sums of blocks of pixels, in 2 bytes
    each). An image of one shade has no direction: v is null. Later steps need no pixels until pairs are confirmed."""

    def sketch(batches):
        step = FINE // COARSE
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_ROWS):
                batch = whole.slice(at, TILE_ROWS)
                pixels = batch.column("pixels").to_pylist()
                raw = np.frombuffer(b"".join(pixels), dtype=np.uint8).reshape(-1, COARSE, step, FINE)
                raw = raw.sum(2, dtype="<u2").reshape(-1, COARSE, COARSE, step).sum(3, dtype="<u2")
                sums = [x.tobytes() for x in raw]
                columns = [pa.array([hashlib.sha256(x).digest() for x in pixels], pa.binary()), pa.array(sums, pa.binary(), mask=np.isnan(_units(sums)[:, 0]))]
                yield pa.RecordBatch.from_arrays([batch.column("split"), batch.column("key"), *columns], names=["split", "key", "content", "v"])

    return images.select("split", "key", "pixels").mapInArrow(sketch, "split string, key string, content binary, v binary")


def members_of(seen: DataFrame) -> DataFrame:
    """split, key, content of every image -> split, key and rep, the smallest key of that content in that split."""
    first = seen.groupBy("split", "content").agg(F.min("key").alias("rep"))
    return seen.select("split", "content", "key").join(first, ["split", "content"]).select("split", "key", "rep")


def classes_of(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """split, key, pixels (gray, FINE x FINE bytes) -> (the image of smallest key of each split and content, with its pixels; split, key and rep, that key, of
    every image)."""
    members = members_of(images.select("split", "key", F.sha2("pixels", 256).alias("content")))
    return images.join(members.select("split", F.col("rep").alias("key")), ["split", "key"], "left_semi").dropDuplicates(["split", "key"]), members


def coarse_vectors(images: DataFrame) -> DataFrame:
    """split, key, v of ``sketched`` images that are not of one shade."""
    return sketched(images).filter("v IS NOT NULL").select("split", "key", "v")


def _shapes(sums: list[bytes]) -> np.ndarray:
    return lengths(_units(sums).reshape(-1, COARSE, COARSE))


class Places(NamedTuple):
    """Axes of lengths from their mean, fitted on a bounded sample, and pivots among the places that they give. Whatever the sample, places lie no further
    apart than the images under any turn: axes are orthonormal, and the last coordinate is the length of what they leave."""

    mean: np.ndarray
    axes: np.ndarray
    pivots: np.ndarray
    apart: np.ndarray

    def of(self, sums: list[bytes]) -> np.ndarray:
        off = _shapes(sums) - self.mean
        y = off @ self.axes
        return np.column_stack([y, np.sqrt(np.maximum((off**2).sum(1) - (y**2).sum(1), 0))]).astype("<f2")

    def cells(self, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each place, and [place, pivot]: whether that pivot may be the nearest of a place within reach. Such a place is at most reach
        beyond the plane midway to any other pivot; a few pivots next to the place are tried."""
        d = (y**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * y @ self.pivots.T
        may, rows = np.ones(d.shape, dtype=bool), np.arange(len(d))
        order = np.argpartition(d, min(NEXT, d.shape[1]) - 1, axis=1)[:, :NEXT]
        for k in order.T:
            may &= d - d[rows, k][:, None] <= 2 * reach * self.apart[k] + 1e-9
        return d.argmin(1), may


def fitted(vectors: DataFrame, pivots: int = PIVOTS) -> Places | None:
    """Places fitted on FIT_ROWS of the coarse images v, those of the smallest hashes; None where there is none."""
    sums = [bytes(r["v"]) for r in vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).collect()]
    if not sums:
        return None
    x = _shapes(sums)
    mean = x.mean(0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, :AXES]
    y = Places(mean, axes, np.zeros((0, 0)), np.zeros((0, 0))).of(list(dict.fromkeys(sums))).astype(np.float64)
    y = y[: max(1, min(pivots, len(y) // 8))]
    return Places(mean, axes, y, np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)))


def near_pairs(vectors: DataFrame, at_least: float = 0.995, block: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """a_split, a_key, b_split, b_key: all pairs of images of different splits whose places lie within the distance of that correlation, so all that fit at it and
    few others. vectors: split, key, v, and content where copies in a split are to stand for each other (by the smallest key).

    Unit images of correlation c lie sqrt(2 - 2c) apart, and places no further. An image of the side a goes to the cell of its nearest pivot, one of b to the
    cells of all pivots that may be the nearest of a place within that distance, so a pair meets in exactly one. A cell is compared in blocks of
    about ``block`` rows on each side, each block pair in a task of its own. A place takes 66 bytes; coarse images stay where they are.
    """
    schema = ", ".join(f"{c} string" for c in PAIR)
    places = fitted(vectors, pivots)
    if places is None:
        return vectors.sparkSession.createDataFrame([], schema)
    reach = float(np.sqrt(max(2 - 2 * at_least, 0.0))) + SLACK
    own = [c for c in vectors.columns if c in ("split", "key", "content")]

    def placed(batches):
        for batch in batches:
            y = places.of(batch.column("v").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([r.tobytes() for r in y], pa.binary())], names=[*own, "y"])

    def celled(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                home, may = places.cells(_read(batch.column("y")), reach)
                may &= (batch.column("side").to_numpy() > 1)[:, None]
                cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(may.sum(1))), pa.int32()), pa.array(np.nonzero(may)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), cells], names=[*batch.schema.names, "home", "cells"])

    rows = vectors.select(*own, "v").mapInArrow(placed, ", ".join(f"{c} {'binary' if c == 'content' else 'string'}" for c in own) + ", y binary")
    if "content" in own:
        rows = rows.groupBy("split", "content").agg(F.min("key").alias("key"), F.first("y").alias("y"))
    place = F.array_position(F.array(*map(F.lit, reversed(PRIORITY))), F.col("split")).cast("int")
    rows = rows.select("split", "key", place.alias("side"), "y").filter("side > 0")
    rows = cut(rows.mapInArrow(celled, "split string, key string, side int, y binary, home int, cells array<int>"))
    a = rows.filter(F.col("side") < len(PRIORITY)).select("split", "key", "side", "y", F.col("home").alias("cell"))
    b = rows.select("split", "key", "side", "y", F.explode("cells").alias("cell"))
    sizes = lambda x, name: x.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    shape = cut(sizes(a, "na").join(sizes(b, "nb"), "cell"))  # blocks of each cell that has both sides

    def dealt(x: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        part = x.join(F.broadcast(shape), "cell").withColumn(i, F.pmod(F.xxhash64("split", "key"), F.col(own)).cast("int"))  # a row a pivot at most
        return part.withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("cell", "i", "j", *(F.col(c).alias(c) for c in ("split", "key", "side", "y")))  # columns of its own, as both sides are of one table

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.string())] * len(PAIR), names=list(PAIR))
        u, v = (_read(t.column("y")).astype(np.float32) for t in (x, y))
        side_u, side_v = (t.column("side").to_numpy() for t in (x, y))
        found, long = [], (v**2).sum(1)
        for start in range(0, len(u), TILE_ROWS):
            tile = u[start : start + TILE_ROWS]
            p, q = np.nonzero((tile**2).sum(1)[:, None] + long - 2 * tile @ v.T <= reach**2 + 1e-4)  # more than single precision is out by
            ok = side_u[p + start] < side_v[q]
            found.append((p[ok] + start, q[ok]))
        p, q = (np.concatenate(z) for z in zip(*found))
        columns = [t.column(c).take(pa.array(at_)).combine_chunks() for t, at_ in ((x, p), (y, q)) for c in ("split", "key")]
        return pa.Table.from_arrays(columns, names=list(PAIR))

    left, right = (dealt(*z).groupBy("cell", "i", "j") for z in ((a, "na", "nb", "i", "j"), (b, "nb", "na", "j", "i")))
    return left.cogroup(right).applyInArrow(compare, schema)


def _read(y: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(y.to_pylist()), dtype="<f2").reshape(len(y), -1).astype(np.float64)


def coarse_pairs(vectors: DataFrame, at_least: float = 0.995, block: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """a_split, a_key, b_split, b_key, turn, coarse of all images of different splits (a's before b's in train, val, test) that fit at that correlation under
    the best turn of b; of equals the first turn. Only coarse images that ``near_pairs`` names are shuffled. vectors must be cheap to read twice."""
    near = cut(near_pairs(vectors, at_least, block, pivots).distinct())  # two images of one name would name a pair twice
    turns = turn_places()

    def fit(batches):
        for batch in batches:
            u, v = (_units(batch.column(c).to_pylist()) for c in ("a_v", "b_v"))
            best, turn = np.full(len(u), -np.inf), np.zeros(len(u), dtype=np.int32)
            for k, places in enumerate(turns):
                now = np.einsum("rp,rp->r", u, v[:, places])
                better = now > best
                best[better], turn[better] = now[better], k
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in PAIR), pa.array(turn, pa.int32()), pa.array(best, pa.float64())], names=[*PAIR, "turn", "coarse"])
            yield made.filter(pa.array(best >= at_least))

    both = _joined(near, vectors.select("split", "key", "v"))
    return both.select(*PAIR, "a_v", "b_v").mapInArrow(fit, ", ".join(f"{c} string" for c in PAIR) + ", turn int, coarse double")


def _joined(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """pairs with the third column of images for a and for b; only images that they name are shuffled. Pairs must be cheap to read twice."""
    what = images.columns[2]
    named = cut(pairs.select(F.col("a_split").alias("split"), F.col("a_key").alias("key")).union(pairs.select("b_split", "b_key")).distinct())
    images = images.join(small(named, BROADCAST_IMAGES), ["split", "key"], "left_semi").dropDuplicates(["split", "key"])
    for p in "ab":
        pairs = pairs.join(images.select(F.col("split").alias(f"{p}_split"), F.col("key").alias(f"{p}_key"), F.col(what).alias(f"{p}_{what}")), [f"{p}_split", f"{p}_key"])
    return pairs


def confirmed(pairs: DataFrame, images: DataFrame, at_least: float = 0.995, ssim_at_least: float = 0.96) -> DataFrame:
    """coarse_pairs() with confirm (correlation at full size under the same turn) and ssim, of those that reach both. Pairs must be cheap to read twice;
    only the images that they name are shuffled."""
    both = _joined(pairs, images.select("split", "key", "pixels"))
    names = [*PAIR, "turn", "coarse"]

    def confirm(batches):
        for batch in batches:
            fit, alike = [], []
            for a, b, t in zip(batch.column("a_pixels").to_pylist(), batch.column("b_pixels").to_pylist(), batch.column("turn").to_pylist()):
                x = np.frombuffer(a, dtype=np.uint8).reshape(FINE, FINE)
                y = raster.d4(np.frombuffer(b, dtype=np.uint8).reshape(FINE, FINE))[t]
                fit.append(float(raster.unit(x) @ raster.unit(y)))
                alike.append(raster.ssim(x, y) if fit[-1] >= at_least else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fit, pa.float64()), pa.array(alike, pa.float64())], names=[*names, "confirm", "ssim"])

    out = both.select(*names, "a_pixels", "b_pixels").mapInArrow(confirm, "a_split string, a_key string, b_split string, b_key string, turn int, coarse double, confirm double, ssim double")
    return out.filter((F.col("confirm") >= at_least) & (F.col("ssim") >= ssim_at_least))


def perceptual_pairs(images: DataFrame, coarse_at_least: float = 0.995, confirm_at_least: float = 0.995, ssim_at_least: float = 0.96, seen: DataFrame | None = None) -> DataFrame:
    """split, key, pixels -> near-duplicate pairs of different splits, with the turn of b that fits best: candidates by the coarse image, all of them, then
    measured at full size. Copies of one content in a split stand for each other: pairs name the smallest key of each, ``members_of`` the rest.
    seen: ``sketched`` images, where these are kept already."""
    seen = cut(sketched(images)) if seen is None else seen
    return confirmed(cut(coarse_pairs(seen.filter("v IS NOT NULL"), coarse_at_least)), images, confirm_at_least, ssim_at_least)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of strings -> (node, root), root the smallest node reached: labels spread along edges, and to what their root knows, until none changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = now.join(near, "node").select("node", F.least("root", "seen").alias("root"), (F.col("seen") < F.col("root")).alias("moved"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = cut(step.join(jump, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "moved"))
        now = step.select("node", "root")
        if not step.filter("moved").limit(1).count():
            return now


def prioritized(rows: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """rows (split, key, scene) with removed and group: in each component of pairs the split of highest priority stays, and the others
    lose the whole scene of each member within their split; group is the number of the component, in order.

    Where pairs name one image of each content, members (split, key, rep: ``classes_of``) brings its copies into the component.
    """
    node = lambda s, k: F.concat_ws("\0", s, k)
    found = components(pairs.select(node("a_split", "a_key").alias("a"), node("b_split", "b_key").alias("b")))
    names = numbered(found.select("root").distinct(), ["root"], "_n").select("root", F.format_string("d4_group_%04d", F.col("_n") + 1).alias("group"))
    own = found.join(names, "root").select(F.substring_index("node", "\0", 1).alias("split"), F.substring_index("node", "\0", -1).alias("key"), "group")
    own = own if members is None else members.join(own.withColumnRenamed("key", "rep"), ["split", "rep"]).select("split", "key", "group")
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("split"))
    best = own.groupBy("group").agg(F.min(rank).alias("best"))
    losers = own.join(best, "group").filter(rank > F.col("best"))
    scenes = losers.join(rows, ["split", "key"]).groupBy("split", "scene").agg(F.min("group").alias("scene_group"))
    out = rows.join(own, ["split", "key"], "left").join(scenes, ["split", "scene"], "left")
    return out.withColumn("removed", F.col("scene_group").isNotNull()).withColumn("group", F.coalesce("group", "scene_group")).drop("scene_group")


def check_priority(done: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> None:
    """Stops where prioritized() rows lose an image of the first split, or keep both sides of a pair."""
    if done.filter(F.col("removed") & (F.col("split") == PRIORITY[0])).limit(1).count():
        raise ValueError(f"an image of {PRIORITY[0]} would be removed")
    kept = done.filter("NOT removed").select("split", "key")
    kept = kept if members is None else members.join(kept, ["split", "key"], "left_semi").select("split", F.col("rep").alias("key")).distinct()
    both = pairs
    for p in "ab":
        both = both.join(kept.select(F.col("split").alias(f"{p}_split"), F.col("key").alias(f"{p}_key")), [f"{p}_split", f"{p}_key"], "left_semi")
    if both.limit(1).count():
        raise ValueError("pairs remain between splits")


def duplicate_semantics(assets: DataFrame) -> DataFrame:
    """Hashes whose copies differ in size (dimension_conflict) or in their polygons' signatures (label_conflict)."""
    per = assets.groupBy("sha256").agg(F.count("*").alias("n"), F.count_distinct("width", "height").alias("sizes"), F.count_distinct("polygons").alias("labels")).filter("n > 1")
    return per.withColumn("conflict", F.when(F.col("sizes") > 1, "dimension_conflict").when(F.col("labels") > 1, "label_conflict")).filter("conflict IS NOT NULL")
