"""Masks in plans: made once per instance in Arrow batches, compared in the JVM.

A mask is a struct of its box in pixels (x0, y0, x1, y1, both ends included), its pixels ``n`` and its ``strips``: for each
column of 64 pixels from x0 // 64 on, one word of bits for each row of the box. So it takes the room of its box and not of the
raster, and what two masks share is the bit count of the rows and strips that both have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import raster
from ..functions.geometry import edge_distance
from .order import each_of

#: Fixed value: the side of the raster that masks of different images are compared on.
SIZE = 768
#: Pixels of a word; polygons whose masks a task holds at once.
WORD, AT_ONCE = 64, 256
MASK = StructType([*(StructField(c, IntegerType()) for c in ("x0", "y0", "x1", "y1", "n")), StructField("strips", ArrayType(ArrayType(LongType())))])


def pack(pixels: np.ndarray) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """Whole pixel points [n, (x, y)] of a polygon -> its box and pixels, words [strip, row]."""
    if not len(pixels):
        return (0, 0, -1, -1, 0), np.zeros((0, 0), dtype=np.int64)
    (x0, y0), (x1, y1) = pixels.min(0).tolist(), pixels.max(0).tolist()
    left = x0 // WORD * WORD
    width = (x1 // WORD + 1) * WORD - left
    mask = raster.filled(pixels - np.array([left, y0]), y1 - y0 + 1, width)
    words = np.packbits(mask, axis=1, bitorder="little").view("<i8")
    return (x0, y0, x1, y1, int(mask.sum())), np.ascontiguousarray(words.T)


def _counts(lists: pa.Array) -> np.ndarray:
    return np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)


def _points(polygons: pa.Array) -> np.ndarray:
    """x, y of all points, end to end."""
    flat = polygons.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)


def _pixels(xy: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """The pixels that points round to, half to even, in single precision; points beyond the image are moved to its edge."""
    return np.rint(np.clip(xy.astype(np.float32), 0, 1) * (np.asarray(size, dtype=np.float32) - np.float32(1))).astype(np.int64)


def _strips(boxes: np.ndarray, starts: np.ndarray, words: np.ndarray) -> pa.ListArray:
    """``raster.filled_words`` as MASK has them: each strip's words, of the rows in order."""
    high = boxes[:, 3] - boxes[:, 1] + 1
    across = np.divide(np.diff(starts), high, out=np.zeros(len(high)), where=high > 0).astype(np.int64)
    of, k = raster._each(across)
    own, row = raster._each(high[of])
    order = starts[:-1][of][own] + row * across[of][own] + k[own]
    ends = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
    return pa.ListArray.from_arrays(ends(across), pa.ListArray.from_arrays(ends(high[of]), pa.array(words[order])))


def _packed(polygons: pa.Array, size: int) -> pa.StructArray:
    boxes, starts, words, n = raster.filled_words(_pixels(_points(polygons), size), _counts(polygons), WORD)
    columns = [*boxes.T, n]
    return pa.StructArray.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), _strips(boxes, starts, words)], [f.name for f in MASK.fields])


def packed(polygon: Column, size: int = SIZE) -> Column:
    """The polygon's mask on size x size. Of a null or empty polygon: no pixels, a box of no place."""

    @F.arrow_udf(MASK)
    def masks(polygons: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in polygons:
            for at in range(0, max(len(batch), 1), AT_ONCE):
                yield _packed(batch.slice(at, AT_ONCE), size)

    return masks(polygon)


def shared(a: Column, b: Column) -> Column:
    """Pixels that two masks have in common; 0 where their boxes are apart, without a look at the words."""
    top, rows = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) + 1
    strip = lambda m, c: F.shiftright(m[c], 6)
    first, last = F.greatest(strip(a, "x0"), strip(b, "x0")), F.least(strip(a, "x1"), strip(b, "x1"))
    words = lambda m, k: F.slice(F.get(m["strips"], k - strip(m, "x0")), top - m["y0"] + 1, rows)
    bits = lambda k: F.aggregate(F.zip_with(words(a, k), words(b, k), lambda u, v: F.bit_count(u.bitwiseAND(v))), F.lit(0), lambda s, c: s + c)
    meet = (a["n"] > 0) & (b["n"] > 0) & (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
    return F.when(meet, F.aggregate(F.sequence(first, last), F.lit(0), lambda s, k: s + bits(k))).otherwise(0)


def within(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Pixels of a mask in x0 <= x < x1 and y0 <= y < y1."""
    top = F.greatest(m["y0"], y0)
    rows = F.least(m["y1"] + 1, y1) - top
    first, last = F.greatest(F.shiftright(m["x0"], 6), F.shiftright(x0, 6)), F.least(F.shiftright(m["x1"], 6), F.shiftright(x1 - 1, 6))
    ones = F.lit(-1).cast("long")

    def bits(k: Column) -> Column:
        low, high = F.greatest(x0 - k * WORD, F.lit(0)), F.least(x1 - k * WORD, F.lit(WORD))
        word = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, WORD - high))
        return F.aggregate(F.slice(F.get(m["strips"], k - F.shiftright(m["x0"], 6)), top - m["y0"] + 1, rows), F.lit(0), lambda s, v: s + F.bit_count(v.bitwiseAND(word)))

    meet = (m["n"] > 0) & (x0 < x1) & (rows > 0) & (first <= last)
    return F.when(meet, F.aggregate(F.sequence(first, last), F.lit(0), lambda s, k: s + bits(k))).otherwise(0)


def shared_box(a: Column, b: Column) -> Column:
    """The same of boxes of whole pixels, structs x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + 1, F.lit(0))
    return side("x0", "x1") * side("y0", "y1")


def box(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """A box as a shape: its corners and its pixels ``n``."""
    return F.struct(F.col(x0).alias("x0"), F.col(y0).alias("y0"), F.col(x1).alias("x1"), F.col(y1).alias("y1"), ((F.col(x1) - F.col(x0) + 1) * (F.col(y1) - F.col(y0) + 1)).alias("n"))


def over_union(n: Column, a: Column, b: Column) -> Column:
    """Intersection over union of what is shared and the pixels of each."""
    return n.cast("double") / (a + b - n)


def with_masks(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (points, ...) with shape (the mask), area (its share of the raster) and edge (the least distance of a point from the image's edge)."""
    out = rows.withColumn("shape", packed(F.col("points"), size))
    return out.withColumn("area", F.col("shape.n") / F.lit(float(size * size))).withColumn("edge", edge_distance(F.col("points")))


#: A mask among those of its image: ``at``, its place there (predictions first), the least distance of a point from the edge, and the ``others`` that a
#: prediction shares pixels with, by place, and how many (``common``). Arrays, as structs with maps have no order.
SEEN = StructType([*(StructField(c, IntegerType()) for c in ("x0", "y0", "x1", "y1", "n", "at")), StructField("edge", DoubleType()), *(StructField(c, ArrayType(IntegerType())) for c in ("others", "common"))])
#: Pairs of masks, and words of pairs, that a task looks at at once.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 1 << 18, 1 << 20


def with_outlines(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """As with_masks(), of polygons that ``matching.gathered`` is to draw: the words of masks then stay in its tasks, which keep what they share. Their
    ``shared`` is ``looked_up``."""
    out = rows.withColumn("shape", F.struct(F.col("points").alias("points"), F.lit(size).alias("size")))
    return out.withColumn("area", F.lit(None).cast("double")).withColumn("edge", F.lit(None).cast("double"))


def looked_up(a: Column, b: Column) -> Column:
    """As shared(), of a prediction and any other mask of its image, after ``compared``."""
    return F.coalesce(F.get(a["common"], F.array_position(a["others"], b["at"]).cast("int") - 1), F.lit(0))


def _common(a: np.ndarray, b: np.ndarray, boxes: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Pixels that the masks a[i] and b[i] share."""
    p, q = boxes[a], boxes[b]
    out = np.zeros(len(a), dtype=np.int64)
    meet = np.flatnonzero((np.maximum(p[:, :2], q[:, :2]) <= np.minimum(p[:, 2:], q[:, 2:])).all(1))
    while len(meet):
        p, q = boxes[a[meet]], boxes[b[meet]]
        top, rows = np.maximum(p[:, 1], q[:, 1]), np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]) + 1
        left, right = np.maximum(p[:, 0], q[:, 0]) // WORD, np.minimum(p[:, 2], q[:, 2]) // WORD
        size = rows * (right - left + 1)
        now = max(1, int(np.searchsorted(np.cumsum(size), WORDS_AT_ONCE, "right")))
        of, k = raster._each(size[:now])
        row, strip = np.divmod(k, (right - left + 1)[of])
        at = lambda m, box_: starts[m] + (top - box_[:, 1]) * (box_[:, 2] // WORD - box_[:, 0] // WORD + 1) + left - box_[:, 0] // WORD
        across = lambda box_: (box_[:, 2] // WORD - box_[:, 0] // WORD + 1)[of]
        u, v = (words[at(m[meet], box_)[of] + row * across(box_) + strip] for m, box_ in ((a, p), (b, q)))
        out[meet[:now]] = np.add.reduceat(np.bitwise_count((u & v).view(np.uint64)), np.append(0, np.cumsum(size[: now - 1])), dtype=np.int64)
        meet = meet[now:]
    return out


def _common_rows(a: np.ndarray, b: np.ndarray, boxes: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """As _common(), of ``raster.convex_rows``."""
    p, q = boxes[a], boxes[b]
    out = np.zeros(len(a), dtype=np.int64)
    meet = np.flatnonzero((np.maximum(p[:, :2], q[:, :2]) <= np.minimum(p[:, 2:], q[:, 2:])).all(1))
    top = np.maximum(p[meet, 1], q[meet, 1])
    rows = np.minimum(p[meet, 3], q[meet, 3]) - top + 1
    first = [starts[x[meet]] + top - box_[meet, 1] for x, box_ in ((a, p), (b, q))]
    ends, done = np.cumsum(rows), 0
    while done < len(meet):
        more = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + WORDS_AT_ONCE, "right")))
        n = rows[done:more]
        of, k = raster._each(n)
        u, v = (x[done:more][of] + k for x in first)
        both = np.maximum(np.minimum(high[u], high[v]) - np.maximum(low[u], low[v]) + 1, 0)
        out[meet[done:more]] = np.add.reduceat(both, np.cumsum(n) - n)
        done = more
    return out


def _laps(n_p: np.ndarray, n_t: np.ndarray, boxes: np.ndarray, starts: np.ndarray, *drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images with so many predictions and truths, in turn: (mask, place, pixels) of what each prediction shares with another mask of its image.
    drawn: the words of masks, or the first and last pixels of their rows."""
    common = _common if len(drawn) == 1 else _common_rows
    first = np.cumsum(n_p + n_t) - n_p - n_t
    image, i = raster._each(n_p)
    todo = i + n_t[image]  # those before it, and the truths
    ends, done, out = np.cumsum(todo), 0, []
    while done < len(todo):
        more = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
        of, k = raster._each(todo[done:more])
        of += done
        base, own = first[image[of]], i[of]
        place = np.where(k < own, k, k - own + n_p[image[of]])
        n = common(base + own, base + place, boxes, starts, *drawn)
        some = n > 0
        base, own, place, n = base[some], own[some], place[some], n[some]
        both = place < n_p[image[of[some]]]
        out += [(base + own, place, n), ((base + place)[both], own[both], n[both])]
        done = more
    a, b, n = (np.concatenate(x) if out else np.zeros(0, dtype=np.int64) for x in (zip(*out) if out else ((), (), ())))
    order = np.lexsort((b, a))
    return a[order], b[order], n[order]


def _seen(p: pa.Array, p_size: pa.Array, t: pa.Array, t_size: pa.Array, strips: bool) -> pa.StructArray:
    """Polygons of predictions and truths, and the sizes of their rasters, of a few images."""
    n_p, n_t = _counts(p), _counts(t)
    flat = [x.flatten() for x in (p, t)]
    image = np.concatenate([np.repeat(np.arange(len(p)), n_p), np.repeat(np.arange(len(t)), n_t)])
    order = np.argsort(image, kind="stable")  # of each image its predictions, then its truths
    polygons = pa.concat_arrays(flat).take(pa.array(order))
    counts, xy = _counts(polygons), _points(polygons)
    size = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (p_size, t_size)])[order]
    pixels = _pixels(xy, np.repeat(size, counts)[:, None])
    if not strips and raster.all_convex(pixels, counts):
        boxes, starts, *drawn, n = raster.convex_rows(pixels, counts)
    else:
        boxes, starts, *drawn, n = raster.filled_words(pixels, counts, WORD)
    edge = np.full(len(counts), np.nan)
    if len(xy):
        some = counts > 0
        begins = (np.cumsum(counts) - counts)[some]
        low, high = np.minimum.reduceat(xy, begins), np.maximum.reduceat(xy, begins)
        edge[some] = np.minimum(low.min(1), (1 - high).min(1))
    a, b, both = _laps(n_p, n_t, boxes, starts, *drawn)
    at = raster._each(n_p + n_t)[1]
    ends = pa.array(np.append(0, np.cumsum(np.bincount(a, minlength=len(counts)))), pa.int32())
    laps = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (b, both))
    columns = [*(pa.array(c.astype(np.int32)) for c in (*boxes.T, n, at)), pa.array(edge, mask=np.isnan(edge)), *laps]
    names = [f.name for f in SEEN.fields]
    if strips:
        columns, names = [*columns, _strips(boxes, starts, *drawn)], [*names, "strips"]
    each = pa.StructArray.from_arrays(columns, names)
    back, cut_ = np.argsort(order, kind="stable"), int(n_p.sum())
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)), pa.int32()), each.take(pa.array(w))) for k, w in ((n_p, back[:cut_]), (n_t, back[cut_:]))]
    return pa.StructArray.from_arrays(lists, ["p", "t"])


def compared(lists: DataFrame, strips: bool = False) -> DataFrame:
    """``matching.gathered`` rows whose shapes are of with_outlines() -> the same with masks as SEEN (and with their strips), areas and edges. Masks are drawn
    and compared some images at a time."""
    kind = StructType([*SEEN.fields, *([MASK["strips"]] if strips else [])])

    @F.arrow_udf(StructType([StructField("p", ArrayType(kind)), StructField("t", ArrayType(kind))]))
    def drawn(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in columns:
            p, p_size, t, t_size = batch
            ends, done = np.cumsum(_counts(p) + _counts(t)), 0
            parts = []
            while done < len(p) or not parts:
                more = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
                parts.append(_seen(*(x.slice(done, more - done) for x in (p, p_size, t, t_size)), strips))
                done = more
            yield pa.concat_arrays(parts)

    drawn = drawn.asNondeterministic()  # else filters of later steps would draw all masks once more
    shape = lambda c, f: F.col(c)["shape"][f]
    made = lists.withColumn("_seen", drawn(shape("p", "points"), shape("p", "size"), shape("t", "points"), shape("t", "size")))

    def filled(c: str) -> Column:
        fields = lists.schema[c].dataType.elementType.fieldNames()
        size = lambda x: x["shape"]["size"].cast("double")

        def one(x: Column, i: Column) -> Column:
            seen = F.get(F.col("_seen")[c], i)
            new = {"shape": seen, "area": seen["n"] / (size(x) * size(x)), "edge": seen["edge"]}
            return F.struct(*(new.get(f, x[f]).alias(f) for f in fields))

        return F.transform(c, one)

    return made.withColumn("p", filled("p")).withColumn("t", filled("t")).drop("_seen")


def pairs_of(lists: DataFrame, shared_: Callable[[Column, Column], Column] = shared) -> DataFrame:
    """``matching.gathered`` rows -> image, p_idx, g_idx, inter, iou of predictions and truths that share a pixel. The image gathers its rows once;
    the words of a pair are read only where its boxes meet."""
    if "common" in lists.schema["p"].dataType.elementType["shape"].dataType.fieldNames():  # what is shared is counted already
        own = F.transform("p", lambda x: F.struct(x["idx"].alias("idx"), x["shape"]["n"].alias("n"), F.arrays_zip(x["shape"]["others"].alias("at"), x["shape"]["common"].alias("n")).alias("laps")))
        each = each_of(lists.select("image", F.size("p").alias("n_p"), F.col("t.idx").alias("idx"), F.col("t.shape.n").alias("of"), F.explode_outer(own).alias("p")), "p")
        each = each.select("image", "n_p", "idx", "of", F.col("p.idx").alias("p_idx"), F.col("p.n").alias("n"), F.explode("p.laps").alias("z")).filter(F.col("z.at") >= F.col("n_p"))
        at, inter = F.col("z.at") - F.col("n_p"), F.col("z.n")
        return each.select("image", "p_idx", F.get("idx", at).alias("g_idx"), inter.alias("inter"), over_union(inter, F.col("n"), F.get("of", at)).alias("iou"))
    each = lists.select("image", F.explode("p").alias("p"), "t")
    over = F.filter(F.transform("t", lambda t: F.struct(t["idx"].alias("g_idx"), shared_(F.col("p.shape"), t["shape"]).alias("inter"), t["shape"]["n"].alias("of"))), lambda z: z["inter"] > 0)
    out = each.select("image", F.col("p.idx").alias("p_idx"), F.col("p.shape.n").alias("n"), F.explode(over).alias("z"))
    return out.select("image", "p_idx", "z.g_idx", "z.inter", over_union(F.col("z.inter"), F.col("n"), F.col("z.of")).alias("iou"))
