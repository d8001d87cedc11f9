"""Masks: rasters of polygons, run lengths and what is measured on them.

The kernels work on numpy arrays within one row or image, so a mask never leaves its task; the functions on columns
wrap them for Arrow batches.

A filled polygon holds the pixels inside by the even-odd rule and those of its boundary lines. A line steps along its longer
axis from its left end; of two pixels equally near to it, it takes the one on the side of that end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of them, how many of it came before), each as often as it counts."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _line_pixels(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, y of the pixels of the lines from p to q [n, (x, y)], ends included."""
    turned = (q[:, 0] < p[:, 0])[:, None]
    start, way = np.where(turned, q, p), np.where(turned, p - q, q - p)
    size = np.abs(way)
    long, short = size.max(1), size.min(1)
    of, k = _each(long + 1)
    over = -((long[of] - 2 * k * short[of]) // np.maximum(2 * long[of], 1))  # rounded, halves towards the start
    steep = (size[:, 1] > size[:, 0])[of]
    return start[of, 0] + np.where(steep, over, k), start[of, 1] + np.sign(way[of, 1]) * np.where(steep, k, over)


def filled(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """uint8 mask [height, width] of a polygon of whole pixel points [n, (x, y)]."""
    out = np.zeros((height, width + 1), dtype=np.int16)
    if not len(points):
        return out[:, :-1].astype(np.uint8)
    p = points.astype(np.int64)
    q = np.roll(p, -1, axis=0)
    if len(p) > 2:  # where each row crosses the edges, in pairs
        up = p[:, 1] != q[:, 1]
        a, b = p[up], q[up]
        of, k = _each(np.abs(b[:, 1] - a[:, 1]))
        row = np.minimum(a[:, 1], b[:, 1])[of] + k
        x = a[of, 0] + (row - a[of, 1]) * (b[of, 0] - a[of, 0]) / (b[of, 1] - a[of, 1])
        order = np.lexsort((x, row))
        row, first, last = row[order[::2]], np.maximum(np.ceil(x[order[::2]]), 0).astype(np.int64), np.minimum(np.floor(x[order[1::2]]), width - 1).astype(np.int64)
        ok = (row >= 0) & (row < height) & (first <= last)
        np.add.at(out, (row[ok], first[ok]), 1)
        np.add.at(out, (row[ok], last[ok] + 1), -1)
        np.cumsum(out, axis=1, out=out)
    x, y = _line_pixels(p, q)
    ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    out[y[ok], x[ok]] = 1
    return (out[:, :-1] > 0).astype(np.uint8)


def _line_spans(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, row, first, last) of the pixels of the lines from p to q [n, (x, y)]: what each has in a row is one run."""
    turned = (q[:, 0] < p[:, 0])[:, None]
    start, way = np.where(turned, q, p), np.where(turned, p - q, q - p)
    dx, dy = way[:, 0], np.abs(way[:, 1])
    of, r = _each(dy + 1)
    x, y = start[of, 0], start[of, 1] + np.sign(way[:, 1])[of] * r
    first = x
    steep = dy > dx
    one = np.flatnonzero((steep & (dx > 0))[of])  # of a steep line, its one pixel
    wide, high = dx[of[one]], dy[of[one]]
    first[one] -= (high - 2 * r[one] * wide) // (2 * high)
    last = first.copy()
    run = np.flatnonzero(~steep[of])
    wide, high, r = dx[of[run]], dy[of[run]], r[run]
    two = np.maximum(2 * high, 1)
    first[run] += np.where(high > 0, np.maximum((2 * r - 1) * wide // two + 1, 0), 0)
    last[run] += np.where(high > 0, np.minimum((2 * r + 1) * wide // two, wide), wide)
    return of, y, first, last


def filled_words(points: np.ndarray, counts: np.ndarray, word: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks of many polygons at once, of whole pixel points [n, (x, y)], end to end, ``counts`` of each -> boxes [m, (x0, y0, x1, y1)], where each one's words
    begin (and the last end), words and pixels of each. A polygon has the rows of its box, each of the words from x0 // word on; without points it has none."""
    m, p = len(counts), points.astype(np.int64)
    boxes = np.tile(np.array([0, 0, -1, -1]), (m, 1))
    some, ends = counts > 0, np.cumsum(counts)
    if not some.any():
        return boxes, np.zeros(m + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(m, dtype=np.int64)
    begins = (ends - counts)[some]
    boxes[some, :2], boxes[some, 2:] = np.minimum.reduceat(p, begins), np.maximum.reduceat(p, begins)
    across = np.where(some, boxes[:, 2] // word - boxes[:, 0] // word + 1, 0)
    starts = np.append(0, np.cumsum(across * (boxes[:, 3] - boxes[:, 1] + 1)))
    of = np.repeat(np.arange(m), counts)
    q = np.empty_like(p)
    q[:-1] = p[1:]
    q[ends[some] - 1] = p[begins]
    place = (starts[:-1] - boxes[:, 1] * across - boxes[:, 0] // word) * word  # the bit of (0, 0)
    line, row, first, last = _line_spans(p, q)
    bit = place[of[line]] + row * across[of[line]] * word
    low, high = [bit + first], [bit + last]
    up = (p[:, 1] != q[:, 1]) & (counts > 2)[of]  # where each row crosses the edges, in pairs
    a, b, own = p[up], q[up], of[up]
    e, k = _each(np.abs(b[:, 1] - a[:, 1]))
    row = np.minimum(a[:, 1], b[:, 1])[e] + k
    x = a[e, 0] + (row - a[e, 1]) * (b[e, 0] - a[e, 0]) / (b[e, 1] - a[e, 1])
    bit = place[own[e]] + row * across[own[e]] * word
    order = np.argsort(bit + x, kind="stable")  # by row, then x, which is less than a row
    bit, x = bit[order], x[order]
    first, last = bit[::2] + np.ceil(x[::2]).astype(np.int64), bit[::2] + np.floor(x[1::2]).astype(np.int64)
    ok = first <= last
    low.append(first[ok])
    high.append(last[ok])
    n = int(starts[-1]) * word
    change = np.zeros(n + 1, dtype=np.int16 if len(points) < 1 << 14 else np.int32)  # no pixel is in more runs than there are points, twice
    np.add.at(change, np.concatenate(low), change.dtype.type(1))
    np.subtract.at(change, np.concatenate(high) + 1, change.dtype.type(1))
    np.cumsum(change, out=change)
    words = np.packbits(change[:n] > 0, bitorder="little").view("<i8")
    total = np.append(0, np.cumsum(np.bitwise_count(words.view(np.uint64)), dtype=np.int64))
    return boxes, starts, words, total[starts[1:]] - total[starts[:-1]]


def all_convex(points: np.ndarray, counts: np.ndarray) -> bool:
    """Whether all polygons of whole pixel points are convex: they turn one way, and go once up and down, left and right. Points on a side don't matter."""
    m = len(counts)
    of = np.repeat(np.arange(m), counts)
    p, q = points.astype(np.int64), _following(points, counts)
    some = (p != q).any(1)
    p, of = p[some], of[some]  # of points in one place the last; of a polygon in one place none
    counts = np.bincount(of, minlength=m)
    way = _following(p, counts) - p
    next_ = _following(way, counts)
    turn = np.sign(way[:, 0] * next_[:, 1] - way[:, 1] * next_[:, 0])
    begins = (np.cumsum(counts) - counts)[counts > 0]
    if not len(begins):
        return True
    one_way = (np.maximum.reduceat(turn, begins) - np.minimum.reduceat(turn, begins)) < 2
    once = np.add.reduceat(np.abs(way), begins) == 2 * (np.maximum.reduceat(p, begins) - np.minimum.reduceat(p, begins))
    return bool(one_way.all() and once.all())


def _following(points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The next point of each point's polygon, as whole numbers."""
    q = np.empty((len(points), 2), dtype=np.int64)
    q[:-1] = points[1:]
    some, ends = counts > 0, np.cumsum(counts)
    q[ends[some] - 1] = points[(ends - counts)[some]]
    return q


def convex_rows(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As filled_words(), of convex polygons, whose pixels in a row are one run: boxes, where each one's rows begin (and the last end), first and last pixel
    of each row, pixels of each polygon. The runs lie between its lines."""
    m, p = len(counts), points.astype(np.int64)
    boxes = np.tile(np.array([0, 0, -1, -1]), (m, 1))
    some = counts > 0
    if not some.any():
        return boxes, np.zeros(m + 1, dtype=np.int64), *(np.zeros(0, dtype=np.int64),) * 2, np.zeros(m, dtype=np.int64)
    q = _following(p, counts)
    begins = (np.cumsum(counts) - counts)[some]
    boxes[some, :2], boxes[some, 2:] = np.minimum.reduceat(p, begins), np.maximum.reduceat(p, begins)
    starts = np.append(0, np.cumsum(boxes[:, 3] - boxes[:, 1] + 1))
    of = np.repeat(np.arange(m), counts)
    line, row, first, last = _line_spans(p, q)
    at = (starts[:-1] - boxes[:, 1])[of][line] + row
    low, high = np.full(starts[-1], np.iinfo(np.int64).max), np.full(starts[-1], -1)
    np.minimum.at(low, at, first)
    np.maximum.at(high, at, last)
    total = np.append(0, np.cumsum(high - low + 1))
    return boxes, starts, low, high, total[starts[1:]] - total[starts[:-1]]


def raster(points: np.ndarray, size: int) -> np.ndarray:
    """Mask of normalized float32 points on size x size."""
    return filled(np.rint(points.astype(np.float32) * (size - 1)), size, size)


def native(points: np.ndarray, height: int, width: int, value: int = 1) -> np.ndarray:
    """Mask at the image's size, with the given foreground value."""
    return filled(np.rint(points.astype(np.float32) * np.array([width - 1, height - 1], dtype=np.float32)), height, width) * np.uint8(value)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    x, y = int((a > 0).sum()), int((b > 0).sum())
    if not x or not y:
        return 0.0
    both = int(((a > 0) & (b > 0)).sum())
    return both / (x + y - both)


def iou_matrix(a: list[np.ndarray], b: list[np.ndarray], boxes_a=None, boxes_b=None) -> np.ndarray:
    """All pairs by one product of bit rows; with boxes, pairs whose boxes are apart count 0."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    x, y = (np.stack([(m > 0).ravel() for m in s]).astype(np.float32) for s in (a, b))
    both = (x @ y.T).astype(np.float64)
    union = x.sum(1, dtype=np.float64)[:, None] + y.sum(1, dtype=np.float64)[None] - both
    out = np.divide(both, union, out=np.zeros_like(both), where=(union > 0) & (both > 0))
    if boxes_a is not None:
        p, q = np.asarray(boxes_a)[:, None], np.asarray(boxes_b)[None]
        out[(p[..., 0] > q[..., 2]) | (q[..., 0] > p[..., 2]) | (p[..., 1] > q[..., 3]) | (q[..., 1] > p[..., 3])] = 0
    return out


def run_lengths(mask: np.ndarray) -> np.ndarray:
    """Lengths of runs by columns, the first of zeros."""
    flat = (mask > 0).ravel(order="F")
    at = np.flatnonzero(np.diff(flat, prepend=False)) if len(flat) else np.zeros(0, dtype=int)
    return np.diff(np.concatenate([[0], at, [len(flat)]]))


def from_run_lengths(counts: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.repeat(np.arange(len(counts)) % 2, counts).reshape((height, width), order="F").astype(np.uint8)


def run_area(counts: np.ndarray) -> int:
    return int(np.asarray(counts)[1::2].sum())


def run_box(counts: np.ndarray, height: int, width: int) -> tuple[int, int, int, int]:
    """x, y, width, height; zeros if empty."""
    y, x = np.nonzero(from_run_lengths(counts, height, width))
    return (int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)) if len(x) else (0, 0, 0, 0)


def mask_signature(mask: np.ndarray) -> str:
    """SHA-256 of HxW, NUL and the run lengths."""
    import hashlib

    h, w = mask.shape
    return hashlib.sha256(f"{h}x{w}\0".encode() + ",".join(map(str, run_lengths(mask).tolist())).encode()).hexdigest()


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in the order of their first pixel; runs of rows are joined."""
    h, w = mask.shape
    parent: list[int] = [0]

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, above = np.zeros((h, w), dtype=np.int64), []
    for r in range(h):
        edge = np.flatnonzero(np.diff((mask[r] > 0).astype(np.int8), prepend=0, append=0))
        here = []
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            own = None
            for a, b, k in above:
                if a <= j and b >= i:  # runs end before b and j, so touching corners count
                    k = find(k)
                    if own is None:
                        own = k
                    elif k != own:
                        parent[max(k, own)] = min(k, own)
                        own = min(k, own)
            if own is None:
                own = len(parent)
                parent.append(own)
            out[r, i:j] = own
            here.append((i, j, own))
        above = here
    root = np.array([find(i) for i in range(len(parent))])
    _, place = np.unique(root, return_inverse=True)
    return place[out]


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The mask with only its largest component, the first of equals."""
    parts = labelled(mask)
    n = np.bincount(parts.ravel())[1:]
    return mask if len(n) < 2 else np.where(parts == int(n.argmax()) + 1, mask, 0).astype(mask.dtype)


def inner_distance(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel inside to the nearest outside, by two chamfer passes with steps 1 and the root of 2."""
    h, w = mask.shape
    d = np.zeros((h + 2, w + 2))
    d[1:-1, 1:-1] = np.where(mask > 0, np.inf, 0.0)
    diagonal = np.sqrt(2)
    for r in range(1, h + 1):
        row = np.minimum(d[r], np.minimum(d[r - 1] + 1, np.minimum(np.roll(d[r - 1], 1), np.roll(d[r - 1], -1)) + diagonal))
        d[r, 1:-1] = (np.minimum.accumulate(row - np.arange(w + 2)) + np.arange(w + 2))[1:-1]
    for r in range(h, 0, -1):
        row = np.minimum(d[r], np.minimum(d[r + 1] + 1, np.minimum(np.roll(d[r + 1], 1), np.roll(d[r + 1], -1)) + diagonal))
        back = row[::-1]
        d[r, 1:-1] = (np.minimum.accumulate(back - np.arange(w + 2)) + np.arange(w + 2))[::-1][1:-1]
    return d[1:-1, 1:-1]


def mask_geometry(mask: np.ndarray) -> dict | None:
    """Box, centroid, deepest point and its clearance, components and holes; None for an empty mask."""
    y, x = np.nonzero(mask)
    if not len(x):
        return None
    depth = inner_distance(mask)
    deep = np.unravel_index(int(depth.argmax()), depth.shape)
    outside = labelled(np.pad(mask == 0, 1, constant_values=True).astype(np.uint8))
    return {
        "x0": int(x.min()), "y0": int(y.min()), "x1": int(x.max()), "y1": int(y.max()), "area": len(x),
        "cx": float(x.mean()), "cy": float(y.mean()), "px": int(deep[1]), "py": int(deep[0]), "clearance": float(depth[deep]),
        "components": int(labelled(mask).max()), "holes": int(outside.max()) - 1,
    }


def moments_centroid(probability: np.ndarray, threshold: float = 0.5) -> tuple[float, float] | None:
    y, x = np.nonzero(probability > threshold)
    return (float(x.mean()), float(y.mean())) if len(x) else None


def crop_overlap(crop: tuple[int, int, int, int], width: int, height: int, others: list[np.ndarray], size: int) -> float:
    """The largest share of a crop (pixels of the image) that one of the masks of size x size covers; 1 if the crop is empty there."""
    x0, y0, x1, y1 = (int(np.rint(v / n * size)) for v, n in zip(crop, (width, height, width, height)))
    own = (max(x1, 0) - max(x0, 0)) * (max(y1, 0) - max(y0, 0))
    if own <= 0:
        return 1.0
    return max((float((m[max(y0, 0) : y1, max(x0, 0) : x1] > 0).sum()) / own for m in others), default=0.0)


def d4(image: np.ndarray) -> list[np.ndarray]:
    """Each of four turns, as it is and mirrored, in the order of text.D4."""
    return [v for k in range(4) for v in (np.rot90(image, k), np.fliplr(np.rot90(image, k)))]


def unit(v: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    v = v.astype(np.float64).ravel()
    v = v - v.mean()
    n = np.linalg.norm(v)
    return v / n if n > eps else np.zeros_like(v)


def ssim(a: np.ndarray, b: np.ndarray, span: float = 255.0, window: int = 7) -> float:
    """Mean structural similarity with a uniform window and sample covariances. The means of windows are differences of running sums, exact for whole numbers."""

    def means(v: np.ndarray) -> np.ndarray:
        sums = np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (sums[window:, window:] - sums[:-window, window:] - sums[window:, :-window] + sums[:-window, :-window]) / n

    x, y = a.astype(np.float64), b.astype(np.float64)
    n = window * window
    mx, my = means(x), means(y)
    scale = n / (n - 1)
    vx, vy = scale * (means(x * x) - mx * mx), scale * (means(y * y) - my * my)
    both = scale * (means(x * y) - mx * my)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * both + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def colour_stats(image: np.ndarray, mask: np.ndarray) -> dict:
    """Means and deviations of RGB and HSV under a mask, and the shares of green, dark and bright pixels."""
    rgb = image[mask > 0].astype(np.float64) / 255
    if not len(rgb):
        return {}
    top, low = rgb.max(1), rgb.min(1)
    span = top - low
    r, g, b = rgb.T
    safe = np.where(span > 0, span, 1)
    hue = np.where(span == 0, 0, np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))) / 6
    saturation = np.where(top > 0, span / np.where(top > 0, top, 1), 0)
    out = {}
    for name, v in (("r", r), ("g", g), ("b", b), ("h", hue), ("s", saturation), ("v", top)):
        out |= {f"{name}_mean": float(v.mean()), f"{name}_std": float(v.std())}
    return out | {"green": float(((g > r) & (g > b)).mean()), "dark": float((top < 0.2).mean()), "bright": float((top > 0.85).mean())}


def _points(rows) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in rows], dtype=np.float32).reshape(-1, 2)


def raster_area(polygon: Column, size: int = 768) -> Column:
    """Pixels of the polygon's raster, over size squared."""

    @F.pandas_udf(DoubleType())
    def area(polygons: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in polygons:
            yield pd.Series([None if p is None else float(raster(_points(p), size).sum()) / size**2 for p in batch], dtype=float)

    return area(polygon)
