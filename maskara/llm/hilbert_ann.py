"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is projected at random to ``DIMS`` dimensions, several times over, shifted and put on a Hilbert curve. A
Spark range partitioning orders each curve's keys; a row's rank on the curve is its place in that order. A query's
window is the rows within so many ranks of it on each curve; the windows' rows are merged and ranked by Euclidean
distance in double precision on the original vectors.

The window is calibrated: for a bounded, documented sample of queries the true neighbours are found by brute force (the
sample against all rows, in blocks), and the window is the least in which ``RECALL`` of them are within it on some
curve. Where vectors have little structure it grows to much of the table, and the search is then no cheaper than brute
force, but it keeps its recall.

A curve is cut into blocks of ``BLOCK`` ranks; a query is sent to the blocks its window overlaps, each of which is a
group of bounded size. Vectors that are equal are searched as one, with as many of their smallest vec_ids as a
result can need. Vectors travel in the precision in which they are given, and nothing is told apart by a hash.

Nulls and odd rows: vectors that are null, empty or zero or hold null or non-finite components and rows without a vec_id take
no part. Vectors of different lengths have no distance: each length is searched by itself. Rows that repeat a vec_id with the
same vector are one; with different vectors the vec_id is both query and candidate with each and stands once in a result, with
its nearest, and results are full all the same. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import cut, drawn
from .vectors import matrix, usable

#: Neighbours of a query; curves; dimensions and bits of each that a key is made of (DIMS * BITS bits in all).
K, CURVES, DIMS, BITS = 10, 4, 4, 12
#: Share of the sampled queries' neighbours that the windows must hold, and queries sampled, about.
RECALL, SAMPLE = 0.97, 128
#: Ranks of a block of a curve; queries of a group.
BLOCK, QUERIES = 1024, 512
#: vec_ids with several vectors up to which they are sent to the tasks.
SEVERAL = 100_000
#: A vector is a query if its vec_id is divisible by this.
EVERY = 100


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points [point, dimension] of so many bits, by the transposed Gray code."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo excess work
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            has = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            first = np.where(has, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(has, x[i], x[i] ^ swap)
            x[0] = first
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[-1] & np.uint64(1 << b)) > 0, t ^ np.uint64((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Projections, scales and shifts; the same for the same width and seed."""

    def __init__(self, width: int, low: np.ndarray, high: np.ndarray, seed: int = 3):
        self.rng_seed, self.width = seed, width
        self.low, self.high = low, high

    @staticmethod
    def projections(width: int, seed: int = 3) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return rng.normal(size=(CURVES, width, DIMS)) / np.sqrt(max(width, 1))

    def keys(self, v: np.ndarray) -> np.ndarray:
        """[vector, curve]."""
        rng = np.random.default_rng(self.rng_seed + 1)
        shift = rng.random((CURVES, DIMS)) * 0.5
        out = np.zeros((len(v), CURVES), dtype=np.int64)
        for c, p in enumerate(self.projections(self.width, self.rng_seed)):
            span = np.where(self.high[c] > self.low[c], self.high[c] - self.low[c], 1)
            place = (np.clip((v @ p - self.low[c]) / span, 0, 1) + shift[c]) / 1.5
            out[:, c] = hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
        return out


def _curves(points: DataFrame, width: int) -> Curves:
    """With the ranges of the projections, the only thing that is learned from all rows: a few numbers a partition."""

    def ranges(batches):
        p = Curves.projections(width)
        low, high = np.full((CURVES, DIMS), np.inf), np.full((CURVES, DIMS), -np.inf)
        for batch in batches:
            v = matrix(batch.column("v"))
            if len(v):
                for c in range(CURVES):
                    x = v @ p[c]
                    low[c], high[c] = np.minimum(low[c], x.min(0)), np.maximum(high[c], x.max(0))
        i, j = np.indices((CURVES, DIMS))
        yield pa.RecordBatch.from_pydict({"c": i.ravel().astype(np.int32), "d": j.ravel().astype(np.int32), "low": low.ravel(), "high": high.ravel()})

    got = points.select("v").mapInArrow(ranges, "c int, d int, low double, high double").groupBy("c", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("c", "d").toPandas()
    return Curves(width, got["low"].to_numpy().reshape(CURVES, DIMS), got["high"].to_numpy().reshape(CURVES, DIMS))


def _vector(points: DataFrame) -> str:
    return f"v {points.schema['v'].dataType.simpleString()}"


def ranked(points: DataFrame, width: int) -> DataFrame:
    """point, ids, v -> the same for each curve, with rank: the place in the order of all curves' keys, one curve after another."""
    shared = points.sparkSession.sparkContext.broadcast(_curves(points, width))

    def keyed(batches):
        for batch in batches:
            keys = shared.value.keys(matrix(batch.column("v")))
            n = batch.num_rows
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, dtype=np.int32)), pa.array(keys[:, c]), *(batch.column(x) for x in ("point", "ids", "v"))], names=["curve", "key", "point", "ids", "v"])

    rows = points.select("point", "ids", "v").mapInArrow(keyed, f"curve int, key long, point long, ids array<long>, {_vector(points)}")
    ordered = cut(cut(rows).repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point").withColumn("at", F.monotonically_increasing_id()))
    here, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(ordered.groupBy(here.alias("p")).count().collect())  # a row a partition
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    starts = points.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "p long, before long")
    return ordered.withColumn("p", here).withColumn("inside", inside).join(F.broadcast(starts), "p").select("curve", "point", "ids", "v", (F.col("before") + F.col("inside")).alias("rank"))


def _distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[query, point] Euclidean distances from differences, in double precision."""
    return np.vstack([np.sqrt(((x[None, :] - v) ** 2).sum(1)) for x in q]) if len(q) else np.zeros((0, len(v)))


def _nearest(v: np.ndarray, q: np.ndarray, k: int, ids: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, distance) of each query's k nearest points, with all ties at the end.

    With ids (those of each point, of which some stand at several points) so many that k different ones are among them.
    """
    d = _distances(v, q)
    if d.shape[1] <= k:
        i, j = np.nonzero(np.ones_like(d, dtype=bool))
        return i, j, d[i, j]
    if ids is None:
        last = np.partition(d, k - 1, axis=1)[:, k - 1]
    else:
        last = np.zeros(len(d))
        for row, order in enumerate(np.argsort(d, axis=1, kind="stable")):
            seen: set = set()
            for at in order.tolist():
                seen.update(ids[at])
                last[row] = d[row, at]
                if len(seen) >= k:
                    break
    i, j = np.nonzero(d <= last[:, None])
    return i, j, d[i, j]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """query, ids, score, many times over -> query, vec_id, score of the k + 1 nearest vec_ids of each query."""
    once = found.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")


def _nearest_points(found: DataFrame, k: int) -> DataFrame:
    """query, point, score -> the k + 1 nearest points of each query."""
    order = Window.partitionBy("query").orderBy("score", "point")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")


def brute_force(points: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k nearest points of a bounded list of queries, which goes to all rows in blocks."""
    shared = points.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], dtype=np.int64), np.array([v for _, v in queries], dtype=np.float64)))

    def scan(batches):
        ids, q = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                a, b, d = _nearest(matrix(part.column("v")), q, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), part.column("point").take(pa.array(b)), pa.array(d)], names=["query", "point", "score"])

    return _nearest_points(points.select("point", "v").mapInArrow(scan, "query long, point long, score double"), k)


def window(points: DataFrame, order: DataFrame, k: int, recall: float, sample: int) -> int:
    """The least number of ranks on each side that holds ``recall`` of the sampled queries' k nearest on some curve."""
    n = points.count()
    some = drawn(points, sample, n, "hilbert", "point").select("point", "v").limit(4 * sample).collect()  # about SAMPLE rows
    if not some:
        return 0
    near = brute_force(points, [(r["point"], r["v"]) for r in some], k).filter("query <> point").select("query", "point").collect()  # SAMPLE * K rows
    wanted = points.sparkSession.createDataFrame([(x,) for x in {r["point"] for r in some} | {r["point"] for r in near}], "point long")
    rank: dict = {}
    for r in order.select("curve", "point", "rank").join(F.broadcast(wanted), "point").collect():  # as many, times CURVES
        rank.setdefault(r["point"], {})[r["curve"]] = r["rank"]
    gaps = [min(abs(rank[r["query"]][c] - rank[r["point"]][c]) for c in range(CURVES)) for r in near]
    return int(np.quantile(gaps, recall, method="higher")) if gaps else 0


def search(embeddings: DataFrame, every: int = EVERY, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score of the queries' k nearest."""
    given = embeddings.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if given in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("n", F.size("v")).distinct()
    out = None
    for length in sorted(r["n"] for r in rows.select("n").distinct().collect()):  # a row a length
        pairs = _search(rows.filter(F.col("n") == length).drop("n"), length, every, k, recall, sample)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, width: int, every: int, k: int, recall: float, sample: int) -> DataFrame:
    """Distinct vec_id, v of one length -> query_id, vec_id, score: the k nearest of each query, or more."""
    # equal vectors are one point: its k + 1 smallest ids are all that a result can need, its queries are kept apart
    order = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    points = cut(firsts.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.monotonically_increasing_id()))
    several = {r["vec_id"] for r in rows.groupBy("vec_id").count().filter("count > 1").limit(SEVERAL + 1).select("vec_id").collect()}
    # ids with several vectors: of few it is known which; if they are many, all are taken to be such
    shared = rows.sparkSession.sparkContext.broadcast(None if len(several) > SEVERAL else several)
    n = points.count()
    placed = cut(ranked(points, width).withColumn("rank", F.col("rank") - F.col("curve") * n))  # every curve holds every point once
    reach = max(window(points, placed, k, recall, sample), 2 * (k + 1))  # no fewer, so that a result is full
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).join(points.select("v", "point"), "v").select("vec_id", "point")
    asked = cut(asked)
    sites = placed.join(asked.select("point").distinct(), "point", "left_semi").select("curve", F.col("point").alias("query"), F.col("v").alias("q"), F.explode(F.sequence(F.floor((F.greatest(F.col("rank") - reach, F.lit(0))) / BLOCK), F.floor(F.least(F.col("rank") + reach, F.lit(n - 1)) / BLOCK))).alias("block"))
    named = F.shiftleft(F.col("curve").cast("long"), 40) + F.col("block")  # a block holds a point once
    sites = sites.select("query", "q", named.alias("block"))
    per_block = placed.select("point", "ids", "v", "curve", F.floor(F.col("rank") / BLOCK).alias("block")).select("point", "ids", "v", named.alias("block"))
    # a block met by many queries is met in turns of about QUERIES, each a group of its own
    turns = sites.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    left = per_block.join(turns, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("role"), "point", "ids", "v")
    right = sites.join(turns, "block").select("block", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int").alias("turn"), F.lit(1).alias("role"), F.col("query").alias("point"), F.lit(None).cast("array<long>").alias("ids"), F.col("q").alias("v"))
    many = shared
    both = left.unionByName(right).repartition("block", "turn").sortWithinPartitions("block", "turn", "role")

    def compare(batches):
        key, stored = None, []
        points_ = v = ids = None
        for batch in batches:
            marks = batch.column("block").to_numpy() * 65_537 + batch.column("turn").to_numpy()
            roles = batch.column("role").to_numpy()
            edges = np.flatnonzero((np.diff(marks) != 0) | (np.diff(roles) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(marks)]):
                if i == j:
                    continue
                if marks[i] != key:
                    key, stored, v = marks[i], [], None
                part = batch.slice(i, j - i)
                if roles[i] == 0:
                    stored.append(part)
                    v = None
                    continue
                if not stored:
                    continue
                if v is None:
                    points_ = pa.Table.from_batches(stored)
                    v = matrix(points_.column("v"))
                    ids = points_.column("ids").to_pylist() if many.value is None or many.value else None
                    if ids and many.value is not None and not any(x in many.value for own in ids for x in own):
                        ids = None
                a, b, d = _nearest(v, matrix(part.column("v")), k + 1, ids)
                own = points_.select(["ids"]).take(pa.array(b)).combine_chunks()
                if len(a):
                    yield pa.RecordBatch.from_arrays([part.column("point").take(pa.array(a)), own.column("ids").combine_chunks(), pa.array(d)], names=["query", "ids", "score"])

    found = _merged(both.mapInArrow(compare, "query long, ids array<long>, score double"), k)
    # a query's own vec_id is left out
    return found.join(asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query")), "query").filter("vec_id <> query_id").select("query_id", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
