"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves, and each half has a codebook of its own, fitted by k-means on a bounded sample; the
pairs of centroids form a product grid, and a vector is stored in the cell of its two nearest. A vector visits cells
in the order of the multi-sequence traversal, that is, of growing sum of the two squared distances. How many it visits
is calibrated: partners at exactly the threshold, in random directions, are made for sampled vectors, and the number
of cells is the least that reaches ``RECALL`` of them. A link is found if either vector visits the other's cell, and
every candidate is verified by its cosine in double precision on the given vectors.

Only vectors of equal label and length meet; each length has codebooks of its own, whose size follows the number of its
vectors. A cell's vectors are cut into blocks of about ``BLOCK``, and so are its visitors; each pair of blocks is a
group of its own, so that a label or cell with a third of all rows is many bounded tasks. A group returns how many links
each vector has there and a spanning star of the links, not the pairs. A link that is found in both cells is counted
once: by the visit to the cell of the vector with the smaller vec_id if that visit is made, else by the other one. Vectors
travel in the precision in which they are given.

Nulls and odd rows: vectors that are null, empty or zero or hold null or non-finite components and those without a label
link with nothing and have a row of their own. Equal rows are one. A vec_id that has several vectors is one node, not linked to
itself, and links with whatever one of them links with; other vec_ids count it once. A null vec_id takes no part and gets a null
component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components, stars
from .store import cut, drawn
from .vectors import matrix, usable

THRESHOLD = 0.93
#: Target recall of the traversal; vectors that codebooks and traversal are fitted on, at most, about.
RECALL, SAMPLE = 0.995, 8192
#: Vectors in a cell, about; those in the sample for a centroid, at least; vectors of a length up to which all meet without an index (none).
CELL, SAMPLED, FEW = 64, 16, 0
#: Vectors of a block.
BLOCK = 2048


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = _squared(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class MultiIndex:
    """Two codebooks, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        unit = _unit(sample)
        self.half = (unit.shape[1] + 1) // 2
        self.books = [k_means(unit[:, : self.half], k), k_means(unit[:, self.half :], k) if unit.shape[1] > 1 else np.zeros((1, 0))]
        rng = np.random.default_rng(11)
        side = rng.normal(size=unit.shape)
        side -= (side * unit).sum(1, keepdims=True) * unit
        length = np.linalg.norm(side, axis=1, keepdims=True)
        partner = threshold * unit + np.sqrt(1 - threshold**2) * side / np.where(length > 0, length, 1)
        # a link is missed only if neither visits the other's cell
        a, b = self.rank(unit, self.cells(partner)), self.rank(partner, self.cells(unit))
        self.visits = int(np.quantile(np.minimum(a, b), recall, method="higher")) + 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = _squared(unit[:, : self.half], self.books[0]), _squared(unit[:, self.half :], self.books[1])
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def rank(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells come before that one in each vector's traversal: for each centroid of the first book, those of the second that stay under the
        cell's sum, counted in its order. Room and time are of a book, not of the grid."""
        a, b = _squared(unit[:, : self.half], self.books[0]), np.sort(_squared(unit[:, self.half :], self.books[1]), axis=1)
        own = np.arange(len(unit))
        second = _squared(unit[:, self.half :], self.books[1])[own, cell % len(self.books[1])]
        sums = a[own, cell // len(self.books[1])] + second
        return np.array([np.searchsorted(b[i], sums[i] - a[i], "left").sum() for i in own], dtype=np.int64)

    def traversal(self, unit: np.ndarray) -> np.ndarray:
        """[vector, place] the first ``visits`` cells. The grid is walked by rows of the first book in order of distance,
        of which only so many can hold one of the nearest cells."""
        a, b = _squared(unit[:, : self.half], self.books[0]), _squared(unit[:, self.half :], self.books[1])
        n = min(self.visits, a.shape[1] * b.shape[1])
        oa, ob = np.argsort(a, axis=1, kind="stable")[:, :n], np.argsort(b, axis=1, kind="stable")[:, :n]
        sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        # the cell at places (i, j) has (i + 1) * (j + 1) - 1 cells at least before it
        i, j = np.nonzero(np.outer(np.arange(1, sa.shape[1] + 1), np.arange(1, sb.shape[1] + 1)) <= n)
        sums = sa[:, i] + sb[:, j]
        first = np.argsort(sums, axis=1, kind="stable")[:, :n]
        ids = oa[:, i] * len(self.books[1]) + ob[:, j]
        return np.take_along_axis(ids, first, 1)


def fit(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> MultiIndex | None:
    """The index of vectors of one length. Its centroids grow with the root of the table, and the sample with them."""
    n = vectors.count()
    if not n:
        return None
    k = max(1, round((n / CELL) ** 0.5))
    wanted = max(sample, SAMPLED * k)
    some = drawn(vectors, wanted, n, "multi-index", "vec_id").select("vec_id", "v").toPandas().sort_values("vec_id")  # about so many rows
    x = np.array(some["v"].tolist() or vectors.select("v").first()[0], dtype=np.float64).reshape(max(len(some), 1), -1)
    return MultiIndex(x, k, threshold, recall)


PLACED = "label string, cell long, role int, vec_id long, v array<{}>, home long, again boolean"


def visits(vectors: DataFrame, index: MultiIndex | None) -> DataFrame:
    """vec_id, label, v, again -> label, cell, role (0: stored there, 1: visits), vec_id, v, home (the vector's own cell), again, for all it visits."""
    if index is None:  # few vectors: one cell
        return vectors.select("label", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("role"), "vec_id", "v", F.lit(0).cast("long").alias("home"), "again")
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def place(batches):
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                unit = _unit(matrix(part.column("v")))
                home = own.cells(unit)
                near = own.traversal(unit)
                for role, cells in ((0, home[:, None]), (1, near)):
                    rows, at = np.nonzero(cells != home[:, None]) if role else (np.arange(len(home)), np.zeros(len(home), dtype=int))
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken.column("label"), pa.array(cells[rows, at].astype(np.int64)), pa.array(np.full(len(rows), role, dtype=np.int32)), taken.column("vec_id"), taken.column("v"), pa.array(home[rows].astype(np.int64)), taken.column("again")], names=["label", "cell", "role", "vec_id", "v", "home", "again"])

    kind = vectors.schema["v"].dataType.elementType.simpleString()
    return vectors.select("vec_id", "label", "v", "again").mapInArrow(place, PLACED.format(kind))


GROUP = ("label", "cell", "block", "turn")


def _compare(batches, index: MultiIndex | None, threshold: float):
    """Rows sorted by group, the cell's own block first -> n (links of a vector here) and star (a, b) rows; links of vec_ids that have
    several vectors are rows of their own, with the other vec_id, so that they can be told apart."""

    def group(stored, visiting):
        ids, v, again = (np.concatenate([x[k] for x in stored]) for k in range(3))
        unit = _unit(v)
        out = []
        for qids, qv, qagain, qhome, own in visiting:
            i, j = np.nonzero(_unit(qv) @ unit.T >= threshold)  # lengths go first: products of long or short vectors leave the range of doubles
            if own:  # both stored in this cell: each pair from one side
                keep = qids[i] < ids[j]
            else:
                # the stored vector's visit to the visitor's cell finds the pair too: it counts if its vec_id is the larger
                keep = qids[i] != ids[j]
                if len(i):
                    js, inverse = np.unique(j, return_inverse=True)
                    walks = index.traversal(unit[js])
                    back = (walks[inverse] == qhome[i][:, None]).any(1)
                    keep &= ~back | (ids[j] < qids[i])
            out.append((qids[i[keep]], ids[j[keep]], qagain[i[keep]] | again[j[keep]]))
        a, b, several = (np.concatenate(x) for x in zip(*out))
        if not len(a):
            return None
        every, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = np.bincount(np.concatenate([place[: len(a)][~several], place[len(a) :][~several]]), minlength=len(every))
        root = stars(len(every), place[: len(a)], place[len(a) :])
        pairs = np.unique(np.stack([a[several], b[several]]), axis=1)
        ends = np.concatenate([pairs, pairs[::-1]], axis=1)
        none = pa.nulls(ends.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), y]) for x, y in ((every, pa.array(ends[0])), (n.astype(np.int64), none), (every[root], pa.array(ends[0])))] + [pa.concat_arrays([pa.nulls(len(every), pa.int64()), pa.array(ends[1])])], names=["vec_id", "n", "root", "other"])

    key, stored, visiting = None, [], []
    for batch in batches:
        columns = [batch.column(c).dictionary_encode().indices.to_numpy() if c == "label" else batch.column(c).to_numpy() for c in (*GROUP, "role")]
        edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if i == j:
                continue
            part = batch.slice(i, j - i)
            this = tuple(part.column(c)[0].as_py() for c in GROUP)
            if this != key:
                if stored and visiting and (found := group(stored, visiting)) is not None:
                    yield found
                key, stored, visiting = this, [], []
            ids, v, again = part.column("vec_id").to_numpy(), matrix(part.column("v")), part.column("again").to_numpy(zero_copy_only=False)
            if part.column("role")[0].as_py() == 0:
                stored.append((ids, v, again))
            else:
                visiting.append((ids, v, again, part.column("home").to_numpy(), bool(part.column("own")[0].as_py())))
    if stored and visiting and (found := group(stored, visiting)) is not None:
        yield found


def links(vectors: DataFrame, index: MultiIndex | None, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n, root, other of vectors of one length: rows whose n add up to a vector's links, or that name one, and a star that connects what is linked."""
    placed = cut(visits(vectors, index))
    sizes = placed.groupBy("label", "cell").agg(F.count_if(F.col("role") == 0).alias("stored"), F.count("*").alias("all")).filter("stored > 0 AND all > 1")
    sized = placed.join(sizes.withColumn("blocks", F.ceil(F.col("stored") / BLOCK).cast("int")).withColumn("turns", F.ceil(F.col("all") / BLOCK).cast("int")).drop("stored", "all"), ["label", "cell"])
    pick = lambda n: F.pmod(F.xxhash64("vec_id", "home"), F.col(n)).cast("int")
    # a stored vector is in one block, met by every turn; a visitor, and each stored vector as one, is in one turn, and meets every block
    stored = sized.filter("role = 0").withColumn("block", pick("blocks")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("own", F.lit(False))
    meeting = sized.withColumn("own", F.col("role") == 0).withColumn("turn", pick("turns")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.when(F.col("own"), 1).otherwise(2))
    rows = stored.unionByName(meeting).select(*GROUP, "role", "own", "vec_id", "v", "home", "again")
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "role").mapInArrow(lambda batches: _compare(batches, shared.value, threshold), "vec_id long, n long, root long, other long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, index: MultiIndex | None = None) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id, kept. An index that is given is of vectors of one length."""
    given = embeddings.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if given in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    vectors = rows.filter(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    vectors = cut(vectors.withColumn("n", F.size("v")).distinct())
    several = vectors.groupBy("vec_id").agg(F.count("*").alias("c")).filter("c > 1").select("vec_id", F.lit(True).alias("again"))
    vectors = vectors.join(several, "vec_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    ids, found = rows.select("vec_id"), None
    for r in vectors.groupBy("n").count().orderBy("n").collect():  # a row a length
        own = vectors.filter(F.col("n") == r["n"]).drop("n")
        more = links(own, index or (fit(own, threshold) if r["count"] > FEW else None), threshold)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found)
    told = found.filter("other IS NOT NULL").select("vec_id", "other").distinct().groupBy("vec_id").agg(F.count("*").alias("n"))
    n = found.filter("n IS NOT NULL").select("vec_id", "n").unionByName(told).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(found.filter("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))))
    known = cut(n.join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left"))
    out = ids.join(known, "vec_id", "left").withColumn("component_id", F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
