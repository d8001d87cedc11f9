"""SimHash near-duplicates found in BK-trees.

A fingerprint is 64 bits: texts in ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words joined by
a space (fewer words: the whole sequence), XXH64 with seed 42 of each shingle, repeats included; a bit is 1 if more
than half of the hashes have it. No words: fingerprint zero, linked like any other. Fingerprints link at ``RADIUS``
or fewer differing bits; components are over fingerprints.

Distinct fingerprints are put into shards. Cut into RADIUS + 1 blocks of bits, two fingerprints within the radius
agree on a whole block, so each fingerprint enters one shard per block, keyed by the block's bits. A shard is a
BK-tree: each node's children are keyed by their integer Hamming distance to it, and a search follows the edges
whose key is within the radius of the distance to the query. A shard of over ``SHARD`` fingerprints is cut into
trees of about that many, and the shard's fingerprints visit each of its trees. The trees reach only the tasks
that hold their queries: sent to every task, they would grow with the corpus. A task returns a spanning star of
the links it finds, so that a dense group of n costs n rows, not n * n.

Nulls and odd rows: null and blank texts have fingerprint zero; a null doc_id counts as the largest, and a component
of none but nulls has a null component_id. Repeated rows share a component. An empty table gives an empty result.
Further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from .graph import components, stars
from .store import bounded_batches, cut, one_row_each, small
from .units import tidy

RADIUS = 2
WORDS = 3
SEED = 42
#: Fingerprints in one tree, about.
SHARD = 4096
#: Hashes summed at a time, and pairs of a query and a node held at a time.
HASHES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 21
#: Rows up to which the tables of fingerprints and of documents that stay are broadcast (16 bytes a row).
BROADCAST_ROWS = 500_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[i : i + HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


@F.arrow_udf(LongType())
@tidy
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64).view(np.int64))


class Tree:
    """A BK-tree over distinct fingerprints, held by level: parent, edge (distance to the parent), values."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.parent, self.edge, self.depth = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # all values still to be placed stand below some node; the first of each distance becomes its child
        under, rest = np.zeros(n - 1, dtype=np.int64), np.arange(1, n)
        level = 0
        while len(rest):
            level += 1
            d = np.bitwise_count(values[rest] ^ values[under]).astype(np.int64)
            _, first, which = np.unique(under * 65 + d, return_index=True, return_inverse=True)
            heads = rest[first]
            self.parent[heads], self.edge[heads], self.depth[heads] = under[first], d[first], level
            below = np.ones(len(rest), dtype=bool)
            below[first] = False
            under, rest = heads[which[below]], rest[below]
        order = np.argsort(self.parent, kind="stable")
        self.children = order
        self.starts = np.searchsorted(self.parent[order], np.arange(n))
        self.counts = np.searchsorted(self.parent[order], np.arange(n), side="right") - self.starts

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node index) at most radius apart; only edges within the radius are followed."""
        todo = [(np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64))]
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS_AT_ONCE:
                todo += [(q[PAIRS_AT_ONCE:], node[PAIRS_AT_ONCE:])]
                q, node = q[:PAIRS_AT_ONCE], node[:PAIRS_AT_ONCE]
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            n = self.counts[node]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            child = self.children[np.repeat(self.starts[node], n) + at]
            ahead = np.abs(self.edge[child] - np.repeat(d, n)) <= radius
            if ahead.any():
                todo.append((np.repeat(q, n)[ahead], child[ahead]))


def block_keys(fp: str, radius: int) -> list:
    """The bits of each of radius + 1 blocks, and the block's number."""
    ends = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [F.struct(F.lit(i).alias("block"), F.shiftright(F.shiftleft(F.col(fp), 64 - b), 64 - (b - a)).alias("bits")) for i, (a, b) in enumerate(zip(ends, ends[1:]))]


@tidy
def _search(batches, radius: int):
    """Rows sorted by shard (block, bits, tree), the tree's own rows first -> the star of the links in each tree."""

    def star(tree_fps, query_fps):
        values = np.unique(np.array(tree_fps, dtype=np.int64).view(np.uint64))
        own = np.array(tree_fps + query_fps, dtype=np.int64).view(np.uint64)
        every = np.unique(own)
        place = np.searchsorted(every, values)
        root = np.arange(len(every))
        tree = Tree(values)
        for i in range(0, len(every), 1 << 15):
            for q, node in tree.within(every[i : i + (1 << 15)], radius):
                new = stars(len(every), np.concatenate([np.arange(len(every)), q + i]), np.concatenate([root, place[node]]))
                root = new
        linked = np.flatnonzero(root != np.arange(len(every)))
        return every[linked].view(np.int64), every[root[linked]].view(np.int64)

    def out(a, b):
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    key, tree_fps, query_fps = None, [], []
    done_a, done_b = [], []
    for batch in batches:
        for k, role, fp in zip(batch.column("shard").to_pylist(), batch.column("role").to_pylist(), batch.column("fp").to_pylist()):
            if k != key:
                if len(tree_fps) + len(query_fps) > 1:
                    a, b = star(tree_fps, query_fps)
                    done_a.append(a), done_b.append(b)
                key, tree_fps, query_fps = k, [], []
                if len(done_a) > 1000:
                    yield out(np.concatenate(done_a), np.concatenate(done_b))
                    done_a, done_b = [], []
            (query_fps if role else tree_fps).append(fp)
            if len(query_fps) >= SHARD:  # a large shard's queries come past its tree in blocks
                a, b = star(tree_fps, query_fps)
                done_a.append(a), done_b.append(b)
                query_fps = []
    if len(tree_fps) + len(query_fps) > 1:
        a, b = star(tree_fps, query_fps)
        done_a.append(a), done_b.append(b)
    if done_a:
        yield out(np.concatenate(done_a), np.concatenate(done_b))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), enough of them to connect whatever is within the radius."""
    keyed = fps.select("fp", F.explode(F.array(*block_keys("fp", radius))).alias("key")).select("fp", "key.block", "key.bits")
    sizes = keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["block", "bits"]).withColumn("trees", F.ceil(F.col("n") / SHARD).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # a query visits the trees of its shard up to its own: of two trees, the later one's rows search the earlier
    visits = keyed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
    rows = visits.select(F.xxhash64("block", "bits", "tree").alias("shard"), (F.col("tree") != F.col("own")).cast("int").alias("role"), "fp")
    # with a count, so that partitions of few bytes and much work are not put together
    return rows.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "role").mapInArrow(lambda batches: _search(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: a row per row of docs, without the text."""
    bounded_batches(docs.sparkSession)
    marked = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    return marked.join(small(cut(by_fingerprint(marked, radius)), BROADCAST_ROWS), "fp")


def by_fingerprint(marked: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp -> fp, component_id."""
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut(components(links(fps, radius)))
    linked = fps.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(linked.join(least, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp", "left").select("fp", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, columns as given: that with the smallest doc_id, a null one being the largest.

    Of rows that share that doc_id in a component, the one with the least fingerprint stays, and of equal ones any, the same in every run.
    """
    bounded_batches(docs.sparkSession)
    marked = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("mark")))
    fps = cut(marked.select(F.col("mark").alias("fp")).distinct())
    found = cut(components(links(fps, radius))).withColumnRenamed("node", "mark")
    rooted = marked.join(small(found, BROADCAST_ROWS), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("k")).select("k.doc_id", "k.mark")
    return one_row_each(docs, marked, cut(kept), lambda df, at: df.withColumn(at, fingerprints(F.col("text"))), BROADCAST_ROWS)


def op6(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
