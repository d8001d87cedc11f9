"""Near-duplicates by the Jaccard similarity of word shingles: the pipeline's near-dedup, by SimHash and a check of the sets.

Texts in ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``, the set of hashes of ``WORDS`` words in a row (fewer words: the
whole sequence; none: the empty set). Texts link at a similarity of ``LEAST`` or more, and components are over distinct sets.

A set has a SimHash fingerprint of 64 bits. Candidates are pairs within ``simhash.RADIUS`` bits, found in its BK-trees, and, as
pairs at 0.8 differ in about 10 bits, which no tree search holds, also sets that agree in a band: hashes are dealt by their
first bits to ``BANDS`` x ``ROWS`` bins (an empty one stands for the next that is not), and a band is the least hashes of ROWS bins.
Two sets at 0.8 agree in none with a probability of (1 - 0.8 ** ROWS) ** BANDS, about 1e-6, and a passage that fills a tenth of two
texts makes them agree in a band with one of 1e-4. Candidates of over ``SURE`` shingles that differ in more than ``FAR``
bits are not similar (pairs at 0.8 differ in so many with a probability of about 1e-6); all others are compared as sets.

The sets that share a band are compared in rounds: with the least one of the group, then with members of its component,
and in the end whatever pairs are not in one component yet, so a dense group costs its rows, not their square.

Nulls and odd rows: null and blank texts are one group; a null doc_id counts as the largest. An empty table gives an
empty result. Further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .graph import components
from .simhash import links
from .store import bounded_batches, cut, free, one_row_each, small
from .units import tidy

WORDS = 5
LEAST = 0.8
SEED = 42
#: Bands, and bins in each; least shingles of sets that are told apart by their bits, and the bits.
BANDS, ROWS, SURE, FAR = 26, 4, 32, 24
#: Rounds in which a group's sets are compared with one of them.
ROUNDS = 2
#: Bytes up to which the sets that others are compared with are broadcast.
BROADCAST_BYTES = 32 << 20
KEPT_WORDS = 200_000
#: Rows up to which tables of bands that sets share, and of documents compared or kept, are broadcast (16 bytes a row).
BROADCAST_ROWS = 500_000
SETS = StructType().add("sig", LongType()).add("n", LongType()).add("fp", LongType()).add("hashes", ArrayType(LongType(), False))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.int64)
    w = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def bands(s: np.ndarray) -> np.ndarray:
    """The hash of each band of a set."""
    if not len(s):
        return np.zeros(BANDS, dtype=np.int64)
    x = s.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = np.sort(x * np.uint64(0xD6E8FEB86659FD93))
    bins = BANDS * ROWS
    edges = np.arange(1, bins, dtype=np.uint64) * np.uint64(2**64 // bins)
    at = np.append(np.append(0, np.searchsorted(x, edges)), len(x))
    full = np.flatnonzero(np.diff(at))
    next_ = full[np.searchsorted(full, np.arange(bins)) % len(full)]
    least = x[at[next_]] + ((next_ - np.arange(bins)) % bins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def fingerprint_of(h: np.ndarray) -> int:
    """The SimHash of a set, signed."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def with_shingles(docs: DataFrame, words: int, at: str, whole: bool = True) -> DataFrame:
    """docs with a struct ``at``: the set's signature and size, and the set itself, or its fingerprint and bands."""

    @F.arrow_udf(SETS)
    @tidy
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            sigs, sizes, fps, sets = [], [], [], []
            for x in texts:
                s = shingle_set(x.as_py(), hashes, words)
                if len(hashes) > KEPT_WORDS:
                    hashes.clear()
                sigs.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                fps.append(0 if whole else fingerprint_of(s))
                sets.append(s if whole else bands(s))
            n = np.array(sizes, dtype=np.int64)
            offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32))
            flat = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)))
            flat = flat.cast(pa.list_(pa.field("element", pa.int64(), nullable=False)))
            yield pa.StructArray.from_arrays([pa.array(np.array(sigs, dtype=np.uint64).view(np.int64)), pa.array(n), pa.array(fps, pa.int64()), flat], ["sig", "n", "fp", "hashes"])

    return docs.withColumn(at, shingles(F.col("text")))


def sets_of(docs: DataFrame, pairs: DataFrame, fps: DataFrame, **how) -> DataFrame:
    """sig, n, shingles of the sets in pairs (a, b), made again from the documents of their smallest doc_ids."""
    sigs = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = cut(fps.join(sigs, "sig", "left_semi").select("least", "sig"))
    rows = docs.join(small(wanted.select("least").distinct(), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")
    # coalesce: else a filter for signatures that are not null would go below the join and make the sets of all documents
    made = with_shingles(rows, at="made", **how).select(F.coalesce("made.sig", F.lit(0)).alias("sig"), "made.n", F.col("made.hashes").alias("shingles"))
    return made.join(small(wanted.select("sig"), BROADCAST_ROWS), "sig", "left_semi").dropDuplicates(["sig"])


def similar(pairs: DataFrame, docs: DataFrame, fps: DataFrame, least: float, **how) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough. Many b may meet one a, which is broadcast, if all of them are small enough."""
    pairs = cut(pairs.distinct())
    if not pairs.limit(1).count():
        return pairs
    sets = cut(sets_of(docs, pairs, fps, **how))
    a, b = (sets.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in ("a", "b"))
    a = a.join(pairs.select("a").distinct(), "a", "left_semi")
    size = 8 * (a.agg(F.sum("n_a")).first()[0] or 0)
    met = pairs.join(b, "b").join(F.broadcast(a) if size <= BROADCAST_BYTES else a, "a").withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    return cut(met.filter(F.col("both") >= F.lit(least) * (F.col("n_a") + F.col("n_b") - F.col("both")) - 1e-9).select("a", "b"))


def groups(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, sig of every row), (sig, least, n, fp: the smallest doc_id, size and fingerprint of each set), (sig, root: the component of each set, by all that are similar enough)."""
    docs = docs.select("doc_id", "text")
    how = {"words": words}
    marked = cut(with_shingles(docs, at="made", whole=False, **how).select("doc_id", "made.sig", "made.n", "made.fp", "made.hashes"))
    fps = cut(marked.groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("hashes").alias("hashes")))
    keys = fps.select("sig", "n", "fp", F.explode("hashes").alias("h"))
    shared = keys.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    keys = cut(keys.join(small(cut(shared), BROADCAST_ROWS), "h"))

    def near(a: str, b: str):
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        fits = F.least(x("n"), y("n")) >= F.lit(least) * F.greatest(x("n"), y("n")) - 1e-9
        return fits & ((F.least(x("n"), y("n")) < SURE) | (F.bit_count(x("fp").bitwiseXOR(y("fp"))) <= FAR))

    # by the trees: fingerprints stand for the least of their sets
    of_fp = cut(fps.groupBy("fp").agg(F.min("sig").alias("sig")))
    tree = links(of_fp.select("fp")).join(of_fp.select(F.col("fp").alias("a"), F.col("sig").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("sig").alias("y")), "b")
    pairs = tree.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(fps.select(F.col("sig").alias("b"), "fp").join(of_fp.withColumnRenamed("sig", "a"), "fp").filter("a <> b").select("a", "b"))
    root, tried, found = fps.select("sig", F.col("sig").alias("root")), None, None
    for k in range(ROUNDS + 1):
        now = keys.join(root, "sig")
        open_ = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h", "low")
        now = cut(now.join(open_, "h"))
        if k < ROUNDS:  # one of the group's least component, another in each round
            one = now.filter("root = low").groupBy("h").agg(F.min_by(F.struct("sig", "n", "fp"), F.xxhash64(F.lit(k), "sig")).alias("one")).select("h", "one.*")
            rest = now.filter("root <> low").alias("b").join(one.alias("a"), "h").filter(near("a", "b"))
        else:
            rest = now.alias("b").join(now.alias("a"), "h").filter((F.col("a.sig") < F.col("b.sig")) & (F.col("a.root") != F.col("b.root")) & near("a", "b"))
        rest = rest.select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b"))
        rest = cut((rest if k else rest.unionByName(pairs)).distinct())
        new = similar(rest.join(tried, ["a", "b"], "left_anti") if k else rest, docs, fps, least, **how)
        tried, found = (tried.unionByName(rest), found.unionByName(new)) if k else (rest, new)
        if not k or new.limit(1).count():
            found = cut(found)
            linked = cut(components(found)).withColumnRenamed("node", "sig")
            root = cut(fps.select("sig").join(linked, "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    return marked.select("doc_id", "sig"), fps, root


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each component, columns as given: that with the smallest doc_id, a null one being the largest.

    Of rows that share that doc_id in a component, the one with the least signature stays, and of equal ones any, the same in every run.
    """
    bounded_batches(docs.sparkSession)
    marked, fps, found = groups(docs, words, least)
    by_sig = fps.join(found, "sig")
    kept = by_sig.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "sig")).alias("k")).select(F.col("k.least").alias("doc_id"), F.col("k.sig").alias("mark"))

    def mark(df, at):
        made = free(df, "_made")
        return with_shingles(df, words, made).withColumn(at, F.col(f"{made}.sig")).drop(made)

    return one_row_each(docs, marked.select("doc_id", F.col("sig").alias("mark")), cut(kept), mark, BROADCAST_ROWS)
