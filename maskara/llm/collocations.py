"""Phrases of 2 to 4 words that stand together, mined for each language from packed word ids.

Words are counted for each language. Those with the least count of a phrase get ids (their rank among the hashes of all of
them); all others break pieces, for no phrase that holds one can reach that count. Texts become streams of ids, 0 between
pieces, kept as binary rows. An n-gram is packed into ``n`` ids end to end; a task sorts its keys by radix
passes over 64-bit digits and counts runs before anything is shuffled. What is left goes to ranges of keys, is sorted there,
and runs are summed. Lengths are counted in turn: an n-gram with n > 2 is packed only where both its parts of n - 1 words have the count,
as far as a bitmap of ``Sizes.bits`` bits tells; it has no false negatives, and false positives fall in the count.

Sizes: the dictionary is broadcast while it has at most ``MOST_WORDS`` words. Beyond that 64-bit hashes serve as ids and no
word breaks a piece, with the same results; the bitmap has a fixed size. Everything else is joined by key.

Nulls and odd rows: a null text is an empty one; a null language is ``und``; repeated rows count again; other columns are
not read. Words and texts of any length are whole. An empty table, or one without a phrase of that count, gives no row.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import units
from .store import bounded_batches, cut, drawn, scratch

#: Fixed values of the query: least count, longest phrase, scale of scores, share (in percent) of a part that a longer phrase must hold, phrases of a language.
LEAST, LONGEST, SCALE, WITHIN, TOP = 30, 4, 2_000_000, 80, 2000
#: Words of a broadcast dictionary; buckets that a language's ranking starts in; rows that ranges of keys are drawn from.
MOST_WORDS, SALTS, SAMPLE_ROWS = 2_000_000, 64, 256


class Sizes(NamedTuple):
    """Bits of the bitmap; words and keys that a task holds before it hands them on; n-grams that start in a row of a stream."""

    bits: int = 1 << 27
    held_words: int = 300_000
    held_keys: int = 2_000_000
    starts: int = 1024


_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[_BREAK] = 0x20
_FOLD[0x09] = 0x20


def _words(batch: pa.RecordBatch) -> tuple[units.Cut, np.ndarray, np.ndarray]:
    """lang, text -> (the words, folded; the piece that each is in, counted over the batch; their hashes by language)."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    _, at, values = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    folded = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[data])])
    words = units.Cut.runs(folded)
    seams = np.sort(np.append(np.flatnonzero(_BREAK[data]), offsets[:-1]))
    langs = pc.dictionary_encode(batch.column("lang"))
    salt = np.array([xxhash.xxh3_64_intdigest(x.as_py()) for x in langs.dictionary], dtype=np.uint64)[langs.indices.to_numpy()] if len(texts) else np.zeros(0, dtype=np.uint64)
    h = words.hashes()
    h[:, 0] ^= np.repeat(salt, np.diff(words.offsets))
    return words, np.searchsorted(seams, words.starts, "right"), h


def _counted(batches, sizes: Sizes):
    """lang, text -> lang, word, f: sums of a part of a task."""
    table: dict = {}

    def told():
        for lang, (places, f, names) in table.items():
            if places.n:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * places.n), pa.array(names), pa.array(f[: places.n])], names=["lang", "word", "f"])
        table.clear()

    for batch in batches:
        for part in units.by_bytes(batch, "text"):
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                words, _, h = _words(part.filter(pc.equal(langs, lang)))
                places, f, names = table.get(lang) or (units.Places(1 << 12), np.zeros(0, dtype=np.int64), [])
                numbers, new = places.numbers(h)
                f = np.append(f, np.zeros(places.n - len(f), dtype=np.int64)) + np.bincount(numbers, minlength=places.n)
                names += words.strings(new)
                table[lang] = places, f, names
            if sum(x[0].n for x in table.values()) > sizes.held_words:
                yield from told()
    yield from told()


class Ids:
    """Ids of words by their 128-bit hashes: ranks from 1 in a dictionary, 0 for other words; without one, the hashes' first halves."""

    def __init__(self, hashes: np.ndarray | None):
        self.width = 8 if hashes is None else 4
        self.known = hashes if hashes is None else hashes[np.lexsort((hashes[:, 1], hashes[:, 0]))]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.known is None:
            return np.maximum(h[:, 0], np.uint64(1))
        out = np.zeros(len(h), dtype=np.uint32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known[:, 0], h[:, 0]), len(self.known) - 1)
            while (on := np.flatnonzero((out == 0) & (self.known[at, 0] == h[:, 0]))).size:
                same = on[self.known[at[on], 1] == h[on, 1]]
                out[same] = at[same] + 1
                more = on[(out[on] == 0) & (at[on] + 1 < len(self.known))]
                if not more.size:
                    break
                at[more] += 1
        return out


def _streams(batches, ids: Ids, starts: int):
    """lang, text -> ids: a row for each ``starts`` n-grams, with the LONGEST - 1 ids after them."""
    for batch in batches:
        for part in units.by_bytes(batch, "text"):
            words, piece, h = _words(part)
            if not len(words):
                continue
            got = ids(h)
            at = np.arange(len(got)) + np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
            out = np.zeros(at[-1] + 2, dtype=got.dtype)
            out[at] = got
            out = out[np.append(True, (out[1:] > 0) | (out[:-1] > 0))]
            rows = -(-len(out) // starts)
            out = np.append(out, np.zeros(rows * starts + LONGEST - 1 - len(out), dtype=out.dtype))
            size = out.itemsize
            data = [out[k * starts : (k + 1) * starts + LONGEST - 1].tobytes() for k in range(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary(size * (starts + LONGEST - 1))).cast(pa.binary())], names=["ids"])


def _spot(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit that stands for each n-gram in the bitmap."""
    x = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        x = (x ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(bits)).astype(np.int64)


def _grams(data: np.ndarray, n: int, bitmap: np.ndarray | None) -> list[np.ndarray]:
    """[row, starts + LONGEST - 1] ids -> the n-grams' ids, as n columns."""
    columns = [data[:, k : k + data.shape[1] - LONGEST + 1] for k in range(n)]
    ok = reduce(np.logical_and, (c > 0 for c in columns)).ravel()
    columns = [c.ravel()[ok] for c in columns]
    if bitmap is not None and len(columns[0]):
        spots = [_spot(part, 64 * len(bitmap)) for part in (columns[:-1], columns[1:])]
        ok = np.logical_and(*((bitmap[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) > 0 for x in spots))
        columns = [c[ok] for c in columns]
    return columns


def _digits(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The n-grams as 64-bit digits, the most significant first."""
    if columns[0].itemsize == 8:
        return list(columns)
    return [(a.astype(np.uint64) << np.uint64(32)) | b for a, b in zip(columns[::2], [*columns[1::2], np.zeros(len(columns[0]), dtype=np.uint64)])]


def _runs(digits: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, and the sums of their counts: radix passes from the least significant digit on, then runs."""
    order = np.argsort(digits[-1], kind="stable")
    for d in digits[-2::-1]:
        order = order[np.argsort(d[order], kind="stable")]
    digits = [d[order] for d in digits]
    first = np.flatnonzero(np.append(True, reduce(np.logical_or, (d[1:] != d[:-1] for d in digits))))
    return [d[first] for d in digits], np.add.reduceat(counts[order], first)


def _packed(digits: list[np.ndarray], n: int, width: int) -> np.ndarray:
    """[key, n * width] bytes, big-endian, so that they sort as the ids do."""
    return np.ascontiguousarray(np.stack(digits, 1).astype(">u8")).view(np.uint8).reshape(len(digits[0]), -1)[:, : n * width]


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def _stream_rows(batch: pa.RecordBatch, width: int, starts: int) -> np.ndarray:
    rows = batch.column("ids")
    _, at, values = rows.buffers()
    start = int(np.frombuffer(at, dtype=np.int32)[rows.offset]) if len(rows) else 0
    size = starts + LONGEST - 1
    return np.frombuffer(values, dtype=f"u{width}", count=len(rows) * size, offset=start).reshape(-1, size)


def _keys(batches, n: int, width: int, bitmap, splitters: np.ndarray, sizes: Sizes):
    """ids -> range, key, c: runs of a part of a task."""
    held, sums, more, size = None, None, [], 0

    def merged():
        digits = [np.concatenate([g[k] for g in [*([held] if held else []), *more]]) for k in range(len(more[0]))]
        counts = np.ones(len(digits[0]), dtype=np.int64)
        if held:
            counts[: len(sums)] = sums
        return _runs(digits, counts)

    def told(digits, counts):
        where = np.searchsorted(splitters, digits[0], "right")
        for at in range(0, len(counts), 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(where[part], pa.int32()), _binary(_packed([d[part] for d in digits], n, width)), pa.array(counts[part])], names=["range", "key", "c"])

    for batch in batches:
        columns = _grams(_stream_rows(batch, width, sizes.starts), n, bitmap)
        if len(columns[0]):
            more.append(_digits(columns))
            size += len(columns[0])
        if size >= sizes.held_keys:
            held, sums = merged()
            more, size = [], 0
            if len(sums) >= sizes.held_keys:
                yield from told(held, sums)
                held = sums = None
    if more:
        held, sums = merged()
    if held:
        yield from told(held, sums)


def _summed(batches, least: int):
    """key, c in the order of keys -> key, a: runs of at least that sum."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("key")
        _, at, values = rows.buffers()
        bounds = np.frombuffer(at, dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
        keys = np.frombuffer(values, dtype=np.uint8)[bounds[0] : bounds[-1]].reshape(len(rows), -1)
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        sums = np.add.reduceat(batch.column("c").to_numpy(), first)
        keys = keys[first]
        if last is not None and (keys[0] == last).all():
            sums[0] += total
        elif last is not None and total >= least:
            yield pa.RecordBatch.from_arrays([_binary(last[None]), pa.array([total], pa.int64())], names=["key", "a"])
        last, total = keys[-1], int(sums[-1])
        ok = np.append(sums[:-1] >= least, False)
        yield pa.RecordBatch.from_arrays([_binary(keys[ok]), pa.array(sums[ok])], names=["key", "a"])
    if last is not None and total >= least:
        yield pa.RecordBatch.from_arrays([_binary(last[None]), pa.array([total], pa.int64())], names=["key", "a"])


def _spots(batches, width: int, bits: int):
    """key -> word, bits: what the keys set in the bitmap."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=f">u{width}").reshape(batch.num_rows, -1)
        spot = _spot(list(keys.T), bits)
        yield pa.RecordBatch.from_arrays([pa.array(spot >> 6), pa.array((np.uint64(1) << (spot & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])


def _splitters(streams: DataFrame, total: int, n: int, width: int, bitmap, ranges: int, starts: int) -> np.ndarray:
    """Where ranges of keys part, by a sample of SAMPLE_ROWS rows: they decide how even the tasks are, and nothing else."""
    rows = drawn(streams, SAMPLE_ROWS, total, "ranges", "ids").limit(4 * SAMPLE_ROWS).toArrow()
    got = [_digits(g)[0] for b in rows.to_batches() if b.num_rows and len((g := _grams(_stream_rows(b, width, starts), n, bitmap))[0])]
    keys = np.unique(np.concatenate(got)) if got else np.zeros(0, dtype=np.uint64)
    return np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys


def _counts(streams: DataFrame, total: int, n: int, width: int, least: int, bitmap: np.ndarray | None, sizes: Sizes) -> DataFrame:
    """key, a of all n-grams with that count."""
    spark = streams.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(streams, total, n, width, bitmap, ranges, sizes.starts)
    shared = spark.sparkContext.broadcast(bitmap)
    runs = streams.mapInArrow(units.tidy(lambda batches: _keys(batches, n, width, shared.value, splitters, sizes)), "range int, key binary, c long")
    dealt = runs.repartitionById(ranges, "range").select("key", "c").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(lambda batches: _summed(batches, least), "key binary, a long"))


def _bitmap(counts: DataFrame, width: int, bits: int) -> np.ndarray:
    """bits / 64 words, at most that many rows come to the driver."""
    rows = counts.select("key").mapInArrow(lambda batches: _spots(batches, width, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    docs.mapInArrow(units.tidy(lambda batches: _counted(batches, sizes)), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")).write.parquet(at := scratch(spark, "words"))
    words = spark.read.schema("lang string, word string, f long").parquet(at)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.filter(F.col("f") >= least)

    def hashed(batches):
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word")], names=["lang", "text"])
            _, _, h = _words(one)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))], names=["lang", "word", "f", "h0", "h1"])

    often = cut(often.mapInArrow(hashed, "lang string, word string, f long, h0 long, h1 long"))
    if often.limit(most_words + 1).count() > most_words:
        ids = Ids(None)
    else:
        known = often.select("h0", "h1").toArrow()
        ids = Ids(np.stack([known[c].to_numpy().view(np.uint64) for c in ("h0", "h1")], 1))
    shared, width = spark.sparkContext.broadcast(ids), ids.width

    def numbered(batches):
        for batch in batches:
            h = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1")], 1)
            keys = np.ascontiguousarray(shared.value(h).astype(f">u{width}")).view(np.uint8).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([_binary(keys), *(batch.column(c) for c in ("lang", "word", "f"))], names=["key", "lang", "word", "f"])

    single = cut(often.mapInArrow(numbered, "key binary, lang string, word string, f long"))
    docs.mapInArrow(units.tidy(lambda batches: _streams(batches, shared.value, sizes.starts)), "ids binary").write.parquet(at := scratch(spark, "ids"))
    streams = spark.read.schema("ids binary").parquet(at)
    total, found, bitmap = streams.count(), [], None
    for k in range(2, LONGEST + 1):
        found.append(_counts(streams, total, k, width, least, bitmap, sizes).withColumn("words", F.lit(k)))
        if k < LONGEST:
            bitmap = _bitmap(found[-1], width, sizes.bits)
    return _ranked(reduce(DataFrame.unionByName, found), single, n, width, top)


def _ranked(found: DataFrame, single: DataFrame, n: DataFrame, width: int, top: int) -> DataFrame:
    """key, a, words of all phrases; key, lang, word, f of their words -> phrases()."""
    part = lambda begin, words: F.substring("key", begin * width + 1, words * width)
    f = single.select("key", "f", "lang").unionByName(found.select("key", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")))
    cuts = found.select("key", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "words", "k", part(F.lit(0), F.col("k")).alias("head"), part(F.col("k"), F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(f.select(F.col("key").alias("head"), F.col("f").alias("l"), "lang"), "head").join(f.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    exact = cuts.withColumn("x", whole("a") * F.lit(SCALE).cast("decimal(10,0)")).withColumn("y", whole("l") + whole("r"))
    scored = exact.groupBy("key", "a", "words").agg(F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("m"), F.max("lang").alias("lang"))
    scored = scored.select("key", "lang", "a", "words", "m.l", "m.r", "m.score")
    inside = found.filter("words > 2").select("key", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda w: F.transform(F.sequence(F.lit(0), F.col("words") - w), lambda b: F.substring("key", b * width + 1, w * width))))).alias("part"))
    inside = inside.groupBy("part").agg(F.max("longer").alias("longer")).withColumnRenamed("part", "key")
    kept = scored.join(inside, "key", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < WITHIN * F.col("a")))
    order = [F.desc("score"), F.desc("a")]
    for by in (["lang", F.pmod(F.xxhash64("key"), F.lit(SALTS))], ["lang"]):  # ties stay, so that phrases decide
        kept = kept.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    kept = cut(kept.drop("rank"))
    spelled = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda b: F.substring("key", b * width + 1, width))).alias("pos", "id"))
    spelled = spelled.join(single.select(F.col("key").alias("id"), "word"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    named = kept.join(spelled, "key").join(n, "lang").select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS a
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE a >= 30),
c AS (SELECT f.lang, f.phrase, f.k, f.a, j AS cut, h.a AS l, t.a AS r, (CAST(f.a AS HUGEINT) * 2000000) // (h.a + t.a) AS score
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k >= 2) f
    JOIN f h ON h.lang = f.lang AND h.k = j AND h.phrase = list_aggregate(f.w[1:j], 'string_agg', ' ')
    JOIN f t ON t.lang = f.lang AND t.k = f.k - j AND t.phrase = list_aggregate(f.w[j + 1:f.k], 'string_agg', ' ')),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, cut) = 1),
longer AS (SELECT lang, sub, max(a) AS a FROM (SELECT f.lang, f.a, list_aggregate(string_split(phrase, ' ')[i:i + m - 1], 'string_agg', ' ') AS sub
    FROM (SELECT f.*, m, unnest(range(1, k - m + 2)) AS i FROM f, (VALUES (2), (3)) AS t(m) WHERE k > m) f) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN longer o ON o.lang = s.lang AND o.sub = s.phrase WHERE o.a IS NULL OR 100 * o.a < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
