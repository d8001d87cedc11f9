"""Repeated passages: bytes that a string of ``LENGTH`` bytes covers which also starts anywhere else.

Suffixes are sorted only ``LENGTH`` bytes deep, by most-significant-digit passes that drop a group as soon as it has one
member; the groups that are equal in all digits are the repeated windows. Which bytes are a digit may be chosen, as long as
equal windows choose alike, and the choice makes the passes small:

1. The first digit of a window is the least of its pieces of ``ANCHOR`` bytes by a hash, its anchor; the leftmost of equal
   ones. About a hundred windows in a row have the same one, and enter the pass together, as a run: a row, not a hundred.
   A run whose anchor nobody else has is done. Runs equal in all their bytes (and counted by aggregation) are repeated as a whole.
2. Of other runs with a shared anchor, one of each content goes on, in blocks of ``BLOCK`` windows at the same places
   from the anchor. The digit is what all windows of the block share; a block equal in all bytes to another is repeated.
3. Of what is left, each window by itself.

So only what stands at the rim of a repeated passage comes to the third pass. Every pass is a sum by key (combined before the
shuffle, so a passage in a third of all rows is a row from each task) and joins that adaptive execution can split.
Digits of 64 bits group; contents count as equal by these and 64 more. Documents longer than ``SLICE`` go through in slices of
windows. Bytes of members go on through a join with the texts, by doc_id and a hash of the text.

Nulls and odd rows: a null text is an empty one; texts shorter than LENGTH keep all; rows equal in doc_id and text repeat each
other; a null doc_id is an id of its own; other columns pass through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import units
from .store import bounded_batches, cut, free, scratch

#: Fixed value of the query: bytes of a repeated string.
LENGTH = 400
#: Bytes of an anchor, windows of a block, bytes of texts and windows of a long one that are looked at together.
ANCHOR, BLOCK, SLICE = LENGTH // 2, 16, 1 << 20
#: Buckets of text hashes: texts outside those of interest stay where they are, others are shuffled and joined exactly.
BUCKETS = 1 << 21
_PLACE = np.uint64((1 << 21) - 1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and their inverses, modulo 2**64."""
    size = 1 << max(12, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_POWER, np.uint64(pow(int(_POWER), -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


class Hashes:
    """Hashes of any pieces of eight bytes or more: sums over their overlapping eight-byte words, mixed, times powers."""

    def __init__(self, data: np.ndarray):
        n = max(len(data) - 7, 0)
        self.up, self.down = _powers(n + 1)
        words = np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)) if n else np.zeros(0, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mixed(words) * self.up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        return (self.sums[starts + sizes - 7] - self.sums[starts]) * self.down[starts]

    def all(self, size: int) -> np.ndarray:
        """Of every piece of that size."""
        n = max(len(self.sums) + 7 - size, 0)
        return (self.sums[size - 7 : size - 7 + n] - self.sums[:n]) * self.down[:n]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts end to end, the runs of windows with one anchor: text, first window in it, windows, place of the anchor from there, key, content."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    g = hashes.all(ANCHOR)
    place = np.arange(len(g), dtype=np.uint64)
    order = (_mixed(g) & ~_PLACE) | place
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= LENGTH)
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[offsets[:-1][long]] += 1
    np.add.at(change, offsets[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    least = _least(order, LENGTH - ANCHOR + 1)  # of valid windows, that lie in one text, all pieces do too
    v = np.flatnonzero(inside[: len(least)])
    if not len(v):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (least[v] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    start, anchor = v[first], anchor[first]
    n = v[np.append(first[1:] - 1, len(v) - 1)] - start + 1
    content = _mixed(hashes.of(start, n + LENGTH - 1) + (n * 1024 + anchor - start).astype(np.uint64) * _POWER)
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], n, anchor - start, g[anchor], content


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, values = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def _sliced(batch: pa.RecordBatch, size: int):
    """(rows of a slice, bytes, offsets, where they start in the text)."""
    for part in units.by_bytes(batch, "text", size):
        data, offsets = _texts(part.column("text"))
        if part.num_rows > 1 and len(data) > size + LENGTH:  # by_bytes may add a long row to a slice
            for i in range(part.num_rows):
                yield from _sliced(part.slice(i, 1), size)
        elif len(data) <= size + LENGTH:
            yield part, data, offsets, 0
        else:
            for at in range(0, len(data) - LENGTH + 1, size):
                piece = data[at : at + size + LENGTH - 1]
                yield part, piece, np.array([0, len(piece)]), at


def _runs(batches, size: int):
    """doc_id, th, text -> doc_id, th, start, windows, anchor, key, content, n; key is null where the windows are repeated already."""
    for batch in batches:
        for rows, data, offsets, begin in _sliced(batch, size):
            text, start, windows, anchor, key, content = runs(data, offsets)
            if not len(text):
                continue
            order = np.lexsort((content, key, text))
            t, k, c = text[order], key[order], content[order]
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            n = np.diff(np.append(first, len(order)))
            again = np.sort(order[np.repeat(n > 1, n)])  # runs that a text holds twice in this slice
            seam = np.flatnonzero(np.append(True, (text[again][1:] != text[again][:-1]) | (start[again][1:] != start[again][:-1] + windows[again][:-1]))) if len(again) else again
            lengths = np.add.reduceat(windows[again], seam) if len(again) else again
            one = order[first]
            pick = np.append(one, again[seam])
            known = np.append(np.zeros(len(one), dtype=bool), np.ones(len(seam), dtype=bool))
            zero = np.zeros(len(seam), dtype=np.int64)
            of = pa.array(text[pick])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(of), rows.column("th").take(of), pa.array(start[pick] + begin), pa.array(np.append(windows[one], lengths)), pa.array(np.append(anchor[one], zero)), pa.array(key[pick].view(np.int64), mask=known), pa.array(content[pick].view(np.int64)), pa.array(np.append(n, zero))],
                names=["doc_id", "th", "start", "windows", "anchor", "key", "content", "n"],
            )


def _members(batches):
    """doc_id, th, text, at -> the bytes of each run of at."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, at = memoryview(batch.column("text")[i].as_buffer()), batch.column("at")[i].as_py()
            for k in range(0, len(at), 1000):
                some = at[k : k + 1000]
                row = pa.array([i] * len(some))
                columns = [batch.column("doc_id").take(row), batch.column("th").take(row)]
                columns += [pa.array([x[c] for x in some], pa.int64()) for c in ("start", "windows", "anchor", "key", "n")]
                data = [bytes(text[x["start"] : x["start"] + x["windows"] + LENGTH - 1]) for x in some]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], names=["doc_id", "th", "start", "windows", "anchor", "key", "n", "data"])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of them, how many of it came before), each as often as it counts."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(batches):
    """_members() -> their blocks: what the windows that may be in one share, what those that are in it cover, and where they are."""
    for batch in batches:
        data, offsets = _texts(batch.column("data"))
        if not batch.num_rows:
            continue
        hashes = Hashes(data)
        start, windows, anchor, key = (batch.column(c).to_numpy() for c in ("start", "windows", "anchor", "key"))
        least, most = anchor - windows + 1, anchor  # how far before the anchor the windows start
        of, k = _spread(most // BLOCK - least // BLOCK + 1)
        block = least[of] // BLOCK + k
        low, high = np.maximum(block * BLOCK, least[of]), np.minimum(block * BLOCK + BLOCK - 1, most[of])
        home = offsets[:-1][of] + anchor[of]
        core = _mixed(hashes.of(home - block * BLOCK, LENGTH - BLOCK + 1) ^ key[of].view(np.uint64)) + block.astype(np.uint64)
        content = _mixed(hashes.of(home - high, high - low + LENGTH) + (low * 1024 + high).astype(np.uint64) * _POWER)
        row = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(start[of]), pa.array(low), pa.array(high), pa.array(core.view(np.int64)), pa.array(content.view(np.int64)), batch.column("n").take(row)],
            names=["doc_id", "th", "start", "low", "high", "key", "content", "n"],
        )


def _windows(batches):
    """_members() with blocks -> each window of those: doc_id, th, start, key and content (two hashes of it), n."""
    for batch in batches:
        data, offsets = _texts(batch.column("data"))
        if not batch.num_rows:
            continue
        hashes = Hashes(data)
        lists = batch.column("blocks")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        low, high, n = (flat.field(c).to_numpy() for c in ("low", "high", "n"))
        of, k = _spread(high - low + 1)
        at = batch.column("anchor").to_numpy()[row][of] - low[of] - k
        home = offsets[:-1][row][of] + at
        h = hashes.of(home, LENGTH)
        other = hashes.of(home, LENGTH // 2) * _POWER ^ _mixed(hashes.of(home + LENGTH // 2, LENGTH - LENGTH // 2))
        which = pa.array(row[of])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("th").take(which), pa.array(batch.column("start").to_numpy()[row][of] + at), pa.array(h.view(np.int64)), pa.array(other.view(np.int64)), pa.array(n[of])], names=["doc_id", "th", "start", "key", "content", "n"])


def _settled(spans: DataFrame, *place: str) -> tuple[DataFrame, DataFrame]:
    """spans (key, content, n, ...) -> (those whose content counts twice or more; one span of each content of keys that have several of which one counts once).

    The second has n, at most 2, and a span's ``place``.
    """
    total = cut(spans.groupBy("key", "content").agg(F.least(F.sum("n"), F.lit(2)).alias("n"), F.min(F.struct(*place)).alias("p")))
    several = cut(total.groupBy("key").agg(F.count("*").alias("contents"), F.min("n").alias("least")).filter("contents > 1 AND least = 1").select("key"))
    repeated = spans.join(cut(total.filter("n > 1").select("key", "content")), ["key", "content"], "left_semi")
    return repeated, total.join(several, "key", "left_semi").select("key", "n", "p.*")


def _same(a: str, b: str, *names: str):
    """Equal rows' ids, nulls included."""
    out = F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    for c in names:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def _buckets(ids: DataFrame) -> DataFrame:
    """The buckets that the hashes ``th`` of some texts fall into: BUCKETS rows at most, so they may be broadcast. What is in none of them isn't meant."""
    return F.broadcast(ids.select(F.pmod("th", F.lit(BUCKETS)).alias("bucket")).distinct())


def _among(th: str, buckets: DataFrame):
    return F.pmod(F.col(th), F.lit(BUCKETS)) == buckets["bucket"]


def repeated_windows(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """docs (doc_id, th: a hash of the text, text) -> doc_id, th, start, windows: ranges of windows of LENGTH bytes that are repeated."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = f"doc_id {kind}, th long, start long"
    schema = f"{ids}, windows long, anchor long, key long, content long, n long"
    docs.mapInArrow(units.tidy(lambda batches: _runs(batches, size)), schema).write.parquet(at := scratch(spark, "runs"))
    stored = spark.read.schema(schema).parquet(at)
    keyed = stored.filter("key IS NOT NULL")
    shared = cut(keyed.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))
    spans = cut(keyed.join(shared, "key", "left_semi"))
    ranges = "doc_id", "th", "start", "windows"
    whole, members = _settled(spans, *ranges, "anchor")
    lists = cut(members.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "anchor", "key", "n")).alias("at")))
    buckets = _buckets(lists)
    joined = docs.join(buckets, _among("th", buckets), "left_semi").alias("d").join(lists.hint("shuffle_hash").alias("m"), _same("d", "m", "th")).select("d.doc_id", "d.th", F.col("d.text").cast("binary").alias("text"), "m.at")
    data = cut(joined.mapInArrow(units.tidy(_members), f"{ids}, windows long, anchor long, key long, n long, data binary"))
    blocks = cut(data.mapInArrow(_blocks, f"{ids}, low long, high long, key long, content long, n long"))
    anchors = data.select("doc_id", "th", "start", "anchor")
    repeated, members = _settled(blocks, "doc_id", "th", "start", "low", "high")
    found = cut(repeated.filter("n = 1").select("doc_id", "th", "start", "low", "high"))
    some = found.alias("f").join(anchors.alias("a"), _same("f", "a", "th", "start")).select("f.doc_id", "f.th", (F.col("f.start") + F.col("anchor") - F.col("high")).alias("start"), (F.col("high") - F.col("low") + 1).alias("windows"))
    lists = cut(members.groupBy("doc_id", "th", "start").agg(F.collect_list(F.struct("low", "high", "n")).alias("blocks")))
    joined = data.alias("d").join(lists.alias("m"), _same("d", "m", "th", "start")).select("d.doc_id", "d.th", "d.start", "d.anchor", "d.data", "m.blocks")
    schema = f"{ids}, key long, content long, n long"
    joined.mapInArrow(_windows, schema).write.parquet(at := scratch(spark, "windows"))  # packed, where a checkpoint has whole rows
    windows = spark.read.schema(schema).parquet(at)
    twice = cut(windows.groupBy("key", "content").agg(F.sum("n").alias("n")).filter("n > 1").select("key", "content"))
    single = windows.filter("n = 1").join(twice, ["key", "content"], "left_semi").select("doc_id", "th", "start", F.lit(1).cast("long").alias("windows"))
    return stored.filter("key IS NULL").select(*ranges).unionByName(whole.select(*ranges)).unionByName(some).unionByName(single)


def without(text: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs of them, what is left) of a text without those ranges of windows."""
    if not len(start):
        return 0, 0, text
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate((start + windows)[order]) + LENGTH - 1
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    start, end = start[first], end[np.append(first[1:] - 1, len(end) - 1)]
    pieces = [text[i:j] for i, j in zip([0, *end.tolist()], [*start.tolist(), len(text)])]
    return int((end - start).sum()), len(start), b"".join(pieces)


@F.arrow_udf(KEPT)
def _kept(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, start, windows in columns:
        n, rows = [], []
        for i in range(len(text)):
            data = text[i].as_buffer().to_pybytes() if text[i].is_valid else b""
            s, w = (np.array(x[i].as_py() or [], dtype=np.int64) for x in (start, windows))
            n.append(len(data)), rows.append(without(data, s, w))
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)), pa.array([r[2] for r in rows], pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, at: str, size: int = SLICE) -> DataFrame:
    """docs (doc_id, text, ...) with a column ``at``, a name that it doesn't have: struct of n_bytes, n_removed, n_spans and kept (bytes, as a cut may part a character)."""
    bounded_batches(docs.sparkSession)
    body, th = F.coalesce(F.col("text"), F.lit("")), free(docs, "_th")
    found = repeated_windows(docs.select("doc_id", F.xxhash64(body).alias("th"), body.alias("text")), size)
    found = cut(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows")).alias("r")).select("doc_id", "th", F.col("r.start").alias("s"), F.col("r.windows").alias("w")))
    marked, buckets = docs.withColumn(th, F.xxhash64(body)), _buckets(found)
    whole = marked.join(buckets, _among(th, buckets), "left_anti")
    n = lambda v: v.cast("long")
    whole = whole.withColumn(at, F.struct(n(F.octet_length(body)).alias("n_bytes"), n(F.lit(0)).alias("n_removed"), n(F.lit(0)).alias("n_spans"), body.cast("binary").alias("kept"))).drop(th)
    some = marked.join(buckets, _among(th, buckets), "left_semi").alias("d")
    joined = some.join(found.hint("shuffle_hash").alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col(f"d.{th}") == F.col("m.th")), "left")
    return whole.unionByName(joined.select("d.*", _kept(F.col("d.text").cast("binary"), F.col("m.s"), F.col("m.w")).alias(at)).drop(th))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, "r")
    return out.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", F.sha2("r.kept", 256).alias("kept_sha256"))
