"""BPE encoding and decoding through a table of distinct words.

Documents are split in Spark into units (``units.py``), the pieces of text that byte-level BPE encodes on their own.
Each task keeps one table of the distinct units of a block of documents and writes the documents as positions in
it. Over all blocks the units meet in buckets by a hash of their text, each distinct unit is encoded once, and its ids
join back to its block by position. For decoding, the distinct ids of a block join the vocabulary's id-to-piece table, and a
document is its ids' pieces end to end, read as UTF-8 with U+FFFD for what isn't.

What is shuffled is the distinct units of a block, a compressed row for each bucket, and the documents as positions; what
is broadcast is the vocabulary. A block is about ``BLOCK_BYTES`` of text (a longer document is a block of its own), so no task
holds more than a block or a bucket's distinct units, however long or frequent anything is.

Nulls and odd rows: a null text is encoded like the empty one, to no ids; the added tokens' strings in a text become
their ids, as the tokenizers library does by default. Rows are told apart by their place in a block, so a repeated or
null doc_id is no matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .store import bounded_batches
from .units import Cut, Places, by_bytes, gathered, tidy

#: Bytes of text in a block, about.
BLOCK_BYTES = 8_000_000
#: Bytes of text cut at a time.
SLICE_BYTES = 250_000
#: Rows in an output batch.
BATCH = 2000
#: Documents for each bucket of distinct units, and most buckets; distinct units of a bucket held at a time.
BUCKET_DOCS, MOST_BUCKETS, KEPT_UNITS = 2500, 65_536, 1_000_000
#: Numbers packed or unpacked at a time.
PACKED = 250_000
#: Level of compression of what is shuffled and kept.
LEVEL = 3
#: A block may hold repeats far apart: the window covers all of it.
WINDOW_LOG = 26


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(source: str):
    """A tokenizer from the text of its file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class UnitEncoder:
    """Encodes units. Those that start with a space and hold no other are encoded end to end in one call."""

    def __init__(self, source: str):
        self.tokenizer = load(source)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens = np.array([x.startswith("Ġ") for x in names])  # the byte 0x20 opens a unit

    def __call__(self, cut: Cut, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of the units at those places of a cut."""
        if not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        joint = cut.joint(at)
        lengths = np.zeros(len(at), dtype=np.int64)
        one, other = np.flatnonzero(joint), np.flatnonzero(~joint)
        found = []
        for i in range(0, len(one), 20_000):
            part = one[i : i + 20_000]
            text = cut.bytes_of(at[part]).tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                raise ValueError("the vocabulary encodes a unit's first space apart")
            lengths[part] = np.diff(np.append(starts, len(ids)))
            found.append(ids)
        for i in range(0, len(other), 2_000):
            part = other[i : i + 2_000]
            for k, e in zip(part.tolist(), self.tokenizer.encode_batch_fast(cut.strings(at[part]), add_special_tokens=False)):
                lengths[k] = len(e.ids)
                found.append(np.array(e.ids, dtype=np.uint32))
        order = np.append(one, other)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return lengths, gathered(back, lengths[order], np.concatenate(found))[0]


def pieces_of(source: str) -> list[bytes]:
    """The bytes of every id. Byte-level pieces spell bytes as letters: the printable ones of Latin-1 stand for themselves, the others, in order, for the letters from U+0100 on."""
    import json

    given = json.loads(source)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    spelt = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    tokenizer = load(source)
    added = {t["id"] for t in given["added_tokens"]}
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        name = tokenizer.id_to_token(i) or ""
        out.append(bytes(spelt[c] for c in name) if all(c in spelt for c in name) else name.encode())
    return [x if i not in added else (tokenizer.id_to_token(i) or "").encode() for i, x in enumerate(out)]


def _squeezed(data: bytes) -> bytes:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, enable_ldm=True, window_log=min(WINDOW_LOG, max(10, len(data).bit_length())))
    return zstandard.ZstdCompressor(compression_params=how).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(a: np.ndarray) -> bytes:
    """Numbers below 2**32: how many bytes each needs, then their lowest bytes, their second ones and so on, compressed."""
    a = np.asarray(a).astype(np.uint32, copy=False)
    parts = [a[i : i + PACKED] for i in range(0, len(a), PACKED)]
    n = [(x >= 1 << 8).astype(np.uint8) + (x >= 1 << 16) + (x >= 1 << 24) for x in parts]
    planes = [(x[m >= k] >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4) for x, m in zip(parts, n)]  # the cast keeps the lowest byte
    return np.uint64(len(a)).tobytes() + _squeezed(b"".join([*(m.tobytes() for m in n), *planes]))


def _unpacked(b: bytes) -> np.ndarray:
    size, raw = int(np.frombuffer(b[:8], dtype=np.uint64)[0]), np.frombuffer(_whole(b[8:]), dtype=np.uint8)
    n, at = raw[:size], size
    out = np.zeros(size, dtype=np.uint32)
    for k in range(4):
        for i in range(0, size, PACKED):
            has = np.flatnonzero(n[i : i + PACKED] >= k)
            out[i + has] |= raw[at : at + len(has)].astype(np.uint32) << np.uint32(8 * k)
            at += len(has)
    return out


UNITS = pa.schema([("block", pa.int64()), ("stamp", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])
UNITS_SQL = "block long, stamp long, bucket int, places binary, lengths binary, data binary"
TEXTS = pa.schema([("block", pa.int64()), ("stamp", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("codes", pa.binary())])
TEXTS_SQL = "block long, stamp long, doc_ids array<long>, sizes binary, codes binary"


class _Table:
    """The distinct units of a block: their bytes end to end, lengths and hashes, in the order in which they came."""

    def __init__(self):
        self.places, self.bytes, self.lengths, self.hashes = Places(1 << 16), [], [], []

    def codes(self, cut: Cut) -> np.ndarray:
        h = cut.hashes()
        got, new = self.places.numbers(h)
        self.bytes.append(cut.bytes_of(new))
        self.lengths.append(cut.ends[new] - cut.starts[new])
        self.hashes.append(h[new, 1])
        return got.astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_id, text, part (the partition) -> (block, stamp, the distinct units, the commonest first, as a cut and one half of their hashes, and of
    the documents: doc_ids, how many units each has, the units' places among the distinct ones). The stamp tells one content of a block from another."""
    task, block, held, table, rows = 0, 0, 0, _Table(), []

    def whole():
        nonlocal block, held, table, rows
        codes = np.concatenate([r.pop() for r in rows])
        lengths, hashes = np.concatenate(table.lengths), np.concatenate(table.hashes)
        count = np.zeros(len(lengths), dtype=np.int64)
        for i in range(0, len(codes), PACKED):
            count += np.bincount(codes[i : i + PACKED], minlength=len(lengths))
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(lengths), dtype=np.uint32)
        place[order] = np.arange(len(lengths))
        data, lengths = gathered(order, lengths, np.concatenate(table.bytes))
        table, data = _Table(), data.tobytes()
        for i in range(0, len(codes), PACKED):
            codes[i : i + PACKED] = place[codes[i : i + PACKED]]
        stamp = zlib.crc32(lengths.tobytes(), zlib.crc32(data, len(codes)))
        out = (task << 32) + block, stamp, (Cut.end_to_end(data, lengths), hashes[order]), pa.concat_arrays([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), codes
        block, held, rows = block + 1, 0, []
        return out

    for batch in batches:
        for part in by_bytes(batch, "text", SLICE_BYTES):
            task = part.column("part")[0].as_py()
            cut = Cut.of(part.column("text"))
            rows.append([pa.array(part.column("doc_id").to_pylist(), pa.int64()), np.diff(cut.offsets), table.codes(cut)])  # a copy, not a view of the batch
            held += part.column("text").nbytes
            if held >= BLOCK_BYTES:
                yield whole()
    if rows:
        yield whole()


@tidy
def _split_units(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each block and each bucket that a hash deals its distinct units to: their places, lengths in bytes, and bytes."""
    for block, stamp, (units, hashes), *_ in _blocks(batches):
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out: dict = {f.name: [] for f in UNITS}
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            for f, v in zip(out, (block, stamp, int(bucket[at[0]]), _packed(np.diff(at, prepend=0)), _packed(units.ends[at] - units.starts[at]), _squeezed(units.bytes_of(at).tobytes()))):
                out[f].append(v)
        del units, hashes, _, bucket, order  # a block's, before the next one is read
        yield pa.RecordBatch.from_pydict(out, schema=UNITS)


@tidy
def _split_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block its documents, as places of units."""
    for block, stamp, _, doc_ids, sizes, codes in _blocks(batches):
        doc_ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
        out = {"block": [block], "stamp": [stamp], "doc_ids": doc_ids, "sizes": [_packed(sizes)], "codes": [_packed(codes)]}
        del _, doc_ids, sizes, codes  # a block's, before the next one is read
        yield pa.RecordBatch.from_pydict(out, schema=TEXTS)


@tidy
def _encoded_buckets(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """Rows of distinct units sorted by bucket -> block, places, lengths (ids of each unit) and data (the ids)."""
    encoder, now, seen = UnitEncoder(source), None, Places(1 << 16)
    sizes = ids = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now or seen.n > KEPT_UNITS:
                now, sizes, ids = row["bucket"], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
                seen.clear()
            units = Cut.end_to_end(_whole(row["data"]), _unpacked(row["lengths"]).astype(np.int64))
            codes, new = seen.numbers(units.hashes())
            if len(new):
                lengths, flat = encoder(units, new)
                sizes, ids = [np.concatenate([*sizes, lengths])], [np.concatenate([*ids, flat])]
            got, each = gathered(codes, sizes[0], ids[0])
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "stamp": [row["stamp"]], "places": [row["places"]], "lengths": [_packed(each)], "data": [_packed(got)]}, schema=ENCODED)


ENCODED = pa.schema([("block", pa.int64()), ("stamp", pa.int64()), ("places", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])
UNSTABLE = "the documents changed between two reads; give encode() a checkpoint of them"
TABLE = pa.schema([("block", pa.int64()), ("id", pa.int32()), ("lengths", pa.binary()), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("codes", pa.binary())])
TABLE_SQL = "block long, id int, lengths binary, data binary, doc_ids array<long>, sizes binary, codes binary"


@tidy
def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, encoded buckets first -> for each block a row per distinct id, then one with the ids of its table of
    units (lengths, data, by place) and its documents."""
    now, parts, stamp = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != now:
                now, parts, stamp = row["block"], [], None
            if row["kind"] == 0:
                if parts and row["stamp"] != stamp:
                    raise RuntimeError(UNSTABLE)
                stamp = row["stamp"]
                parts.append((np.cumsum(_unpacked(row["places"]), dtype=np.int64), _unpacked(row["lengths"]).astype(np.int64), _unpacked(row["data"])))
                continue
            places = np.concatenate([p for p, _, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
            lengths = np.concatenate([n for _, n, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
            data = np.concatenate([d for _, _, d in parts]) if parts else np.zeros(0, dtype=np.uint32)
            by_place = np.argsort(places)
            if (parts and row["stamp"] != stamp) or not (places[by_place] == np.arange(len(places))).all():
                raise RuntimeError(UNSTABLE)
            flat, each = gathered(by_place, lengths, data)
            ids = np.unique(data).astype(np.int32)
            parts = places = lengths = data = by_place = None
            yield pa.RecordBatch.from_pydict({"block": np.full(len(ids), now), "id": ids, **{f.name: pa.nulls(len(ids), f.type) for f in list(TABLE)[2:]}}, schema=TABLE)
            yield pa.RecordBatch.from_pydict({"block": [now], "id": [None], "lengths": [_packed(each)], "data": [_packed(flat)], "doc_ids": [row["doc_ids"]], "sizes": [row["sizes"]], "codes": [row["codes"]]}, schema=TABLE)
            parts, flat, each = [], None, None


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text -> rows of blocks, to be read in their order: first one per distinct id of the block with its piece, then
    one with the ids of the block's units and its documents as positions among them.

    docs is read twice and must give the same rows in the same order both times, as a scan of files does; a change
    stops the run. Give ``cut(docs)`` where that does not hold.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        source = f.read()
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(source)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    buckets = max(16, min(MOST_BUCKETS, docs.count() // BUCKET_DOCS))
    units = docs.mapInArrow(lambda batches: _split_units(batches, buckets), UNITS_SQL).repartition("bucket").sortWithinPartitions("bucket")
    ids = units.mapInArrow(lambda batches: _encoded_buckets(batches, shared.value), "block long, stamp long, places binary, lengths binary, data binary")
    texts = docs.mapInArrow(_split_texts, TEXTS_SQL)
    none = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    rows = ids.select("block", "stamp", F.lit(0).alias("kind"), "places", "lengths", "data", *none(doc_ids="array<long>", sizes="binary", codes="binary")).unionByName(texts.select("block", "stamp", F.lit(1).alias("kind"), *none(places="binary", lengths="binary", data="binary"), "doc_ids", "sizes", "codes"))
    tables = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_tables, TABLE_SQL)
    pieces = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(pieces_of(source))], "id int, piece binary")
    return tables.join(F.broadcast(pieces), "id", "left")  # a map over tables: the vocabulary's size is fixed


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of encode(), in its order -> (doc_id, ids as uint32, the pieces by id) of each document."""
    now, pieces = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != now:
                now, pieces = row["block"], {}
            if row["id"] is not None:
                pieces[row["id"]] = row["piece"]
            else:
                yield from _rows(row, _unpacked(row["lengths"]).astype(np.int64), _unpacked(row["data"]), pieces)


def _rows(row: dict, size: np.ndarray, data: np.ndarray, pieces: dict) -> Iterator[tuple]:
    codes, n = _unpacked(row["codes"]), _unpacked(row["sizes"])
    ends = np.cumsum(n, dtype=np.int64)
    ids = row["doc_ids"]
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + 100_000)))
        low, high = int(ends[at] - n[at]), int(ends[to - 1])
        got, each = gathered(codes[low:high], size, data)
        per = np.add.reduceat(np.append(each, 0), np.minimum(ends[at:to] - n[at:to] - low, len(each))) if high > low else np.zeros(to - at, dtype=np.int64)
        per = np.where(n[at:to] > 0, per, 0)
        for doc_id, x in zip(ids[at:to], np.split(got, np.cumsum(per)[:-1])):
            yield doc_id, x, pieces
        at = to


def round_trip(encoded: DataFrame) -> DataFrame:
    """encode()'s rows -> doc_id, n_tokens, ids_sha256, decoded_sha256."""

    @tidy
    def digests(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        rows, table, last = [], None, None
        for doc_id, ids, pieces in _documents(batches):
            if pieces is not last:
                last, names = pieces, np.array(sorted(pieces), dtype=np.int64)
                size = int(names.max()) + 1 if len(names) else 0
                table, numbers = np.empty(size, dtype=object), np.empty(size, dtype=object)
                for i in names.tolist():
                    table[i], numbers[i] = pieces[i], b"%d," % i
            text = b"".join(table[ids].tolist()).decode("utf-8", "replace").encode()
            rows.append((doc_id, len(ids), hashlib.sha256(b"".join(numbers[ids].tolist())[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return encoded.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(encoded: DataFrame) -> DataFrame:
    """encode()'s rows -> doc_id, ids, text (decoded from the ids' pieces)."""

    def texts(batches):
        for doc_id, ids, pieces in _documents(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.astype(np.int32).tolist()], pa.list_(pa.int32())), "text": [b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")]})

    return encoded.mapInArrow(texts, "doc_id long, ids array<int>, text string")


def op10(spark, sf_dir: str) -> DataFrame:
    return round_trip(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
