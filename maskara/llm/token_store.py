"""Token ids in binary files with Elias-Fano document boundaries.

A file holds a run of documents in ascending order of doc_id: their ids end to end (16 bits each if the vocabulary
allows, else 32), and two ascending sequences, the documents' token boundaries and their doc_ids, as Elias-Fano
codes: of n numbers below u each keeps its low log2(u / n) bits as they are, and the rest in unary, in n + u / 2**low
bits. A sample of the positions of every ``SAMPLE``-th one lets ``select`` find a boundary by reading a few words, so
about 2 + log2(u / n) bits a document replace a table of 64-bit offsets.

Layout, little-endian: ``HEADER`` (magic, version, bytes an id, documents, tokens, null doc_ids, which come first),
then for the boundaries and for the doc_ids ``SECTION`` (first number, count, low bits, bytes of low bits, of high
bits and of the sample) and those three arrays, then the ids.

Files are the ``file`` column of a Parquet table in the given folder, a row a file, keyed by (shard, part): so Spark's
committer writes them, once each even if tasks are repeated, to any store that Spark reaches. ``export`` copies them
out as plain files where the folder is mounted.

Documents go to shards by ranges of doc_id, and a shard is cut into files of about ``FILE_TOKENS``, so no task holds
more than a file and a slice of text. Rows of one doc_id, or of none, that fill several shards are dealt among them by a
hash of the text. Ids come from the tokenizers library, each distinct unit (``units.py``) being encoded once a worker
while its table has room; the table outlives a task and goes when another operator's task starts.

Nulls and odd rows: a null text is encoded as empty, to the end id alone; a null doc_id sorts first; repeated doc_ids
stand next to each other, ordered by a hash of their text. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import UnitEncoder, default_tokenizer
from .store import bounded_batches, scratch, small
from .units import Cut, Places, by_bytes, kept, tidy

END_ID = 2
#: Documents in a shard, about; most shards (beyond, they hold more documents; a task holds one file of them at a time); tokens in a file, about.
SHARD_DOCS, MOST_SHARDS, FILE_TOKENS = 8192, 65_536, 500_000
#: Bytes of text cut at a time; distinct units that a worker keeps.
SLICE_BYTES = 1_500_000
KEPT_UNITS = 1_200_000
#: Every so many ones the position is stored.
SAMPLE = 256
#: The table of files is written as it is (its bits hardly compress) and in pages and row groups of a few files: a page has 100 rows at least otherwise, 100 MB, and the
#: codec keeps buffers of that size outside the heap, in each writing and each reading task.
PAGES = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}
#: Rows up to which the table of files is broadcast.
BROADCAST_FILES = 100_000

HEADER = struct.Struct("<4sHHQQQ")
SECTION = struct.Struct("<qQBQQQ")
MAGIC, VERSION = b"EFT1", 1


class EliasFano:
    """An ascending sequence of integers."""

    def __init__(self, first: int, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.first, self.n, self.low_bits, self.low, self.high, self.sample = first, n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        first = int(values[0]) if n else 0
        v = values.astype(np.uint64) - np.uint64(first & (2**64 - 1))  # differences of 64-bit integers fit in 64 bits
        spread = int(v[-1]) if n else 0
        low_bits = max(0, (spread // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1) if low_bits else np.zeros((n, 0))
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0), dtype=bool)
        high[ones] = True
        return cls(first, n, low_bits, np.packbits(bits.astype(bool).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4" if not n or ones[-1] < 2**32 else "<u8"))

    def _lows(self, i: int, j: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(j - i, dtype=np.uint64)
        start, stop = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def _wrapped(self, v: np.ndarray) -> np.ndarray:
        return (v + np.uint64(self.first & (2**64 - 1))).view(np.int64)

    def select(self, i: int) -> int:
        """The i-th number, read from the stored position before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample[i // SAMPLE]), i % SAMPLE
        byte, left = at // 8, left + int(np.unpackbits(self.high[at // 8 : at // 8 + 1], bitorder="little")[: at % 8].sum())
        while True:
            counts = np.cumsum(np.bitwise_count(self.high[byte : byte + 64]))
            if counts[-1] > left:
                k = int(np.searchsorted(counts, left, side="right"))
                left -= int(counts[k - 1]) if k else 0
                one = (byte + k) * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte + k : byte + k + 1], bitorder="little"))[left])
                return int(self._wrapped((np.array([one - i], dtype=np.uint64) << np.uint64(self.low_bits)) | self._lows(i, i + 1))[0])
            byte, left = byte + 64, left - int(counts[-1])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        return self._wrapped((ones.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n))

    def to_bytes(self) -> bytes:
        wide = self.sample.dtype.itemsize == 8
        parts = self.low.tobytes(), self.high.tobytes(), self.sample.tobytes()
        return SECTION.pack(self.first, self.n, self.low_bits | 128 * wide, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence at that place, and where it ends."""
        first, n, low_bits, *sizes = SECTION.unpack_from(data, at)
        at += SECTION.size
        ends = np.cumsum([at, *sizes]).tolist()
        low, high, sample = (np.frombuffer(data[i:j], dtype=t) for i, j, t in zip(ends, ends[1:], (np.uint8, np.uint8, "<u8" if low_bits & 128 else "<u4")))
        return cls(first, n, low_bits & 127, low, high, sample), ends[-1]


def pack(doc_ids: list, sizes: np.ndarray, ids: bytes, width: int) -> bytes:
    """A file: doc_ids ascending, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    bounds = EliasFano.of(np.append(0, np.cumsum(sizes)))
    return HEADER.pack(MAGIC, VERSION, width, len(doc_ids), int(np.sum(sizes)), nulls) + bounds.to_bytes() + EliasFano.of(np.array(doc_ids[nulls:], dtype=np.int64)).to_bytes() + ids


class TokenFile:
    """A file's contents: doc_ids, boundaries, and ids by document."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, self.width, self.n, self.tokens, self.nulls = HEADER.unpack_from(view, 0)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token file of this version")
        self.bounds, at = EliasFano.read(view, HEADER.size)
        self._doc_ids, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view[at:], dtype=f"<u{self.width}")

    def doc_ids(self) -> list:
        return [None] * self.nulls + self._doc_ids.all().tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class _Encoder:
    """Ids of texts; keeps those of distinct units, from one task to the next of a worker."""

    def __init__(self, source: str):
        self.encode = UnitEncoder(source)
        self.seen = Places(1 << 16)
        self.starts = np.zeros(1, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype=np.uint32 if len(self.encode.opens) > 1 << 16 else np.uint16)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text)."""
        units = Cut.of(texts)
        if not len(units):
            return np.zeros(0, dtype=self.pool.dtype), np.zeros(len(texts), dtype=np.int64)
        if self.seen.n > KEPT_UNITS:
            self.seen.clear()
        if not self.seen.n:
            self.starts = self.starts[:1].copy()
        rows, new = self.seen.numbers(units.hashes())
        if len(new):
            lengths, flat = self.encode(units, new)
            used = int(self.starts[-1])
            if used + len(flat) > len(self.pool):
                self.pool = np.append(self.pool, np.zeros(used + len(flat) - len(self.pool) + len(self.pool) // 2, dtype=self.pool.dtype))
            self.pool[used : used + len(flat)] = flat
            self.starts = np.append(self.starts, used + np.cumsum(lengths))
        starts = self.starts[rows]
        each = self.starts[rows + 1] - starts
        ends = np.cumsum(each)
        at = np.arange(int(ends[-1]), dtype=np.int64)
        at += np.repeat(starts - (ends - each), each)
        total = np.append(0, ends)
        return self.pool[at], np.diff(total[units.offsets])


def _with_end(ids: np.ndarray, each: np.ndarray, end_id: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(each)
    return np.insert(ids, ends, end_id).astype(dtype), each + 1


def _shards(doc_ids: np.ndarray, nulls: np.ndarray, ties: np.ndarray, cuts: np.ndarray, null_shards: int) -> np.ndarray:
    """Shards ascend with (doc_id, tie), nulls first. A doc_id that several cuts fall on has the shards between them, by the tie."""
    low, high = np.searchsorted(cuts, doc_ids, side="left"), np.searchsorted(cuts, doc_ids, side="right")
    part = ties.astype(np.float64) / 2.0**64 + 0.5
    among = np.minimum((part * (high - low)).astype(np.int64), np.maximum(high - low - 1, 0))
    own = np.where(high - low > 1, low + 1 + among, high)
    return np.where(nulls, np.minimum((part * null_shards).astype(np.int64), max(null_shards - 1, 0)), null_shards + own).astype(np.int32)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes doc_id, text, ends each document with end_id and writes the files' table to the folder."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        source = f.read()
    bounded_batches(docs.sparkSession)
    width = 2 if max(len(UnitEncoder(source).opens), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    shards, null_shards = (min(MOST_SHARDS, -(-x // SHARD_DOCS)) for x in (known, n - known))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    shared = docs.sparkSession.sparkContext.broadcast((source, np.array(cuts or [], dtype=np.int64)))

    @tidy
    def encode(batches):
        source, cuts = shared.value
        encoder = kept("token_store", source, lambda: _Encoder(source))
        schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                ids, each = _with_end(*encoder(part.column("text")), end_id, f"<u{width}")
                doc_ids, ties = part.column("doc_id"), part.column("tie")
                nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
                shard = _shards(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), nulls, ties.to_numpy(), cuts, null_shards)
                at = (np.append(0, np.cumsum(each)) * width).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), doc_ids, ties, binary], schema=schema)

    @partial(tidy, keeps=False)
    def files(batches):
        schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())])
        shard, part, doc_ids, sizes, data, held = None, 0, [], [], [], 0

        def written():
            sizes_ = np.array(sizes, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([int(sizes_.sum())], pa.int64()), pa.array([pack(doc_ids, sizes_, b"".join(data), width)], pa.binary())], schema=schema)

        for batch in batches:
            for s, d, x in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if doc_ids and (s != shard or held >= FILE_TOKENS):
                    yield written()
                    part = part + 1 if s == shard else 0
                    doc_ids, sizes, data, held = [], [], [], 0
                shard = s
                doc_ids.append(d), sizes.append(len(x) // width), data.append(x)
                held += len(x) // width
        if doc_ids:
            yield written()

    encoded = docs.withColumn("tie", F.xxhash64("text")).mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")
    dealt = encoded.repartition(max(shards + null_shards, 1), "shard").sortWithinPartitions("shard", "doc_id", "tie", "ids")
    dealt.select("shard", "doc_id", "ids").mapInArrow(files, "shard int, part int, n_tokens long, file binary").write.mode("overwrite").options(**PAGES).parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """shard, part, start (tokens in the files before), n_tokens, file."""
    stored = spark.read.schema("shard int, part int, n_tokens long, file binary").parquet(folder)
    heads = stored.select("shard", "part", "n_tokens")
    shards = heads.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))  # MOST_SHARDS rows at most
    shards = shards.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("before"))
    inside = heads.withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_tokens"))
    starts = inside.join(F.broadcast(shards), "shard").select("shard", "part", (F.col("before") + F.col("inside")).alias("start"))
    return stored.join(small(starts, BROADCAST_FILES), ["shard", "part"]).select("shard", "part", "start", "n_tokens", "file")


def documents(files: DataFrame) -> DataFrame:
    """read()'s rows -> doc_id, start, n_tokens, ids_crc32."""

    @partial(tidy, keeps=False)
    def rows(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("file")):
                f = TokenFile(data.as_buffer())
                bounds = f.bounds.all()
                ids = f.ids.astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(), pa.int64()), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("start", "file").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> DataFrame:
    """Writes every file under a mounted folder, as shard-part.eft by rename; returns their names and sizes."""

    def copies(batches) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            names, sizes = [], []
            for s, p, data in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), batch.column("file")):
                name = f"{s:05d}-{p:06d}.eft"
                with open(other := f"{folder}/.{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data.as_buffer())
                os.replace(other, f"{folder}/{name}")
                names.append(name), sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    return files.select("shard", "part", "file").mapInArrow(copies, "name string, bytes long")


def op9(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return documents(read(spark, folder))
