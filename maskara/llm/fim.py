"""Fill-in-middle transformation of whole texts, cut at token boundaries.

A token is white space with the other characters that follow it (or white space at the end), so a token ends wherever a
character other than white space stands before white space, and at the end of the text. Texts are laid out in chunks that
overlap by the byte before them: that predicate of adjacent bytes is counted in each chunk by itself, prefix sums over a
text's chunks tell which chunk owns the boundary of a given rank, and only the chunks that own a cut are scanned again for its
place. White space is ASCII, so bytes of UTF-8 do; places are turned into code points by the same sums over
continuation bytes. Nothing is shuffled, and a task holds a slice of texts (one row at least) and a block of flags.

Nulls and odd rows: a null text is an empty one; an empty text, and one that holds a mark, stays plain; a null doc_id hashes
as the empty string; equal rows give equal rows; other columns pass through, whatever their names. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import units
from .store import bounded_batches, free

#: Bytes of a chunk, of a block of chunks that are looked at together, and of texts in a slice.
CHUNK, BLOCK, SLICE = 4096, 1 << 20, 4 << 20
#: The marks before prefix, suffix and middle; the seed; percent of texts that change, and of these in suffix-prefix-middle form.
MARKS, SEED, RATE, SPM = ("<P>", "<S>", "<M>"), 42, 50, 80
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOUND = StructType([StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")])


class Chunks:
    """Texts end to end, their chunks, and sums over these."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        size = np.diff(offsets)
        each = -(-size // CHUNK)
        self.first = np.append(0, np.cumsum(each))  # of each text
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], each)
        self.starts = np.repeat(offsets[:-1], each) + inside * CHUNK
        self.ends = np.minimum(self.starts + CHUNK, np.repeat(offsets[1:], each))
        bounds, inner = np.zeros(len(self.starts), dtype=np.int64), np.zeros(len(self.starts), dtype=np.int64)
        begins = offsets[:-1][size > 0]
        for at in range(0, len(data), BLOCK):
            upto = min(at + BLOCK, len(data))
            flags = self._ends_before(at, upto)
            flags[begins[np.searchsorted(begins, at) : np.searchsorted(begins, upto)] - at] = False
            for total, found in ((bounds, flags), (inner, (data[at:upto] & 0xC0) == 0x80)):
                chunk, n = np.unique(np.searchsorted(self.starts, np.flatnonzero(found) + at, "right") - 1, return_counts=True)
                total[chunk] += n
        self.bounds, self.chars = np.append(0, np.cumsum(bounds)), np.append(0, np.cumsum(self.ends - self.starts - inner))
        self.tokens = self.bounds[self.first[1:]] - self.bounds[self.first[:-1]] + (size > 0)

    def _ends_before(self, at: int, upto: int) -> np.ndarray:
        """Whether a token ends before each of those bytes, as far as it and the byte before tell."""
        white = _WHITE[self.data[max(at - 1, 0) : upto]]
        if not at:
            white = np.append(True, white)
        return white[1:] & ~white[:-1]

    def cuts(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """How many code points of each of those texts its first ``rank`` tokens hold."""
        out = np.where(ranks >= self.tokens[texts], self.chars[self.first[texts + 1]] - self.chars[self.first[texts]], 0)
        inner = np.flatnonzero((ranks > 0) & (ranks < self.tokens[texts]))
        rank = ranks[inner] + self.bounds[self.first[texts[inner]]]
        owner = np.searchsorted(self.bounds, rank) - 1
        order = np.argsort(owner, kind="stable")
        last = -1
        for i, chunk, k in zip(inner[order].tolist(), owner[order].tolist(), rank[order].tolist()):
            if chunk != last:
                last, start = chunk, int(self.starts[chunk])
                flags = self._ends_before(start, int(self.ends[chunk]))
                flags[0] &= start != self.offsets[texts[i]]
                places = np.flatnonzero(flags)
            place = places[k - self.bounds[chunk] - 1]
            before = int(np.count_nonzero((self.data[start : start + place] & 0xC0) != 0x80))
            out[i] = self.chars[chunk] - self.chars[self.first[texts[i]]] + before
        return out


def _found(batch: pa.RecordBatch) -> pa.Array:
    """text, a, b, plain -> FOUND of each row: a and b modulo the tokens and one more are the ranks of the cuts."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    _, at, values = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    chunks = Chunks(data, offsets - offsets[0])
    n = chunks.tokens
    a, b = (batch.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in "ab")
    plain = batch.column("plain").to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(~plain)
    low = chunks.cuts(rows, np.minimum(a, b)[rows])
    high = chunks.cuts(rows, np.maximum(a, b)[rows])
    prefix, middle = np.zeros((2, len(n)), dtype=np.int64)
    prefix[rows], middle[rows] = low, high - low
    return pa.StructArray.from_arrays([pa.array(n), pa.array(prefix, mask=plain), pa.array(middle, mask=plain)], ["n", "prefix_chars", "middle_chars"])


@F.arrow_udf(FOUND)
def _cut(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, a, b, plain in columns:
        batch = pa.RecordBatch.from_arrays([text, a, b, plain], ["text", "a", "b", "plain"])
        parts = [_found(part) for part in units.by_bytes(batch, "text", SLICE)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]))


def fill_in_middle(docs: DataFrame, at: str, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs (doc_id, text, ...) with a column ``at``: struct of n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``at`` must be a name that docs doesn't have (``store.free`` gives one). The forms and ranks of the cuts are those of
    the first four 32-bit groups of the sha256 of seed and doc_id.
    """
    bounded_batches(docs.sparkSession)
    p, s, m = marks
    work = free(docs, "_fim")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m)) | (group(2) % 100 >= rate)
    drawn = docs.withColumn(work, F.struct(text.alias("text"), group(0).alias("a"), group(1).alias("b"), plain.alias("plain"), (group(3) % 100 < spm).alias("spm")))
    w = lambda c: F.col(f"{work}.{c}")
    cut = drawn.withColumn(at, _cut(w("text"), w("a"), w("b"), w("plain")))
    n, first, second = (F.col(f"{at}.{c}") for c in ("n", "prefix_chars", "middle_chars"))
    prefix, middle = F.substring(w("text"), F.lit(1), first.cast("int")), F.substring(w("text"), (first + 1).cast("int"), second.cast("int"))
    suffix = F.substring(w("text"), (first + second + 1).cast("int"), F.length(w("text")))
    form = F.when(w("plain"), "plain").when(w("spm"), "spm").otherwise("psm")
    output = F.when(w("plain"), w("text")).when(w("spm"), F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
    return cut.withColumn(at, F.struct(n.alias("n"), form.alias("form"), first.alias("prefix_chars"), second.alias("middle_chars"), output.alias("output"))).drop(work)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of that form was made from: neither a part nor the seams hold a mark but those put there."""
    p, s, m = marks
    after = lambda x, head: F.substring(x, F.length(head) + 1, F.length(x))

    def halves(x: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(x, mark, 1)
        return head, after(x, F.concat(head, F.lit(mark)))

    first, rest = halves(after(output, F.lit(p)), s)  # both first marks have the place of one
    second, middle = halves(rest, m)
    suffix, rest = halves(after(output, F.lit(s)), p)
    prefix, last = halves(rest, m)
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(prefix, last, suffix)).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs, "fim")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    f = lambda c: F.col(f"fim.{c}")
    return out.select("doc_id", f("n").alias("n"), f("form").alias("form"), f("prefix_chars").alias("prefix_chars"), f("middle_chars").alias("middle_chars"), sha(f("output")).alias("output_sha256"), sha(restored(f("output"), f("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS b, array_to_string(u[j + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(a || b || z) AS restored_sha256
FROM p"""
