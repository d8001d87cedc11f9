"""Cross-site boilerplate: lines that many sites carry are kept in one document and removed elsewhere.

A line is what stands between line feeds, trimmed of spaces, tabs and carriage returns. Its spread is the number
of distinct sites (``source``) it occurs in. One HyperLogLog sketch per line key gathers the sites by partial
aggregation, so a line that a third of all rows carry is a few sketches per key, not a group of rows. A line whose
estimate is far from ``min_sites`` is decided by it; near the threshold (from half to twice) the sites are
counted exactly. The lines found are broadcast if they are few, and documents are rewritten where they stand; else
positions to remove are joined to documents by a 128-bit hash of doc_id and text. A line that is not blank, of at least ``min_chars``
characters and ``min_sites`` sites, is boilerplate: its first occurrence, in the smallest doc_id, stays, so that no text leaves
the corpus for good; all others go.

Nulls and odd rows: a null text has no lines and stays null; a null source counts as no site; a null doc_id sorts
first. Rows that share a doc_id, or have none, are one document: a line stays in each of them that has it at the position
that stays. A text all of whose lines go becomes empty, the row stays. An empty table gives an empty result. Further columns
pass through; the new one gets a longer name where its own is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .store import bounded_batches, cut, free, small
from .units import tidy

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 4
#: Least characters of a line: all but blank ones.
MIN_CHARS = 1
#: log2 of the registers of a sketch.
LG_K = 8
#: Boilerplate lines up to which their table is broadcast (under 200 bytes a line); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
NEW = StructType().add("text", StringType()).add("gone", LongType())


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def row_key() -> list:
    """Two hashes of 64 bits of doc_id and text: rows with the same key lose the same lines."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2")]


def line_rows(docs: DataFrame, min_chars: int, *key) -> DataFrame:
    """doc_id, site, pos, h1, h2 and the key's columns: a row per line that is long enough; two hashes of 64 bits make its key."""
    lines = docs.select("doc_id", F.col("source").cast("string").alias("site"), *key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", trimmed(F.col("line"))).filter(F.length("line") >= min_chars)
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line")).drop("line")


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """h1, h2, first: the lines spread over min_sites or more, and (doc_id, pos) of their first occurrence."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    spread = spread.filter(F.col("n") >= min_sites).withColumn("about", F.hll_sketch_estimate("sites")).filter(F.col("about") >= min_sites / 2)
    spread = cut(spread.select("h1", "h2", "first", "about"))
    near = small(spread.filter(F.col("about") <= 2 * min_sites).select("h1", "h2"), BROADCAST_ROWS)
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact")).filter(F.col("exact") >= min_sites)
    sure = spread.filter(F.col("about") > 2 * min_sites).select("h1", "h2")
    return cut(spread.join(exact.select("h1", "h2").unionByName(sure), ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def removals(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """k1, k2, gone: the positions of the lines that go, one row per text that loses any."""
    hits = lines.join(spread, ["h1", "h2"]).filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    return hits.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))


def _without(text: str, gone) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _rewritten(at: list, n: int) -> pa.StructArray:
    """at: (row, new text, lines gone) of the rows that change."""
    text, gone = [None] * n, [0] * n
    for i, t, g in at:
        text[i], gone[i] = t, g
    return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(gone, pa.int64())], ["text", "gone"])


def _in_map(docs: DataFrame, spread: DataFrame, min_chars: int, at: str) -> DataFrame:
    """docs with a struct ``at`` of the new text (null: as given) and of how many lines went, from the broadcast table of lines."""
    rows = spread.select("h1", "h2", F.col("first.doc_id").cast("long").alias("doc_id"), "first.pos").collect()  # BROADCAST_ROWS at most
    shared = docs.sparkSession.sparkContext.broadcast({(r["h1"], r["h2"]): (r["doc_id"], r["pos"]) for r in rows})

    @F.arrow_udf(NEW)
    @tidy
    def rewrite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, digest = shared.value, xxhash.xxh64_intdigest
        second = digest(b"second", 42)
        first_halves = {a for a, _ in known}

        def signed(x):
            return x - (1 << 64) if x >> 63 else x

        for texts, doc_ids in batches:
            changed = []
            for i, (text, doc_id) in enumerate(zip(texts, doc_ids)):
                t = text.as_py()
                gone = set()
                for pos, line in enumerate(t.split("\n") if t and known else ()):
                    line = line.strip(" \t\r")
                    if len(line) >= min_chars and (a := signed(digest(raw := line.encode(), 42))) in first_halves:
                        first = known.get((a, signed(digest(raw, second))))
                        if first and first != (doc_id.as_py(), pos):
                            gone.add(pos)
                if gone:
                    changed.append((i, _without(t, gone), len(gone)))
            yield _rewritten(changed, len(texts))

    return docs.withColumn(at, rewrite("text", F.col("doc_id").cast("long")))


def _by_shuffle(docs: DataFrame, spread: DataFrame, min_chars: int, at: str) -> DataFrame:
    """The same, where the table of lines is too large to broadcast: positions meet documents by their key."""

    @F.arrow_udf(NEW)
    @tidy
    def rewrite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            rows = zip(texts.to_pylist(), gone.to_pylist())
            yield _rewritten([(i, _without(t, set(g)), len(g)) for i, (t, g) in enumerate(rows) if t is not None and g], len(texts))

    gone = removals(line_rows(docs, min_chars, *row_key()), spread)
    row = free(docs, "_row")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), *row_key())
    both = keyed.join(gone, ["k1", "k2"], "left").select(f"{row}.*", F.col("gone").alias(at))
    return both.withColumn(at, rewrite(F.when(F.col(at).isNotNull(), F.col("text")), F.col(at)))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, broadcast_rows: int = BROADCAST_ROWS, removed: str = "_removed") -> DataFrame:
    """docs with text rewritten, and, as the last column, ``removed``: how many lines went."""
    bounded_batches(docs.sparkSession)
    removed = free(docs, removed)
    spread = boilerplate(line_rows(docs, min_chars), min_sites)
    at = free(docs, "_new")
    new = _in_map(docs, spread, min_chars, at) if spread.limit(broadcast_rows + 1).count() <= broadcast_rows else _by_shuffle(docs, spread, min_chars, at)
    return new.withColumn("text", F.coalesce(f"{at}.text", "text")).withColumn(removed, F.col(f"{at}.gone")).drop(at)


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_removed of the given text, n_chars and text_md5 of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = drop_boilerplate(docs.withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, E'\\n') AS l FROM documents
), lines AS (
  SELECT rid, doc_id, source, i - 1 AS pos, l[i] AS line, trim(l[i], E' \\t\\r') AS bare FROM (SELECT rid, doc_id, source, l, unnest(generate_series(1, len(l))) AS i FROM d)
), spread AS (
  SELECT bare, min((coalesce(doc_id, -9223372036854775807), pos)) AS first FROM lines WHERE length(bare) >= 1 GROUP BY bare HAVING count(DISTINCT source) >= 4
), marked AS (
  SELECT lines.*, spread.bare IS NOT NULL AND (coalesce(lines.doc_id, -9223372036854775807), lines.pos) <> spread.first AS gone FROM lines LEFT JOIN spread ON lines.bare = spread.bare
), per AS (
  SELECT rid, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, coalesce(string_agg(line, E'\\n' ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY rid
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(per.text)::BIGINT AS n_chars, md5(per.text) AS text_md5
FROM d LEFT JOIN per ON d.rid = per.rid
"""
