"""A grid of settings as bits. What holds under a setting is one bit of a word, so a fold runs once an image, whatever the number of settings,
and totals are sums over the few distinct words that come of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Settings in a word.
WORD = 62
NONE = "array<bigint>"


def words(grid: DataFrame) -> tuple[DataFrame, list[list]]:
    """The grid (a bounded relation of parameters) with ``_word`` and ``_bit``, and the rows of each word."""
    rows = grid.collect()
    table = grid.sparkSession.createDataFrame([(i // WORD, i % WORD, *r) for i, r in enumerate(rows)], "_word int, _bit int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema))
    return table, [rows[i : i + WORD] for i in range(0, max(len(rows), 1), WORD)]


def long(n: int) -> Column:
    return F.lit(n).cast("long")


def where(values: Sequence, holds: Callable) -> Column:
    """The bits of the settings whose value holds; a value is tested once, however many settings have it. None holds for none."""
    bits: dict = {}
    for i, v in enumerate(values):
        if v is not None:
            bits[v] = bits.get(v, 0) | 1 << i
    out = long(0)
    for v, b in bits.items():
        out = out.bitwiseOR(F.when(holds(F.lit(v)), long(b)).otherwise(long(0)))
    return out


def any_of(items: Column, bits: Callable) -> Column:
    """The union of the elements' bits; 0 for null."""
    return F.coalesce(F.aggregate(items, long(0), lambda a, x: a.bitwiseOR(bits(x))), long(0))


def less(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def won(pairs: Column) -> Column:
    """Greedy matching of (p, t, bits), pairs at the threshold by place of their prediction, then falling IoU; bits: where the prediction takes part. The bits under
    which each pair is matched: neither its prediction nor its truth was before."""
    kind = "array<struct<p: int, t: int, bits: bigint>>"

    def step(done, x):
        gone = any_of(F.filter(done, lambda d: (d["p"] == x["p"]) | (d["t"] == x["t"])), lambda d: d["bits"])
        return F.array_append(done, F.struct(x["p"].alias("p"), x["t"].alias("t"), less(x["bits"], gone).alias("bits")))

    return F.transform(F.aggregate(pairs.cast(kind), F.array().cast(kind), step), lambda d: d["bits"])


def per_setting(rows: DataFrame, table: DataFrame, columns: list[str], lists: dict[str, list[str]]) -> DataFrame:
    """The columns of each row under each setting, with counts: of the elements of an array (``lists``: its column for each word) how many have the setting's bit."""
    wide = rows.crossJoin(F.broadcast(table))
    count = lambda names: F.size(F.filter(F.get(F.array(*names), F.col("_word")), lambda b: F.getbit(b, F.col("_bit")) == 1))
    return wide.select(*columns, *(c for c in table.columns if c not in ("_word", "_bit")), *(count(names).alias(k) for k, names in lists.items()))


def totals(rows: DataFrame, table: DataFrame, by: list[str], lists: dict[str, list[str]]) -> DataFrame:
    """``by`` (columns of rows or of the grid), sums of the counts of ``per_setting`` and of n_gt, and images. Rows give each word of bits once; what is
    spread over the settings is the number of each distinct word."""
    keys = [c for c in by if c in rows.columns]
    kinds = list(lists)
    entry = lambda w, n, images, kind, b: F.struct(F.lit(w).alias("_word"), F.lit(kind).alias("_kind"), b.alias("_bits"), n.cast("long").alias("n_gt"), F.lit(images).alias("images"))
    parts = []
    for w in range(len(lists[kinds[0]])):
        parts.append(F.array(entry(w, F.col("n_gt"), 1, -1, long(0))))
        parts += [F.transform(lists[k][w], lambda b: entry(w, long(0), 0, i, b)) for i, k in enumerate(kinds)]
    each = rows.select(*keys, F.explode_outer(F.concat(*parts)).alias("e")).select(*keys, "e.*").filter("_kind < 0 OR _bits <> 0")
    few = each.groupBy(*keys, "_word", "_kind", "_bits").agg(F.count("*").alias("n"), F.sum("n_gt").alias("n_gt"), F.sum("images").alias("images"))
    own = lambda i: F.sum(F.when(F.col("_kind") == i, F.col("n") * F.getbit("_bits", F.col("_bit")))).cast("long")
    return few.join(F.broadcast(table), "_word").groupBy(*by).agg(*(F.coalesce(own(i), long(0)).alias(k) for i, k in enumerate(kinds)), F.sum("n_gt").alias("n_gt"), F.sum("images").alias("images"))
