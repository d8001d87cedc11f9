"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document is due ``target / source size`` expected copies. The whole part
is allocated for certain. For the rest, p, each document has inclusion odds of its own, p / (1 - p) times the square root of
its size over the source's mean size, so that longer documents are likelier; its random odds are u / (1 - u), and the
source's documents are ranked by random odds over inclusion odds. The sample, of a fixed size in words, is the prefix of that
ranking whose words come nearest to what the certain copies leave of the target.

The ranking is never gathered in one task: a source is cut into ranges of the rank of about ``RANGE_DOCS`` documents, words
are summed by range, and only the one range that the cut falls in is looked at row by row. What results is a plan of one
row per source; applying it to documents is a map, which never moves text. Sources can be as many as sites: they are
numbered by ranges of their name, and the level at which targets stop at their cap is found from sums of ranges.

Nulls and odd rows: a null text has 0 words and is never worth a copy; null is a source of its own, the last; a
null doc_id has a u of its own. Rows that share source, doc_id and size are one unit: the sample takes all or none.
u depends on doc_id and ``seed`` alone, so reruns agree. An empty table gives an empty plan. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import cut, free, small

#: Weights in the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words.
TOTAL_SHARE = 1.5
#: Most copies of a document.
MOST = 2
#: Documents in a range of u, about.
RANGE_DOCS = 4096
#: Sources up to which the plan is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Count of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), from the first 52 bits of a hash of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def odds(doc_id: Column, size: Column, mean: Column, p: Column, seed: int) -> Column:
    """Random odds over inclusion odds, for documents with words."""
    u = uniform(doc_id, seed)
    return (u / (1 - u)) / ((p / (1 - p)) * F.sqrt(size / mean))


def rank_range(odds: Column, p: Column, ranges: Column) -> Column:
    """The range of the rank: as p is one number in a source, odds without it spread over the ranges much like u does."""
    z = odds * (p / (1 - p))
    return F.floor(z / (1 + z) * ranges)


def numbered(rows: DataFrame, *order: Column, at: str) -> DataFrame:
    """rows with their place in that order, from 0; no task has more than a range of them, unless they are few."""
    rows = cut(rows)
    if rows.count() <= RANGE_DOCS:
        return rows.withColumn(at, F.row_number().over(Window.orderBy(*order)) - 1)
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    ahead, total = [(-1, 0)], 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # a row a partition
        ahead.append((r["p"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(ahead, "_p long, _before long")
    return placed.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(at, F.col("_before") + inside).drop("_at", "_p", "_before")


def level(weighed: DataFrame, total: float, buckets: int = 256, most: int = 1024) -> tuple[float, int]:
    """(words, weights) that are left for the sources whose target does not stop at its cap.

    Sources stop in the order of cap over weight, and all up to some ratio do exactly if what is left per weight after
    them is no less than that ratio. So sums by ranges of the ratio tell which range that level is in, and it is cut again
    until it has few distinct ratios.
    """
    by_ratio = cut(weighed.groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")))
    caps, weights = 0, int(by_ratio.agg(F.sum("weight")).first()[0] or 0)

    def after(rows):
        """Passes over the rows, in order, all of whose sources stop; the first other one."""
        nonlocal caps, weights
        for r in rows:
            if weights == r["weight"] or (total - (caps + r["cap"])) / (weights - r["weight"]) < r["high"]:
                return r
            caps, weights = caps + r["cap"], weights - r["weight"]
        return None

    now = by_ratio
    while True:
        if now.limit(most + 1).count() <= most:
            after(now.withColumn("high", F.col("ratio")).orderBy("ratio").collect())  # ``most`` rows at most
            return total - caps, weights
        cuts = sorted(set(now.agg(F.percentile_approx("ratio", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]))
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("ratio")))
        ranges = now.groupBy(bucket.alias("b")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("ratio").alias("high"), F.min("ratio").alias("low"))
        hit = after(ranges.orderBy("b").collect())  # ``buckets`` rows
        if hit is None:
            return total - caps, weights
        now = now.filter(F.col("ratio").between(hit["low"], hit["high"]))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, most=MOST) -> DataFrame:
    """source, n_docs, source_size -> the same and target.

    Targets share ``total_share`` of all words by weight and stop at ``most`` times the source's size, the excess
    reshared by weight until none is above.
    """
    named = numbered(sizes.select("source", "n_docs", "source_size"), F.col("source").asc_nulls_last(), at="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(named.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")).drop("place"))
    words, left = level(weighed, total_share * (weighed.agg(F.sum("source_size")).first()[0] or 0))
    share = F.col("weight") * F.lit(float(words)) / F.lit(float(left or 1))
    return weighed.select("source", "n_docs", "source_size", F.when(F.lit(left == 0) | (share >= F.col("cap")), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(words: DataFrame, seed: int = 7, **how) -> DataFrame:
    """source, doc_id, size -> a row per source: source, source_size, target, copies (certain ones), p, mean, ranges and the cut.

    A document with words gets one copy more if its range of the rank is below cut_range, or if it is in that range and its
    (odds, doc_id, size) is at most (cut_odds, cut_id, cut_size), nulls of doc_id first.
    """
    sources = targets(words.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), **how)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("copies", F.floor(ratio)).withColumn("p", ratio - F.col("copies")).withColumn("open_words", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n_docs") / RANGE_DOCS)).withColumn("mean", F.col("source_size") / F.col("n_docs"))
    sources = cut(sources)
    near = small(sources.filter("p > 0").select("source", "p", "mean", "open_words", "ranges"), BROADCAST_SOURCES)
    units = words.filter("size > 0").groupBy("source", "doc_id", "size").agg((F.col("size") * F.count("*")).alias("words"))
    ranked = units.alias("w").join(near.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source"))).select("w.source", "doc_id", "size", "words", odds(F.col("doc_id"), F.col("size"), F.col("mean"), F.col("p"), seed).alias("odds"), "p", "ranges", "open_words")
    ranked = ranked.withColumn("range", rank_range(F.col("odds"), F.col("p"), F.col("ranges"))).drop("p", "ranges")
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.groupBy("source", "range").agg(F.sum("words").alias("words"), F.first("open_words").alias("open_words")).withColumn("before", F.coalesce(F.sum("words").over(by_range), F.lit(0)))
    hit = cut(sums.filter("before < open_words and before + words >= open_words").select("source", "range", "before"))
    by_odds = Window.partitionBy("r.source").orderBy("odds", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranked.alias("r").join(small(hit, BROADCAST_SOURCES).alias("h"), F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r.range") == F.col("h.range"))).select("r.source", "doc_id", "size", "words", "odds", "open_words", (F.col("before") + F.coalesce(F.sum("words").over(by_odds), F.lit(0))).alias("ahead"))
    taken = inside.filter(F.col("ahead") + F.col("words") / 2 <= F.col("open_words"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("odds", F.col("doc_id").isNotNull().alias("has"), "doc_id", "size")).alias("cut"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    ends = sources.alias("s").join(hit.alias("h"), same("s", "h"), "left").select("s.*", F.coalesce("h.range", F.lit(-1)).alias("cut_range"))
    return cut(ends.alias("s").join(cuts.alias("c"), same("s", "c"), "left").select("s.source", "source_size", "target", "copies", "p", "mean", "ranges", "cut_range", F.coalesce("cut.odds", F.lit(-1.0)).alias("cut_odds"), F.col("cut.doc_id").alias("cut_id"), F.col("cut.size").alias("cut_size")))


def with_copies(docs: DataFrame, made: DataFrame, seed: int = 7, size: str = "size") -> DataFrame:
    """docs, which have their size as a column, with _source_size, _target and _copies (long) from a plan; a map over docs while the plan is small.

    docs must not have columns of these names.
    """
    d, n, m = F.col("d.doc_id"), F.col(f"d.{size}"), lambda c: F.col(f"m.{c}")
    own = F.when((n > 0) & (m("p") > 0), odds(d, n, m("mean"), m("p"), seed))
    within = rank_range(own, m("p"), m("ranges"))
    tied = F.when(d.isNull() & m("cut_id").isNull(), n <= m("cut_size")).when(d.isNull(), F.lit(True)).otherwise((d < m("cut_id")) | ((d == m("cut_id")) & (n <= m("cut_size"))))
    below = (within < m("cut_range")) | ((within == m("cut_range")) & ((own < m("cut_odds")) | ((own == m("cut_odds")) & F.coalesce(tied, F.lit(False)))))
    return docs.alias("d").join(small(made, BROADCAST_SOURCES).alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")), "left").select("d.*", m("source_size").alias("_source_size"), m("target").alias("_target"), (F.coalesce(m("copies"), F.lit(0)) + F.when(below, 1).otherwise(0)).cast("long").alias("_copies"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: what the plan needs, without the text, computed once."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns as given.

    Documents without words are worth no copy and are left out.
    """
    made = plan(measured(docs), seed, **how)
    row = free(docs, "_row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), "doc_id", "source", n_words(F.col("text")).alias("_size"))
    chosen = with_copies(whole.filter("_size > 0"), made, seed, "_size")
    return chosen.select(row, F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")).select(f"{row}.*")


def op7(spark, sf_dir: str) -> DataFrame:
    words = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_copies(words, plan(words)).select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


#: The hash bits of uniform() in SQL: thirteen hexadecimal digits, summed by place.
ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), units AS (
  SELECT source, doc_id, size, (size * count(*))::BIGINT AS words,
    list_sum(list_transform(range(1, 14), lambda i: (strpos('0123456789abcdef', substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), i, 1)) - 1)::BIGINT * (16::BIGINT ** (13 - i))::BIGINT))::DOUBLE / 4503599627370496.0 AS u
  FROM w GROUP BY source, doc_id, size
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE / count(*) AS mean, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM w GROUP BY source
), s1 AS (
  SELECT *, 2 * source_size AS cap,
    1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS words_left,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS weight_left
  FROM s0
), s2 AS (
  SELECT *, weight * words_left / weight_left >= cap AS capped FROM s1
), s3 AS (
  SELECT source, source_size, mean, CASE WHEN capped THEN cap::DOUBLE ELSE weight
    * (SELECT arg_max(words_left, weight_left) FROM s2 WHERE NOT capped) / (SELECT max(weight_left) FROM s2 WHERE NOT capped) END AS target FROM s2
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - copies AS p FROM s3
), o AS (
  SELECT units.source, doc_id, size, words, target - copies * source_size AS open_words, (u / (1 - u)) / ((p / (1 - p)) * sqrt(size / mean)) AS odds FROM units JOIN s4 ON units.source IS NOT DISTINCT FROM s4.source WHERE size > 0 AND p > 0
), r AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY odds, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM o
), c AS (
  SELECT source, doc_id, size FROM r WHERE ahead < open_words AND ahead + words / 2 <= open_words
)
SELECT w.doc_id, w.size, s4.source_size, s4.target, (w.size * (s4.copies + CASE WHEN c.size IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM w JOIN s4 ON w.source IS NOT DISTINCT FROM s4.source
LEFT JOIN c ON w.source IS NOT DISTINCT FROM c.source AND w.doc_id IS NOT DISTINCT FROM c.doc_id AND w.size = c.size
"""
