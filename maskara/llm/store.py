"""Where long plans are cut: reliable checkpoints in the folder all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at:
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="maskara-")
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there."""
    ensure_shared(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows, else as it is (then it is joined by shuffle).

    df must be cheap to count: a checkpoint or a small aggregate.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def drawn(df: DataFrame, rows: float, total: int, salt: str, key: str) -> DataFrame:
    """About ``rows`` of the ``total`` rows of df, by a hash of the salt and a column; all of them if there are no more."""
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 50)) < max(1, math.ceil(min(1.0, rows / max(total, 1)) * (1 << 50))))


def scratch(spark, name: str) -> str:
    """A folder of this run in the shared one, removed when the driver's JVM ends."""
    at = f"{ensure_shared(spark)}/maskara-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def one_row_each(docs: DataFrame, marked: DataFrame, kept: DataFrame, mark, rows: int) -> DataFrame:
    """One row of docs for each (doc_id, mark) of kept, columns as given.

    marked has doc_id and mark of every row of docs; mark(df, name) adds the mark of each row as a column. Where a doc_id names one
    row only, that tells it; the rows of other ids are marked again. Of rows equal in both, that with the least hash of all
    its columns stays.
    """
    repeated = cut(marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    here = cut(kept.alias("k").join(small(repeated, rows).alias("r"), same("k", "r"), "left").select("k.doc_id", "k.mark", F.col("r.doc_id").isNotNull().alias("again")).withColumn("again", F.col("again") | F.col("doc_id").isNull()))
    plain = docs.alias("d").join(small(here.filter("NOT again").select("doc_id"), rows).alias("k"), same("d", "k"), "left_semi")
    again = here.filter("again").select("doc_id", "mark")
    if not again.limit(1).count():
        return plain
    own, row = free(docs, "_mark"), free(docs, "_row")
    some = mark(docs.alias("d").join(small(again.select("doc_id").distinct(), rows).alias("k"), same("d", "k"), "left_semi"), own)
    whole = some.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("doc_id").alias("_i"), F.coalesce(own, F.lit(0)).alias("_m"))  # coalesce: no filter for nulls goes below the join
    least = whole.groupBy("_i", "_m").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(row))
    chosen = least.alias("d").join(small(again, rows).alias("k"), F.col("d._i").eqNullSafe(F.col("k.doc_id")) & (F.col("d._m") == F.col("k.mark")), "left_semi")
    return plain.unionByName(chosen.select(f"{row}.*"))


def free(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has a column of that name (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of a batch that Spark hands to Python, where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of texts small enough that neither side holds much at once; a session's own setting of the rows stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
