"""Lineage cuts in the shared folder, and dense numbers in a global order without a window over everything."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir; one of our own only on a local master where that is unset."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskara-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df with ``name``: each row's place (from 0) by the keys, which should tell rows apart. Rows are sorted in ranges and kept so; a place is the
    count of the ranges before, which come to one small table, and the place within the range."""
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_in"))
    counts = sorted((r["_range"], r["count"]) for r in ordered.groupBy("_range").count().collect())  # a row a range
    before, total = [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    table = df.sparkSession.createDataFrame(before, "_range int, _before long")
    return ordered.join(F.broadcast(table), "_range").select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def sorted_groups(spark: SparkSession) -> None:
    """Aggregates over rows that are sorted by their key take them in that order. Else a task of more than 128 groups sorts its rows again for arrays, before the
    partial and before the final step. A session's own setting stays."""
    if "spark.sql.execution.replaceHashWithSortAgg" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def each_of(exploded: DataFrame, name: str) -> DataFrame:
    """Rows of explode_outer without those of empty arrays. A plain explode first filters by the array's size, and so makes an array of lambdas twice."""
    return exploded.filter(F.col(name).isNotNull())


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most ``rows`` rows; it must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
