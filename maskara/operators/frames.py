"""Frame streams, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def scheduled(frames: DataFrame, n: int, by: list[str], refresh: str | None = None) -> DataFrame:
    """runs: the first frame of each stream, every n-th index (n 0: the first only), and those asked for."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("frame_index")) == 1
    runs = first | (F.pmod(F.col("frame_index"), F.lit(n)) == 0) if n > 0 else first
    return frames.withColumn("runs", runs | F.col(refresh) if refresh else runs)


def result_age(frames: DataFrame, by: list[str]) -> DataFrame:
    """age: frames since the last run, carried forward; 0 on it and before the first. An as-of join with the latest run,
    as a window."""
    so_far = Window.partitionBy(*by).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("runs"), F.col("frame_index")), ignorenulls=True).over(so_far)
    return frames.withColumn("last_run", last).withColumn("age", F.coalesce(F.col("frame_index") - F.col("last_run"), F.lit(0)))


def history(frames: DataFrame, value: str, most: int = 30) -> DataFrame:
    """The track's last values, this one included, oldest first."""
    w = Window.partitionBy("track_id").orderBy("frame_index").rowsBetween(-(most - 1), 0)
    return frames.withColumn("history", F.collect_list(value).over(w))


def deltas(frames: DataFrame, by: list[str]) -> DataFrame:
    """delta_ms since the frame before, null on the first; fps from it, at most 1e9."""
    w = Window.partitionBy(*by).orderBy("frame_index")
    ms = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1000.0
    return frames.withColumn("delta_ms", ms).withColumn("fps", 1.0 / F.greatest(F.col("delta_ms") / 1000.0, F.lit(1e-9)))


def timeout_runs(frames: DataFrame, by: list[str], timed_out: str, least: int = 5) -> DataFrame:
    """Runs of consecutive timeouts, gaps and islands; ``aborts`` where one is long enough."""
    w = Window.partitionBy(*by).orderBy("frame_index")
    marked = frames.withColumn("_island", F.sum(F.when(F.col(timed_out), 0).otherwise(1)).over(w))
    runs = marked.filter(timed_out).groupBy(*by, "_island").agg(F.min("frame_index").alias("start"), F.count("*").alias("n"))
    return runs.drop("_island").withColumn("aborts", F.col("n") >= least)


def latest(frames: DataFrame, by: str = "batch") -> DataFrame:
    """Of each batch only the newest frame, with how many were skipped."""
    return frames.groupBy(by).agg(F.max_by(F.struct(*[c for c in frames.columns if c != by]), "frame_index").alias("f"), (F.count("*") - 1).alias("skipped")).select(by, "f.*", "skipped")


def summary(frames: DataFrame) -> DataFrame:
    """Frames, tracks, most at once, inference runs, duration and measured rate."""
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    rows = frames.agg(F.count("*").alias("frames"), F.count_distinct("track_id").alias("tracks"), F.count_if("runs").alias("runs"), span.alias("seconds"))
    return rows.withColumn("fps", F.when(F.col("seconds") > 0, (F.col("frames") - 1) / F.col("seconds")).otherwise(0.0))


def dropped(written: DataFrame) -> DataFrame:
    """duration, fps, written, counter -> estimated drops: what the rate lacks, else the device's counter."""
    return written.withColumn("dropped", F.coalesce(F.greatest(F.rint(F.col("duration") * F.col("fps") - F.col("written")).cast("long"), F.lit(0)), F.col("counter")))


def routed(tracks: DataFrame) -> DataFrame:
    """confirmed if the id is a whole number of zero or more; others go to the unconfirmed detections."""
    v = F.col("track_value")
    return tracks.withColumn("confirmed", F.coalesce(~F.isnan(v) & (v >= 0) & (v == F.floor(v)), F.lit(False)))


def segments(frames: DataFrame, seconds: int) -> DataFrame:
    """Frames of each stretch of so many seconds and stream."""
    return frames.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def measured(frames: DataFrame, warmup: int) -> DataFrame:
    return frames.filter(F.col("frame_index") >= warmup)


def failures(frames: DataFrame) -> DataFrame:
    """status -> counters and the state the run ends in."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = frames.agg(n("ok").alias("ok"), n("conversion").alias("conversion"), n("write").alias("write"), n("timeout").alias("timeout"))
    return rows.withColumn("terminal", F.when(F.col("write") > 0, "write_failed").when((F.col("ok") == 0) & (F.col("timeout") > 0), "no_frames").when((F.col("conversion") > 0) | (F.col("timeout") > 0), "partial").otherwise("complete"))
