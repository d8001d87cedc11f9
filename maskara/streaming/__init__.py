"""Structured Streaming forms of the frame operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME = "stream string, frame_index long, ts timestamp, refresh boolean"
RESULT = "stream string, frame_index long, ts timestamp, runs boolean, age long, fps double"


class Scheduler(StatefulProcessor):
    """Runs, ages and rates of each stream's frames. State: the last frame's index and time, and the last run. Frames of a
    micro-batch come in any order and are sorted; frames older than what was seen are late and left out."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "frame_index long, micros long, run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        last, micros, run = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for r in batch.itertuples(index=False):
            if last is not None and r.frame_index <= last:
                continue
            runs = run is None or bool(r.refresh) or (self.every > 0 and r.frame_index % self.every == 0)
            run = r.frame_index if runs else run
            now = pd.Timestamp(r.ts).value // 1000
            rate = None if micros is None else 1.0 / max((now - micros) / 1e6, 1e-9)
            out.append((key[0], r.frame_index, r.ts, runs, r.frame_index - run, rate))
            last, micros = r.frame_index, now
        if out:
            self.state.update((int(last), int(micros), int(run)))
        yield pd.DataFrame(out, columns=["stream", "frame_index", "ts", "runs", "age", "fps"])

    def close(self) -> None:
        pass


def schedule(frames: DataFrame, every: int) -> DataFrame:
    """A stream of frames -> a stream of results."""
    return frames.groupBy("stream").transformWithStateInPandas(Scheduler(every), RESULT, "Append", "None")


def newest(batch: DataFrame) -> DataFrame:
    """Of a micro-batch, each stream's newest frame and how many it passed over; for foreachBatch."""
    return batch.groupBy("stream").agg(F.max_by(F.struct("frame_index", "ts"), "frame_index").alias("f"), (F.count("*") - 1).alias("skipped")).select("stream", "f.frame_index", "f.ts", "skipped")


def segments(frames: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """Frames by stretch of event time; a stretch is written once the watermark has passed it."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "stream").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stream", "n")


def split_tracks(batch: DataFrame, confirmed: str, unconfirmed: str) -> None:
    """Appends a micro-batch's confirmed tracks and the other detections to their folders; for foreachBatch."""
    from ..operators.frames import routed

    rows = routed(batch).persist()
    rows.filter("confirmed").drop("confirmed").write.mode("append").json(confirmed)
    rows.filter("NOT confirmed").drop("confirmed").write.mode("append").json(unconfirmed)
    rows.unpersist()
