"""Streaming counterparts: bursts, windows, edges, parts as they arrive.

Sources are any stream of marks (``ts`` timestamp with zone, ``session``,
``name``, ``value``) or of signal chunks.  Late rows are accepted up to the
watermark and dropped beyond it; state is kept by key in the state store and
leaves it with the watermark (windows, bursts) or when a session is closed
(edges).  Every job takes a checkpoint folder from the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MARKS = "event_id long, ts timestamp, session long, name string, value double"


def marks(spark: SparkSession, path: str, schema: str = MARKS, files_per_batch: int = 64, late: str = "1 day") -> DataFrame:
    """Parquet marks read file by file as they arrive, with the watermark ``late``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withWatermark("ts", late)


def once(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Repeated deliveries dropped within the watermark (append mode behind it)."""
    return df.dropDuplicatesWithinWatermark([key])


def burst_counts(df: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Bursts separated by a gap, as session windows."""
    w = df.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return w.select("session", "start", "end", "n")


def window_rates(df: DataFrame, length: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Counts and totals in fixed or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    a = df.groupBy("name", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return a.select("name", F.col("w.start").alias("start"), "n", "total")


EDGES = "session long, edge string, ts timestamp, value double"


def edges(df: DataFrame, lo: float, hi: float, dwell_s: float = 0.0, idle_ms: int = 3_600_000) -> DataFrame:
    """Rises at ``hi`` and falls below ``lo`` of each session's values in order of
    time, each state held for at least ``dwell_s``.

    The state of a session is two numbers; rows of a batch are sorted within the
    batch, rows older than the last seen are ignored as late.  A session idle for
    ``idle_ms`` of processing time is forgotten.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        high, since, last = state.get if state.exists else (False, float("-inf"), float("-inf"))
        p = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for ts, v in zip(p["ts"], p["value"], strict=True):
            t = ts.timestamp()
            if t < last or v is None or v != v:
                continue
            last = t
            if t - since < dwell_s:
                continue
            if not high and v >= hi:
                high, since = True, t
                out.append((key[0], "rise", ts, v))
            elif high and v < lo:
                high, since = False, t
                out.append((key[0], "fall", ts, v))
        state.update((high, since, last))
        state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["session", "edge", "ts", "value"])

    return df.groupBy("session").applyInPandasWithState(step, EDGES, "high boolean, since double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All available input written to parquet, then ended."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def merged_rates(df: DataFrame, path: str, checkpoint: str, length: str = "6 hours"):
    """Window rates kept up to date in a table partitioned by batch: each batch's
    changed windows are written under its number, so a repeated batch overwrites
    itself; readers take each window's newest batch (``read_merged``)."""

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={no}")

    rates = window_rates(df, length)
    return rates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path)
    return d.groupBy("name", "start").agg(F.max_by(F.struct("n", "total"), "batch").alias("b")).select("name", "start", "b.*")
