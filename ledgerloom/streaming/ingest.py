"""Structured Streaming: ingestion that drops repeats, usage by day, and running baselines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drop_repeats(stream: DataFrame, key: str = "source_id", at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each ``key`` once within the watermark; state older than the delay is given up."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def usage_by_day(stream: DataFrame, user: str = "user_id", at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Requests of each user in tumbling days; later rows than the delay are dropped by the watermark."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, "1 day"), user).agg(F.count("*").alias("requests")).select(
        user, F.to_date("window.start").alias("day"), "requests")


def running_baseline(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and extremes of ``value`` by ``key``, kept as state and updated with each batch.

    A key's state is five numbers and is kept for good, so this is for keys that are bounded (kinds of events, vendors).
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        for f in frames:
            v = f[value].dropna()
            if len(v):
                n, total, low, high = n + len(v), total + float(v.sum()), min(low, float(v.min())), max(high, float(v.max()))
        state.update((n, total, low, high))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [total / n if n else None], "low": [low], "high": [high]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, value).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, mean double, low double, high double", "n long, total double, low double, high double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Takes all that is there, writes it as Parquet and reads it back."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.parquet(path)
