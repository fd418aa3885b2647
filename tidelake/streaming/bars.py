"""Structured Streaming: bars from ticks, suppression of repeats, ingestion into the lake."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "user_id", at: str = "ts", price: str = "value") -> DataFrame:
    """OHLC bars of fixed windows, given out once the watermark has passed a window's end."""
    order = F.struct(at)
    return (
        ticks.withColumn(at, F.col(at).cast("timestamp_ltz"))
        .withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), key)
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("vol"), F.sum(price).alias("amount"))
        .select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "vol", "amount")
    )


def without_repeats(rows: DataFrame, key: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return rows.withColumn(at, F.col(at).cast("timestamp_ltz")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def into_lake(rows: DataFrame, lake, dataset: str, checkpoint: str):
    """Writes each micro-batch once: a version's notes carry the stream and the batch's number.

    Files and notes are committed together, so a batch that was cut off before left nothing, and one that came through is left out.
    """
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:8]

    def store(batch: DataFrame, number: int) -> None:
        label = f"batch {stream} {number}"
        if label not in lake.labels(dataset, "stream"):
            lake.write(dataset, batch, "append", "stream", notes=label, once=True)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
