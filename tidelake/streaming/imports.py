"""Imports as a stream: a data source whose offsets count windows, so that a stopped import goes on where its checkpoint says."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidelake.operators.timeseries import keep_first
from tidelake.sources.ingest import Import, typed, whole_pages, windows


@dataclass
class _Window(InputPartition):
    number: int
    params: str


def closed_calls(spec: Import, start: date, upto: date) -> list[dict]:
    """The calls of all windows that have ended by a day, window by window; a later day only adds calls at the end."""
    days = 1 if spec.mode == "date" else spec.window_days
    # one more window, which tells where the last but one would end by itself
    span = [(a, b) for a, b in windows(start, date.fromordinal(upto.toordinal() + 400), days) if b <= upto]
    if spec.mode == "date":
        return [{**s, spec.date_param: f"{a:%Y%m%d}"} for a, _ in span for s in spec.slices]
    return [{**s, "start_date": f"{a:%Y%m%d}", "end_date": f"{b:%Y%m%d}"} for a, b in span for s in spec.slices]


class _Reader(DataSourceStreamReader):
    def __init__(self, source, spec: Import, calls: list[dict]):
        self.source, self.spec, self.calls = source, spec, calls

    def initialOffset(self) -> dict:
        return {"calls": 0}

    def latestOffset(self) -> dict:
        return {"calls": len(self.calls)}

    def partitions(self, start: dict, end: dict):
        return [_Window(n, json.dumps(self.calls[n])) for n in range(start["calls"], end["calls"])]

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offset; nothing else is kept for a batch."""

    def read(self, partition):
        names, n = self.spec.fields.split(","), 0
        for page in whole_pages(self.source, self.spec.dataset, json.loads(partition.params), self.spec.fields):
            at = [page.fields.index(f) if f in page.fields else None for f in names]
            for item in page.items:
                yield (*[None if i is None or item[i] is None else str(item[i]) for i in at], partition.number, n)
                n += 1


def import_stream(spark, source, spec: Import, start: date, upto: date) -> DataFrame:
    """The calls' rows as text, as a stream: a batch has the windows that ended since the last one, a task for each call."""
    calls = closed_calls(spec, start, upto)
    named = f"market_import_{uuid.uuid4().hex}"

    class Windows(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return ", ".join([*(f"`{f}` string" for f in spec.fields.split(",")), "__call long", "__seq long"])

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(source, spec, calls)

    spark.dataSource.register(Windows)
    return spark.readStream.format(named).load()


def import_into(lake, source, spec: Import, start: date, upto: date, checkpoint: str):
    """Imports the windows that ended by ``upto`` and that the checkpoint doesn't have yet; each batch is committed once, with its number.

    As in other imports the first row of each key of a call stays. A start after a batch that was cut off finishes that batch; the windows that
    ended since come with the next start.
    """
    d, stream = lake.registry[spec.dataset], uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:8]

    def store(batch: DataFrame, number: int) -> None:
        label = f"import {stream} {number}"
        if label in lake.labels(spec.dataset, "stream"):
            return
        own = keep_first(typed(batch, d), ["__call", *d.primary_key], ["__call", "__seq"])
        if d.partitions and spec.partition_from:
            own = own.withColumn(d.partitions[0], F.coalesce(F.col(spec.partition_from).cast("string"), F.lit("")))
        lake.write(spec.dataset, own.drop("__call", "__seq"), "append", "stream", notes=label, once=True)

    rows = import_stream(lake.spark, source, spec, start, upto)
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
