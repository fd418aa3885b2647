"""Imports: slices and windows of a source's calls, typed rows, the first of each key, partitions, a ledger to resume by.

All calls of a run are rows of one table, and executors make them. A window whose answer isn't whole is cut in two by the task that got it,
and its halves are asked for, until every part is whole. A commit takes the answers of many calls, with their labels, so that a run
that was cut off goes on after the last commit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import dates
from tidelake.operators.timeseries import keep_first
from tidelake.registry import TYPES, Dataset
from tidelake.sources.lake import Lake
from tidelake.sources.remote import Page, SourceError, complete


@dataclass(frozen=True)
class Import:
    """How a dataset is fetched: ``snapshot`` (all slices at once), ``date`` (a call a day) or ``window`` (calls of some days)."""

    dataset: str
    mode: str
    fields: str
    slices: tuple[dict, ...] = ({},)
    partition_from: str = ""
    date_param: str = ""
    window_days: int = 31


#: The indices whose bars are imported.
_INDICES = ("000001.SH", "000016.SH", "000300.SH", "000905.SH", "000852.SH", "000688.SH", "399001.SZ", "399006.SZ", "399303.SZ", "899050.BJ")


def imports(last_year: int) -> dict[str, Import]:
    """The imports' fields, slices and windows."""
    years = [{"exchange": e, "start_date": f"{y}0101", "end_date": f"{y}1231"} for e in ("SSE", "SZSE", "CFFEX") for y in range(1990, last_year + 1)]
    return {
        i.dataset: i
        for i in (
            Import("stock_basic", "snapshot", "ts_code,symbol,name,area,industry,fullname,enname,cnspell,market,exchange,curr_type,list_status,list_date,delist_date,is_hs,act_name,act_ent_type", ({"list_status": "L"}, {"list_status": "D"}, {"list_status": "P"}), "list_status"),
            Import("trade_cal", "snapshot", "exchange,cal_date,is_open,pretrade_date", tuple(years), "exchange"),
            Import("index_basic", "snapshot", "ts_code,name,fullname,market,publisher,index_type,category,base_date,base_point,list_date", tuple({"market": m} for m in ("SSE", "SZSE", "CSI", "CNI", "SW")), "market"),
            Import("stk_limit", "date", "ts_code,trade_date,pre_close,up_limit,down_limit", date_param="trade_date"),
            Import("suspend_d", "window", "ts_code,trade_date,suspend_timing,suspend_type"),
            Import("namechange", "window", "ts_code,name,start_date,end_date,ann_date,change_reason"),
            Import("index_daily", "window", "ts_code,trade_date,close,open,high,low,pre_close,change,pct_chg,vol,amount", tuple({"ts_code": c} for c in _INDICES), window_days=366),
        )
    }


def windows(start: date, end: date, days: int) -> list[tuple[date, date]]:
    """Windows of so many days that follow one another from the start; months where ``days`` is 31."""
    out, at = [], start
    while at <= end:
        if days == 31:
            after = (at.replace(day=1) + timedelta(days=32)).replace(day=1)
        else:
            after = at + timedelta(days=days)
        out.append((at, min(end, after - timedelta(days=1))))
        at = after
    return out


def typed(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """Rows of text in the dataset's types; columns that are missing, and values that can't be read, are null."""
    out = []
    for f in dataset.fields:
        kind = TYPES[f.type]
        if f.name not in rows.columns:
            out.append(F.lit(None).cast(kind).alias(f.name))
            continue
        c = F.col(f.name)
        if f.type == "date":
            c = dates.parse_date_value(c)
        elif f.type == "timestamp":
            c = dates.parse_timestamp_value(c)
        elif f.type == "int64":
            c = c.try_cast("double").cast("long")
        elif f.type != "string":
            c = c.try_cast(kind)
        if f.type == "float64":
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return rows.select(*out, *[c for c in rows.columns if c.startswith("__")])


#: Calls whose answers are committed together, at most.
AT_ONCE = 2000


def whole_pages(source, api: str, params: dict, fields: str) -> Iterator[Page]:
    """A call's answer in whole pages, in the order of days.

    An answer that lacks rows, or a service that finds the call too large, halves the days from start_date to end_date; both halves
    are asked for. A single day, or a call without days, that can't be answered whole is an error.
    """
    todo = [params]
    while todo:
        asked = todo.pop()
        try:
            yield complete(source.call(api, asked, fields))
        except SourceError as e:
            a, b = (dates.date_parameter(asked[k]) if asked.get(k) else None for k in ("start_date", "end_date"))
            if e.kind != "halve" or a is None or b is None or a >= b:
                raise SourceError(f"{api} {json.dumps(asked, sort_keys=True)}: {e}", e.kind) from e
            middle = a + (b - a) // 2
            todo += [asked | {"start_date": f"{middle + timedelta(1):%Y%m%d}"}, asked | {"end_date": f"{middle:%Y%m%d}"}]


class Importer:
    def __init__(self, lake: Lake, source):
        self.lake, self.source = lake, source

    def _rows(self, spec: Import, calls: list[dict]) -> DataFrame:
        """The calls' rows as text, with the call's number and their own in the calls' order. Executors make the calls, one to a partition."""
        names, source, api = spec.fields.split(","), self.source, spec.dataset
        fields = spec.fields

        def fetched(batches):
            import pyarrow as pa

            for batch in batches:
                for k, params in zip(*(c.to_pylist() for c in batch.columns)):
                    n = 0
                    for page in whole_pages(source, api, json.loads(params), fields):
                        at = [page.fields.index(f) if f in page.fields else None for f in names]
                        text = [[None if i is None or r[i] is None else str(r[i]) for r in page.items] for i in at]
                        size = len(page.items)
                        yield pa.RecordBatch.from_arrays([*(pa.array(t, pa.string()) for t in text), pa.array([k] * size, pa.int64()), pa.array(range(n, n + size), pa.int64())], [*names, "__call", "__seq"])
                        n += size

        spark = self.lake.spark
        asked = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(calls)], "k long, params string").repartitionByRange(len(calls), "k")
        return asked.mapInArrow(fetched, T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, T.LongType()) for n in ("__call", "__seq")]))

    def _store(self, spec: Import, rows: DataFrame, labels: list[str], replace: bool) -> dict:
        d = self.lake.registry[spec.dataset]
        own = typed(rows, d)
        if d.primary_key:
            # of a snapshot's slices together, else of each call
            own = keep_first(own, [*([] if spec.mode == "snapshot" else ["__call"]), *d.primary_key], ["__call", "__seq"])
        if d.partitions and spec.partition_from:
            own = own.withColumn(d.partitions[0], F.coalesce(F.col(spec.partition_from).cast("string"), F.lit("")))
        return self.lake.write(spec.dataset, own.drop("__call", "__seq"), "replace" if replace else "append", "import", notes=json.dumps(labels))

    def done(self, dataset: str) -> set[str]:
        """Labels of the calls whose answers are in the dataset."""
        return {label for notes in self.lake.labels(dataset, "import") if notes.startswith("[") for label in json.loads(notes)}

    def run(self, spec: Import, start: date | None = None, end: date | None = None, replace: bool = False, resume: bool = True, at_once: int = AT_ONCE) -> list[dict]:
        """Imports, one job and one commit for ``at_once`` calls; calls that the ledger has are left out.

        A snapshot holds all there is, so it replaces what the dataset (or those of its partitions that it has) held:
        running it again changes nothing. With ``replace``, a commit replaces the partitions that it has rows of.
        """
        if spec.mode == "snapshot":
            return [self._store(spec, self._rows(spec, list(spec.slices)), ["snapshot"], True)]
        span = windows(start, end, 1 if spec.mode == "date" else spec.window_days)
        done, calls = self.done(spec.dataset) if resume else set(), []
        for slice_ in spec.slices:
            for a, b in span:
                label = json.dumps({**slice_, "from": f"{a:%Y%m%d}", "to": f"{b:%Y%m%d}"}, sort_keys=True)
                if label not in done:
                    calls.append((label, {**slice_, spec.date_param: f"{a:%Y%m%d}"} if spec.mode == "date" else {**slice_, "start_date": f"{a:%Y%m%d}", "end_date": f"{b:%Y%m%d}"}))
        parts = [calls[i : i + at_once] for i in range(0, len(calls), at_once)]
        return [self._store(spec, self._rows(spec, [p for _, p in part]), [label for label, _ in part], replace) for part in parts]


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, first and last key of two sources, side by side."""
    one = lambda df, s: df.agg(F.lit(s).alias("side"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.min(key).alias("first"), F.max(key).alias("last"))
    return reduce(DataFrame.unionByName, [one(a, "a"), one(b, "b")])
