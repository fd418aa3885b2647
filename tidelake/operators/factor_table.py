"""A factor's daily values as a dataset of the lake, kept up by the versions of the bars that they come from.

The notes of the table's versions tell which version of the bars they hold. An update reads what was committed to the bars since: days
that were added or changed, and those days of the same securities whose windows reach back to them. Only these are computed, from bars
as far back as their windows need, and replace the values of their months.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators.factors import Factor, value
from tidelake.registry import Dataset, Field, Registry
from tidelake.sources.lake import Lake
from tidelake.sources.versions import Conflict


def dataset(factor: Factor) -> Dataset:
    fields = (Field("ts_code", "string"), Field("trade_date", "date"), Field("value", "float64"))
    return Dataset(f"factor_{factor.id}", f"factors/{factor.id}", fields, ("year", "month"), ("ts_code", "trade_date"), ("trade_date", "ts_code"))


class FactorTable:
    """The values of one factor over ``bars`` of a lake. ``null_as_zero`` is as in factors.value."""

    def __init__(self, lake: Lake, factor: Factor, bars: str = "bars_daily", null_as_zero: bool = True):
        factor.validate()
        self.factor, self.bars, self.null_as_zero = factor, bars, null_as_zero
        self.name = dataset(factor).name
        known = [d for d in lake.registry if d.name != self.name]
        self.lake = Lake(lake.spark, lake.root, Registry([*known, dataset(factor)]))
        # another definition has nothing to go on from
        self.definition = json.dumps({"bars": bars, "zero": null_as_zero, "kind": factor.kind, "params": asdict(factor)["params"]}, sort_keys=True)

    def _known(self) -> tuple[int, int]:
        """(the table's version, the bars' version that it holds); -1 where there is none of this definition."""
        own = self.lake.versions(self.name)
        at = own.latest()
        if at < 1:
            return at, -1
        notes = json.loads(own.entry(at)["notes"] or "{}")
        return at, notes.get("version", -1) if notes.get("definition") == self.definition else -1

    def values(self) -> DataFrame:
        """(ts_code, trade_date, value) as of the last update."""
        return self.lake.scan(self.name)

    def _computed(self, rows: DataFrame) -> DataFrame:
        return rows.select("ts_code", "trade_date", value(self.factor, self.null_as_zero).alias("value")).where("value is not null")

    def update(self) -> dict | None:
        """Brings the values up to the bars' last version; None if they are there already. Raises Conflict if another update came between."""
        own, known = self._known()
        now = self.lake.version(self.bars)
        if now < 0 or known == now:
            return None
        notes = json.dumps({"definition": self.definition, "version": now})
        bars = self.lake.read(self.bars, now)
        commits = self.lake.versions(self.bars).since(known, now) if known >= 0 else []
        if known < 0:
            return self._put(self._computed(bars), own, notes, None)
        touched = {p.rpartition("/")[0] for e in commits for p in [*e["files"], *e["removed"]]}
        if not touched:
            return self.lake.log(self.name, "update", 0, notes=notes)
        # the partitions that any commit touched, before and after: rows that differ tell securities and days
        d = self.lake.registry[self.bars]
        parts = [dict(x.split("=", 1) for x in t.split("/") if x) for t in touched]
        some = F.lit(False)
        for p in parts:
            one = F.lit(True)
            for k, v in p.items():
                one = one & (F.col(k) == v)
            some = some | one
        fields = [f for f in d.names if f not in ("ts_code", "trade_date")]
        row = F.xxhash64(*[F.col(c).isNull() for c in fields], *fields)
        side = lambda version, s: self.lake.read(self.bars, version).where(some).select("ts_code", "trade_date", row.alias("h"), F.lit(s).alias("s"))
        sums = side(known, -1).unionByName(side(now, 1)).groupBy("ts_code", "trade_date").agg(F.sum("s").alias("n"), F.sum((F.col("h") * F.col("s")).cast("decimal(38,0)")).alias("h"))
        changed = sums.where("n <> 0 OR h <> 0").select("ts_code", "trade_date")
        changed = self._written(changed)
        # a value needs so many rows before its own; those that follow a changed day by no more than that are computed again
        reach = self.factor.window + 1
        first = changed.groupBy("ts_code").agg(F.min("trade_date").alias("first"))
        bars = self._since(bars, now, first, 2 * reach)
        marked = bars.join(changed.withColumn("changed", F.lit(True)), ["ts_code", "trade_date"], "left")
        gone = changed.join(bars.select("ts_code", "trade_date"), ["ts_code", "trade_date"], "left_anti")
        marked = marked.unionByName(gone.withColumns({"changed": F.lit(True), "gone": F.lit(True)}), allowMissingColumns=True)
        # places count the rows that are there; a day that is gone has the place of the row before it
        by = Window.partitionBy("ts_code").orderBy("trade_date")
        marked = marked.withColumn("place", F.sum(F.when(F.col("gone").isNull(), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        near = Window.partitionBy("ts_code").orderBy("place")
        near = marked.select("*", F.max("changed").over(near.rangeBetween(-reach, 0)).alias("again"), F.max("changed").over(near.rangeBetween(-reach, reach)).alias("needed")).where("needed")
        due = self._written(near.where("again OR gone").select("ts_code", "trade_date").distinct())
        fresh = near.where("gone IS NULL").select("ts_code", "trade_date", "again", value(self.factor, self.null_as_zero).alias("value")).where("again AND value IS NOT NULL")
        # of the months that have such days the other values stay
        month = [F.date_format("trade_date", "yyyy").alias("year"), F.date_format("trade_date", "MM").alias("month")]
        months = due.select(*month).distinct()
        old = self.lake.read(self.name, own).join(F.broadcast(months), ["year", "month"], "left_semi").join(due, ["ts_code", "trade_date"], "left_anti")
        return self._put(old.select("ts_code", "trade_date", "value").unionByName(fresh.drop("again")), own, notes, own)

    def _written(self, rows: DataFrame) -> DataFrame:
        """The rows as a table beside the lake's own, as they are read several times."""
        path = f"{self.lake.root}/.staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.lake.spark.read.schema(rows.schema).parquet(path)

    def _since(self, bars: DataFrame, version: int, first: DataFrame, rows: int) -> DataFrame:
        """Bars of the securities of ``first`` from so many rows before their first changed day on: whole years back, until all have them."""
        own = bars.join(F.broadcast(first) if first.count() <= 100_000 else first, "ts_code")
        if "year" not in self.lake.registry[self.bars].partitions:
            return own.drop("first")
        years = sorted(self.lake.partition_values(self.bars, "year"))
        start = first.agg(F.date_format(F.min("first"), "yyyy").alias("y")).first().y
        at = max(0, min((i for i, y in enumerate(years) if y >= start), default=len(years)) - 1)
        while at:
            before = own.where((F.col("year") >= years[at]) & (F.col("trade_date") < F.col("first"))).groupBy("ts_code").count().where(F.col("count") >= rows)
            short = first.join(before, "ts_code", "left_anti").select("ts_code")
            # those without earlier bars need none
            if own.where(F.col("year") < years[at]).join(short, "ts_code", "left_semi").isEmpty():
                break
            at -= 1
        return own.where(F.col("year") >= years[at]).drop("first") if at else own.drop("first")

    def _put(self, rows: DataFrame, own: int, notes: str, base: int | None) -> dict:
        if self.lake.version(self.name) != own:
            raise Conflict(f"{self.name} was updated meanwhile")
        return self.lake.write(self.name, rows, "replace", "update", source=self.bars, notes=notes, base=base)
