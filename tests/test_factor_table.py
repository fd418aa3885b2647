import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.operators import factors
from tidelake.operators.factor_table import FactorTable
from tidelake.sources.lake import Lake

SCHEMA = "ts_code string, trade_date date, close double, pct_chg double, turnover_rate double"


def bars(spark, rng, codes, start, n, holes=0.2):
    return spark.createDataFrame([(c, start + timedelta(i), rng.uniform(5, 50), rng.uniform(-9, 9), rng.uniform(0, 5)) for c in codes for i in range(n) if rng.random() > holes], SCHEMA)


def whole(lake, factor):
    rows = lake.read("bars_daily").select("ts_code", "trade_date", factors.value(factor).alias("value")).where("value is not null").collect()
    return {(r.ts_code, r.trade_date): pytest.approx(r.value) for r in rows}


def kept(table):
    rows = table.values().collect()
    assert len({(r.ts_code, r.trade_date) for r in rows}) == len(rows)
    return {(r.ts_code, r.trade_date): r.value for r in rows}


@pytest.mark.parametrize("kind,window", [("momentum", 5), ("volatility", 4)])
def test_updates_equal_a_full_computation(spark, tmp_path, kind, window):
    rng, lake = random.Random(kind), Lake(spark, str(tmp_path))
    factor = factors.Factor(kind, kind, kind, {"window": window})
    lake.write("bars_daily", bars(spark, rng, "abc", date(2021, 11, 1), 420))
    table = FactorTable(lake, factor)
    assert table.update()["rows"] == len(kept(table)) > 500 and table.update() is None
    assert kept(table) == whole(lake, factor)
    # days after, a new security, one that was still for a year
    lake.write("bars_daily", bars(spark, rng, "abd", date(2022, 12, 26), 10, 0).unionByName(bars(spark, rng, "e", date(2021, 12, 1), 9, 0)).unionByName(bars(spark, rng, "e", date(2022, 12, 20), 4, 0)))
    months = dict(table.lake.files("factor_" + kind))
    table.update()
    assert kept(table) == whole(lake, factor)
    now = dict(table.lake.files("factor_" + kind))
    # files of months that nothing touched are the same ones
    assert len(set(months) & set(now)) >= 10
    # a correction in the past: a year is replaced, with some closes changed and some days gone
    year = lake.read("bars_daily").where("year = '2022'")
    fixed = year.where("NOT (ts_code = 'b' AND trade_date BETWEEN '2022-03-05' AND '2022-03-25')").withColumn("close", F.when((F.col("ts_code") == "a") & (F.col("trade_date") == date(2022, 6, 6)), 99.0).otherwise(F.col("close")))
    fixed = fixed.withColumn("pct_chg", F.when((F.col("ts_code") == "c") & (F.dayofyear("trade_date") == 200), 8.5).otherwise(F.col("pct_chg")))
    lake.write("bars_daily", fixed.select(*lake.registry["bars_daily"].names), "replace")
    table.update()
    assert kept(table) == whole(lake, factor)
    # a commit without files changes the version only; another definition starts anew
    lake.log("bars_daily", "note", 0)
    assert table.update()["rows"] == 0 and table.update() is None
    other = FactorTable(lake, factors.Factor(kind, kind, kind, {"window": window + 3}))
    other.update()
    assert kept(other) == whole(lake, other.factor)
