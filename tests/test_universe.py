from pyspark.sql import functions as F

from tidelake.plans import catalog


def test_every_run_trades_over_all_securities(spark):
    # 150 securities; runs over ids 1 to 12 would trade no more than these
    trades = catalog.QUERIES["backtest_trades"](spark, "/root/testdata/sf0.01")
    found = {r.run_id: r.n for r in trades.groupBy("run_id").agg(F.countDistinct("security").alias("n")).collect()}
    assert found["averages-2-5"] > 100 and found["averages-3-8"] > 100 and found["limits-98"] > 12
