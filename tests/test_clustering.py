"""Clustering: many small files from few tasks."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidelake.sources.lake import Lake


def tasks_of(spark, work):
    """The most tasks that a stage which wrote rows had."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.numTasks() for s in (found.apply(i) for i in range(found.size())) if s.outputRecords()}

    before = stages()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return max(v for k, v in stages().items() if k not in before)


def test_a_task_writes_many_files(spark, tmp_path):
    """A code with more rows than a file begins at a place that is a range's number, too; each range and piece has its file."""
    lake = Lake(spark, str(tmp_path))
    rows = [(f"c{i % 60:02d}", date(2023, 1, 1) + timedelta(i // 60), float(i)) for i in range(1200)] + [("c05", date(2023, 3, 1) + timedelta(i), 1.0) for i in range(15)]
    lake.write("bars_daily", spark.createDataFrame(rows, "ts_code string, trade_date date, close double").repartition(4))
    before = lake.version("bars_daily")
    assert tasks_of(spark, lambda: lake.cluster("bars_daily", 20)) <= 4
    told = lake.footers("bars_daily").where("field = 'ts_code'").collect()
    # a file for each of 59 codes and two for the one of 35 rows, one row group each
    assert len(told) == 61 and {r.rows for r in told if r.low != "c05"} == {20} and all(r.low == r.high for r in told)
    assert sorted(r.rows for r in told if r.low == "c05") == [15, 20]
    assert lake.overlaps("bars_daily").first().overlapping == 0 and lake.changes("bars_daily", before, lake.version("bars_daily")).count() == 0
    assert all(f.rpartition("/")[0] == f"{lake.path('bars_daily')}/year=2023" for f, _ in lake.files("bars_daily"))
    assert lake.verify("bars_daily").first().status == "ok" and lake.read("bars_daily").agg(F.count("*")).first()[0] == len(rows)
