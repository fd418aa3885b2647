from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.sources import ingest, remote
from tidelake.sources.lake import Lake
from tidelake.streaming import imports, keyed


def run(spark, out, home):
    """Runs what has come; all that was told so far."""
    q = keyed.started(out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True), spark)
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.schema(out.schema).parquet(f"{home}/out").collect()


def arrives(spark, rows, schema, home):
    part = spark.createDataFrame(rows, schema)
    part.coalesce(1).write.mode("append").parquet(f"{home}/in")
    return spark.readStream.schema(part.schema).parquet(f"{home}/in")


def at(text):
    return datetime.fromisoformat(f"2024-01-{text}")


def test_expiring_orders(spark, tmp_path):
    schema = "order_id string, ts timestamp_ntz, event string"
    first = [("a", "02 09:31", "placed"), ("b", "02 09:32", "placed"), ("a", "02 10:00", "filled"), ("c", "02 09:40", "placed"), ("c", "02 09:50", "cancelled"), ("d", "02 15:00", "placed")]
    told = run(spark, keyed.expiring_orders(arrives(spark, [(a, at(t), e) for a, t, e in first], schema, tmp_path)), tmp_path)
    assert {r.order_id: r.status for r in told} == {"a": "filled", "c": "cancelled"}
    # the watermark passes b's end, in another run; d is open still, and what fills b now comes too late
    told = run(spark, keyed.expiring_orders(arrives(spark, [("e", at("02 16:00"), "placed"), ("b", at("02 15:45"), "filled")], schema, tmp_path)), tmp_path)
    assert {r.order_id: (r.status, r.ended) for r in told if r.order_id not in "ac"} == {"b": ("expired", at("02 15:32"))}
    told = run(spark, keyed.expiring_orders(arrives(spark, [("f", at("05 16:00"), "placed")], schema, tmp_path)), tmp_path)
    assert {r.order_id: r.status for r in told} == {"a": "filled", "b": "expired", "c": "cancelled", "d": "expired", "e": "expired"} and len(told) == 5


def test_many_orders_of_a_key(spark, tmp_path):
    schema = "user long, id long, ts timestamp_ntz, event string"
    rows = [(1, 10, at("02 09:00"), "placed"), (1, 11, at("02 10:00"), "placed"), (1, 12, at("02 11:00"), "placed"), (1, 11, at("02 11:30"), "cancelled"), (1, None, at("02 12:30"), "filled"), (2, None, at("02 12:30"), "filled"), (3, 13, at("03 12:00"), "placed")]
    told = run(spark, keyed.expiring_orders(arrives(spark, rows, schema, tmp_path), "user", life="3 hours", order="id"), tmp_path)
    # the first one was placed longer ago than it lives
    assert {(r.user, r.order, r.status, r.ended) for r in told} == {(1, "10", "expired", at("02 12:00")), (1, "11", "cancelled", at("02 11:30")), (1, "12", "filled", at("02 12:30"))}


def test_positions_and_windows_go_on_after_a_restart(spark, tmp_path):
    schema = "user long, id long, ts timestamp_ntz, amount long"
    rows = [(1, i, at("02 09:00") + timedelta(hours=5 * i), [5, -3, 4, -2, -20, 7, -1, -9][i % 8]) for i in range(24)] + [(2, 100, at("08 09:00"), -5)]
    held = sellable = 0
    day, want = None, {100: (0, 0, 0)}
    for _, i, t, n in rows[:24]:
        if t.date() != day:
            day, sellable = t.date(), held
        n = n if n > 0 else -min(-n, sellable)
        held, sellable = held + n, sellable + min(n, 0)
        want[i] = (n, held, sellable)
    for part in (rows[:10], rows[10:11], rows[11:]):
        told = run(spark, keyed.positions(arrives(spark, part, schema, tmp_path / "p"), "user"), tmp_path / "p")
    assert {r.id: (r.done, r.held, r.sellable) for r in told} == want
    for part in (rows[:7], rows[7:]):
        told = run(spark, keyed.rolling(arrives(spark, part, schema, tmp_path / "r"), "user", "16 hours", 3, value="amount"), tmp_path / "r")
    for r in told:
        if r.user == 1:
            own = [n for _, i, t, n in rows[max(0, r.id - 2) : r.id + 1] if t > rows[r.id][2] - timedelta(hours=16)]
            assert (r.n, r.total, r.high) == (len(own), sum(own), max(own))
    assert len(told) == 25


class Days:
    """A service with two rows a day, one of them twice."""

    def call(self, api, params=None, fields=""):
        a, b = (datetime.strptime(params[k], "%Y%m%d").date() for k in ("start_date", "end_date"))
        rows = [[c, f"{a + timedelta(i):%Y%m%d}", str(n)] for i in range((b - a).days + 1) for n, c in enumerate(("x", "y", "x"))]
        return remote.Page(["ts_code", "trade_date", "vol"], rows)


def test_an_import_that_is_killed_goes_on(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    spec = ingest.Import("index_daily", "window", "ts_code,trade_date,vol", window_days=10)
    start, home = date(2024, 1, 1), str(tmp_path / "state")
    go = lambda upto: imports.import_into(lake, Days(), spec, start, upto, home)
    go(date(2024, 1, 20)).awaitTermination()
    assert lake.read("index_daily").count() == 40
    # it is killed after the lake has a batch and before the checkpoint knows
    write = Lake.write

    def killed(self, *a, **b):
        write(self, *a, **b)
        raise RuntimeError("killed")

    monkeypatch.setattr(Lake, "write", killed)
    with pytest.raises(Exception, match="killed"):
        go(date(2024, 2, 5)).awaitTermination()
    monkeypatch.undo()
    # the batch that was cut off comes first, and is left out; then the windows that ended since
    for n in (60, 80, 80):
        go(date(2024, 2, 9)).awaitTermination()
        assert lake.read("index_daily").count() == n
    go(date(2024, 2, 29)).awaitTermination()
    rows = lake.read("index_daily").groupBy("trade_date").agg(F.count("*").alias("n"), F.countDistinct("ts_code").alias("codes"), F.max("vol").alias("vol")).collect()
    assert {r.trade_date for r in rows} == {start + timedelta(i) for i in range(60)}
    assert {(r.n, r.codes, r.vol) for r in rows} == {(2, 2, 1.0)}
    assert imports.closed_calls(spec, start, date(2024, 1, 15)) == [{"start_date": "20240101", "end_date": "20240110"}]
