"""Runs that pass through their bars: what they keep, and what their rows carry."""

import json

import duckdb
import numpy as np
import pytest

from tidelake.plans import backtest as b
from tidelake.plans import backtest_catalog, catalog, strategies  # noqa: F401  the first adds to the second
from tidelake.plans.broker import Bar
from tidelake.plans.passing import PRICES, Passing


def test_trades_of_a_day_pass_unless_the_strategy_asks_for_orders():
    n = 2 * b.HANDED + 500
    codes, values = [f"{i:06d}.SZ" for i in range(n)], np.tile([10.0, 10.0, 10.0, 10.0, 1e9, 0.0], (n, 1))
    bars = [Bar(*values[0])] * n
    whole = b.simulate(strategies.Hold(2), b.Config("2024-01-01", "2024-12-31", 1e8, tuple(codes)), b.Market({t: dict(zip(codes, bars)) for t in ("2024-01-02", "2024-01-03", "2024-01-04")}))
    market, got, held = Passing({}), [], []
    run = b.Run(strategies.Hold(2), b.Config("2024-01-01", "2024-12-31", 1e8), market, True, lambda trades: (got.extend(b.asdict(t) for t in trades), held.append((len(trades), len(run.ctx.broker.orders)))))
    for t in ("2024-01-02", "2024-01-03", "2024-01-04"):
        market.push(t, [c[:3] + c[3:] for c in codes], values, {})
        run.step(t, market.now, True)
    told = run.result()
    assert got == whole.trades and max(held) == (b.HANDED, 0)
    assert told.nav == whole.nav and told.summary == whole.summary and told.summary["order_count"] == 2 * n
    # one text a code, of the first day, whatever texts later days come with
    assert all(a is c for a, c in zip(market.now.codes, market.ids))
    with pytest.raises(ValueError):
        run.ctx.get_orders()


class FailsLate(strategies.Hold):
    def handle_data(self, ctx, bars):
        super().handle_data(ctx, bars)
        if self.seen == 3:
            raise RuntimeError("late")


def test_jobs_come_once_and_runs_that_fail_late_have_no_trades(spark):
    bars = spark.createDataFrame([(f"{c:06d}.SZ", f"2024-01-0{d}", *[10.0 + c] * 4, 1e7, 1.0) for c in range(5) for d in (2, 3, 4)], "ts_code string, time string, open double, high double, low double, close double, volume double, amount double")
    jobs = spark.createDataFrame([(k, k, json.dumps({"until": 2}), "2024-01-01", "2024-12-31", 1e6, u) for k, u in (("hold", None), ("late", None), ("none", ["x"]), ("unknown", ["y"]))], "run_id string, strategy string, params string, start string, end string, capital double, universe array<string>")
    known = {"hold": strategies.Hold, "late": FailsLate, "none": strategies.Hold}
    trades = b.run_trades(jobs, bars, known)
    assert {(r.run_id, r["count"]) for r in trades.groupBy("run_id").count().collect()} == {("hold", 10)}
    # rows move without their jobs
    exchange = next(x for x in trades._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow" in x)
    assert "params" not in exchange
    errors = {r.run_id: r.error for r in b.navs(jobs, bars, known).collect() if r.error}
    assert errors == {"late": "RuntimeError: late"}


def test_trades_of_a_held_run_that_fails_are_an_error(spark, sf_dir, monkeypatch):
    monkeypatch.setitem(strategies.ALL, "hold", FailsLate)
    with pytest.raises(Exception, match="run hold failed: RuntimeError: late"):
        catalog.QUERIES["backtest_hold_trades"](spark, sf_dir).collect()


def test_held_trades_without_a_code_equal_the_sql(spark, sf_dir, tmp_path):
    own = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"copy (select * replace (case when user_id % 3 = 0 then null else user_id end as user_id) from '{sf_dir}/events.parquet') to '{own}'")
    con.sql(f"create view events as select * from '{own}'")
    want = sorted(map(str, con.sql(catalog.ORACLE["backtest_hold_trades"]).fetchall()))
    got = catalog.QUERIES["backtest_hold_trades"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == want and [r.side for r in got if r.security is None] == ["buy"]


def test_strict_runs_that_fail_without_bars_are_an_error():
    with pytest.raises(RuntimeError, match="run x failed: KeyError: 'none'"):
        list(b._Task("x", {"strategy": "none", "params": None}, {}, "trades", strict=True).results())


class FailsLateToo(strategies.Rotation):
    def handle_data(self, ctx, bars):
        super().handle_data(ctx, bars)
        if self.seen == 20:
            raise RuntimeError("late")


def test_trades_of_runs_of_which_one_fails_are_an_error(spark, sf_dir, monkeypatch):
    monkeypatch.setitem(strategies.ALL, "rotation", FailsLateToo)
    with pytest.raises(Exception, match="run rotation-3 failed: RuntimeError: late"):
        catalog.QUERIES["backtest_trades"](spark, sf_dir).collect()


def test_lots_of_runs_of_which_one_fails_are_an_error(spark, sf_dir, monkeypatch):
    monkeypatch.setitem(strategies.ALL, "rotation", FailsLateToo)
    with pytest.raises(Exception, match="run rotation-3 failed: RuntimeError: late"):
        catalog.QUERIES["fifo_lot_stats"](spark, sf_dir).collect()


def test_strict_runs_fail_when_rows_are_added_not_in_the_end():
    import pyarrow as pa

    day = pa.record_batch({"ts_code": ["a"], **{p: [10.0] for p in PRICES}})
    job = {"strategy": "late", "params": None, "start": "2024-01-01", "end": "2024-12-31", "capital": 1e6, "universe": None, "benchmark": None}
    task = b._Task("x", job, {"late": FailsLate}, "trades", strict=True)
    with pytest.raises(RuntimeError, match="run x failed: RuntimeError: late") as told:
        for d in range(2, 9):
            task.add(f"2024-01-0{d}", day)
    assert d < 8 and str(told.value.__cause__) == "late"
