import json
from datetime import date

import pytest

from tidelake.operators import analytics, factors
from tidelake.plans import backtest as b
from tidelake.plans.broker import Bar, Broker, CorporateAction, Rules

SEC = "600000.SH"


def market(closes, volume=1e7):
    return b.Market({f"2024-01-{i + 1:02d}": {SEC: Bar(c, c, c, c, volume)} for i, c in enumerate(closes)})


class Plan:
    """Orders by day: (amount, limit)."""

    def __init__(self, **orders):
        self.orders = orders

    def initialize(self, ctx):
        ctx.set_universe([SEC])

    def handle_data(self, ctx, bars):
        for amount, limit in self.orders.get(f"d{int(ctx.day[-2:])}", []):
            ctx.order(SEC, amount, limit)


def run(closes, cash=100_000.0, volume=1e7, **orders):
    return b.simulate(Plan(**orders), b.Config("2024-01-01", "2024-12-31", cash), market(closes, volume))


def test_round_trip():
    r = run([10, 10, 11, 12, 13, 12, 11, 12, 13, 14], d2=[(1000, None)], d4=[(-1000, None)])
    assert r.nav[-1]["value"] == pytest.approx(101_976.9286) and len(r.nav) == 10
    assert [o["status"] for o in r.orders] == ["8", "8"] and [t["trade_id"] for t in r.trades] == [5001, 5001]


def test_limit_that_expires_keeps_its_fees():
    r = run([10, 10, 9, 8, 11, 12], d2=[(1000, 8.5)])
    assert not r.trades and [o["status"] for o in r.orders] == ["9"]
    assert 100_000 - r.nav[-1]["cash"] == pytest.approx(5 + 8500 * 0.0000487)


def test_limit_that_is_reached():
    r = run([10, 9, 9, 9], d2=[(1000, 9.5)])
    assert len(r.trades) == 1 and r.trades[0]["price"] <= 9.5


def test_day_rules_and_caps():
    # shares of today can't be sold; lots; cash
    r = run([10, 10, 10], d1=[(1050, None), (-1000, None)], d2=[(-1000, None)])
    assert [(t["side"], t["amount"]) for t in r.trades] == [("buy", 1000), ("sell", 1000)]
    r = run([10, 10], cash=5_500.0, d1=[(1000, None)])
    assert r.trades[0]["amount"] == 500
    # a quarter of the volume, shared by the bar's orders; the rest is cancelled
    r = run([10, 10], volume=4000.0, d1=[(800, None), (800, None), (800, None)])
    assert [(o["filled"], o["status"]) for o in r.orders] == [(800, "8"), (200, "6"), (0, "6")]


def test_waiting_orders():
    bar = lambda c, v=1e7: {SEC: Bar(c, c, c, c, v)}
    k = Broker(100_000.0, rules=Rules(slippage=0.002))
    k.start_day("2024-01-01")
    k.tick("t1")
    o = k.order(SEC, 1000, 9.0, bar(10)[SEC])
    assert k.cash == pytest.approx(100_000 - 9009 - (5 + 9009 * 0.0000487)) and o in k.waiting
    assert k.cancel(o.id) and o.status == "6" and not k.waiting and not k.cancel(o.id)
    k.tick("t2")
    o = k.order(SEC, 1000, 9.0, bar(10)[SEC])
    k.tick("t3")
    k.match(bar(9, 2000.0))
    assert (o.filled, o.status, k.positions[SEC].amount) == (500, "6", 500)
    k.start_day("2024-01-02")
    s = k.order(SEC, -500, 12.0, bar(10)[SEC])
    assert k.positions[SEC].enable_amount == 0 and s in k.waiting
    k.expire()
    assert k.positions[SEC].enable_amount == 500 and s.status == "9" and s not in k.orders


def test_corporate_actions():
    k = Broker(10_000.0)
    k.position(SEC).amount = k.position(SEC).enable_amount = 1001
    k.position(SEC).cost_basis = 10.0
    k.apply([CorporateAction(SEC, allotted_ps=0.3, bonus_ps=0.5)])
    p = k.positions[SEC]
    assert p.amount == 1301 and k.cash == pytest.approx(10_000 + 1001 * 0.5 * 0.8)
    assert p.cost_basis == pytest.approx((10_010 - 400.4) / 1301)
    k.apply([CorporateAction(SEC, rationed_ps=1.0, rationed_px=100.0)])  # too dear: left out
    assert p.amount == 1301
    with pytest.raises(ValueError):
        k.apply([CorporateAction(SEC, rationed_ps=1.0, rationed_px=100.0, bonus_ps=0.1)])


def test_lookups_and_callbacks():
    seen = []

    class S:
        def initialize(self, ctx):
            ctx.run_daily(lambda c: seen.append("daily"))

        def before_trading_start(self, ctx):
            seen.append("before")

        def handle_data(self, ctx, bars):
            seen.append("bar")
            if ctx.day == "2024-01-03":
                assert ctx.history(SEC, count=2)[SEC] == [10, 11] and ctx.history(SEC, count=2, include=True)[SEC] == [11, 12]
                assert ctx.history("none", count=1)["none"] == [0.0]
                assert ctx.history(SEC, count=3, include=True, fq="pre")[SEC] == [5, 11, 12]
                assert ctx.get_price(SEC)[SEC] == [11] and ctx.get_price(SEC, end="2030-01-01", count=2)[SEC] == [11, 12]
                ctx.order_target_value(SEC, 12_650)
                assert ctx.get_position(SEC).amount == 1000 and len(ctx.get_trades()) == 1

        def after_trading_end(self, ctx):
            seen.append("after")

    m = market([10, 11, 12])
    m.factors[SEC] = [("2024-01-01", 1.0), ("2024-01-02", 2.0)]
    b.simulate(S(), b.Config("2024-01-01", "2024-12-31", 100_000.0, (SEC,)), m)
    assert seen == ["before", "bar", "daily", "after"] * 3


def test_minutes():
    bars = {f"2024-01-0{d} 09:3{i}:00": {SEC: Bar(c, c, c, c, 1e6)} for d in (2, 3) for i, c in ((1, 10.0), (2, 11.0))}

    class S:
        def initialize(self, ctx):
            pass

        def handle_data(self, ctx, now):
            if ctx.now == "2024-01-02 09:31:00":
                ctx.order(SEC, 100)
            if ctx.now == "2024-01-03 09:32:00":
                ctx.order_target(SEC, 0)

    r = b.simulate(S(), b.Config("2024-01-01", "2024-12-31", 10_000.0, (SEC,), frequency="1m"), b.Market(bars))
    assert [t["trade_time"] for t in r.trades] == ["2024-01-02 09:31:00", "2024-01-03 09:32:00"] and len(r.nav) == 4


class Average:
    def __init__(self, fast=2, slow=3):
        self.fast, self.slow = fast, slow

    def initialize(self, ctx):
        pass

    def handle_data(self, ctx, bars):
        for s in bars:
            h = ctx.history(s, count=self.slow, include=True)[s]
            if len(h) == self.slow:
                ctx.order_target(s, 100 if sum(h[-self.fast :]) / self.fast > sum(h) / self.slow else 0)


def test_many_runs_equal_single_ones(spark):
    rows = [(c, f"2024-01-{d:02d}", 10.0 + (d * k) % 7) for k, c in ((3, "600000.SH"), (5, "000001.SZ")) for d in range(1, 29)]
    bars = spark.createDataFrame(rows, "ts_code string, time string, close double").selectExpr("ts_code", "time", "close AS open", "close AS high", "close AS low", "close", "1e7 AS volume", "0.0 AS amount")
    jobs = [(f"r{i}", "avg" if i else "bad", json.dumps({"fast": 1 + i % 2, "slow": 3 + i}), "2024-01-01", "2024-12-31", 50_000.0, None if i % 2 else ["600000.SH"]) for i in range(5)]
    table = spark.createDataFrame(jobs, "run_id string, strategy string, params string, start string, end string, capital double, universe array<string>")
    out = b.run_many(table, bars, {"avg": Average})
    last = {r.run_id: r for r in out.where("trades is not null or error is not null").collect()}
    assert last["r0"].error.startswith("KeyError") and len(last) == 5
    for run_id, _, params, start, end, capital, universe in jobs[1:]:
        own = bars.toPandas()
        own = own[own.ts_code.isin(universe)] if universe else own
        one = b.simulate(Average(**json.loads(params)), b.Config(start, end, capital, tuple(sorted(own.ts_code.unique()))), b.market_of(own))
        assert last[run_id].value == pytest.approx(one.nav[-1]["value"]) and json.loads(last[run_id].trades) == one.trades
    stats = {r.run_id: r for r in analytics.fifo(b.trades_of(out)).collect()}
    pairs = list(analytics.lot_pairs((t["side"], t["amount"], t["price"]) for t in json.loads(last["r2"].trades)))
    assert stats["r2"].wins == sum(y > x for _, x, y in pairs) and stats["r2"].losses == sum(y < x for _, x, y in pairs)


def test_actions_reach_what_left_the_universe_and_summaries_tell():
    class Leaves:
        def initialize(self, ctx):
            pass

        def handle_data(self, ctx, bars):
            if ctx.day == "2024-01-01":
                ctx.order(SEC, 1000)
                ctx.set_universe(["other"])

    m = market([10, 10, 11, 12])
    m.actions["2024-01-03"] = [CorporateAction(SEC, bonus_ps=0.5)]
    r = b.simulate(Leaves(), b.Config("2024-01-01", "2024-12-31", 100_000.0, (SEC,), benchmark=SEC), m)
    cash = [row["cash"] for row in r.nav]
    assert cash[2] - cash[1] == pytest.approx(1000 * 0.5 * 0.8)
    assert [row["benchmark"] for row in r.nav] == [10, 10, 11, 12]
    assert r.summary["trading_days"] == 4 and r.summary["trade_count"] == r.summary["order_count"] == 1
    assert r.summary["total_return"] == pytest.approx(r.nav[-1]["value"] / 100_000 - 1)


def test_history_of_several_fields():
    seen = {}

    class S:
        def initialize(self, ctx):
            ctx.set_universe([SEC, "none"])

        def handle_data(self, ctx, bars):
            if ctx.day == "2024-01-03":
                seen["table"] = ctx.get_history(2, fields=["close", "volume"], include=True)
                seen["dict"] = ctx.get_history(2, "1d", "close", SEC, shape="dict")
                with pytest.raises(ValueError):
                    ctx.get_history(2, "5m")

    b.simulate(S(), b.Config("2024-01-01", "2024-12-31", 1e5), market([10, 11, 12]))
    assert seen["table"].code.tolist() == [SEC, SEC, "none", "none"] and seen["table"].close.tolist() == [11, 12, 0, 0]
    assert seen["dict"][SEC]["close"].tolist() == [10, 11]


def test_history_of_gaps_equals_a_plain_search():
    import random

    rng = random.Random(8)
    bars = {f"2024-01-{d:02d}": {s: Bar(*[rng.random()] * 4, 5.0) for s in ("a", "b", "c") if rng.random() < 0.5} for d in range(1, 29)}
    m = b.Market({t: x for t, x in bars.items() if x})
    got = []

    class S:
        def initialize(self, ctx):
            ctx.set_universe(["a", "b", "c"])

        def handle_data(self, ctx, now):
            got.append((ctx.day, ctx.history(["a", "b", "c"], count=5), ctx.history(["a"], "volume", 3, include=True)))

    b.simulate(S(), b.Config("2024-01-01", "2024-12-31", 1e5), m)
    times = sorted(m.bars)
    for day, close, volume in got:
        before = [t for t in times if t < day][-5:]
        for s in ("a", "b", "c"):
            want = [next((m.bars[k][s].close for k in reversed(times) if k <= t and s in m.bars[k]), float("nan")) for t in before]
            assert str(close[s]) == str(want)
        upto = [t for t in times if t <= day][-3:]
        first = next(t for t in times if "a" in m.bars[t])
        assert str(volume["a"]) == str([m.bars[t]["a"].volume if "a" in m.bars[t] else 0.0 if t > first else float("nan") for t in upto])


def test_fundamentals_of_a_day():
    m = market([10, 11])
    m.facts["2024-01-01"] = {SEC: {"total_mv": 2.0, "dv_ttm": 1.5}, "b": {"total_mv": None}}
    ctx = b.Context(b.Config("2024-01-01", "2024-12-31"), m)
    ctx.day = "2024-01-01"
    assert [r["code"] for r in ctx.get_fundamentals()] == [SEC, "b"] and ctx.get_fundamentals([]) == []
    assert ctx.get_fundamentals(SEC, "dividend_ratio") == [{"code": SEC, "trading_day": "2024-01-01", "total_value": 20000.0, "dividend_ratio": "1.500000%"}]
    assert ctx.get_fundamentals("none") == [] and ctx.get_fundamentals(SEC, day="2024-01-02") == []
    for bad in ({"table": "growth"}, {"fields": "nope"}, {"start_year": 2020}):
        with pytest.raises(ValueError):
            ctx.get_fundamentals(SEC, **bad)


def test_runs_without_a_nested_loop(spark):
    rows = [(c, f"2024-01-{d:02d}", 10.0 + d) for c in ("a", "b", "c") for d in range(1, 20)]
    bars = spark.createDataFrame(rows, "ts_code string, time string, close double").selectExpr("ts_code", "time", "close AS open", "close AS high", "close AS low", "close", "1e7 AS volume", "0.0 AS amount")
    jobs = spark.createDataFrame([("x", "s", None, "2024-01-10", "2024-01-15", 1e5, ["a"], "b"), ("y", "s", None, "2024-01-10", "2024-01-15", 1e5, None, None)], "run_id string, strategy string, params string, start string, end string, capital double, universe array<string>, benchmark string")
    own = b.bars_of_runs(jobs, bars, warmup=3)
    assert "NestedLoop" not in own._jdf.queryExecution().toString()
    seen = {}
    for r in own.collect():
        seen.setdefault(r.run_id, set()).add((r.ts_code, r.time))
    assert seen == {"x": {(c, f"2024-01-{d:02d}") for c in ("a", "b") for d in range(7, 16)}, "y": {(c, f"2024-01-{d:02d}") for c in ("a", "b", "c") for d in range(7, 16)}}


def test_job_ledger(tmp_path):
    jobs = b.JobLedger(tmp_path)
    jobs.put({"run_id": "a", "status": "running", "created_at": "1"})
    jobs.put({"run_id": "b", "status": "done", "created_at": "2"})
    again = b.JobLedger(tmp_path)
    assert again.get("a")["status"] == "failed" and [j["run_id"] for j in again.list()] == ["b", "a"]


def test_factor_registry(tmp_path):
    reg = factors.FactorRegistry(tmp_path / "f.json")
    reg.put(factors.Factor("m20", "momentum", "m", {"window": 20}))
    assert factors.FactorRegistry(tmp_path / "f.json").get("m20").window == 20
    for bad in (factors.Factor("", "momentum", "m"), factors.Factor("x", "nope", "m"), factors.Factor("x", "momentum", "m", {"window": 1.5}), factors.Factor("x", "size", "m", {"log": "maybe"}), factors.Factor("x", "size", "m", direction="up")):
        with pytest.raises(ValueError):
            reg.put(bad)
    reg.delete("m20")
    assert reg.list() == [] and len(factors.catalog()) == 6


def test_statistics(spark):
    from pyspark.sql import functions as F

    from tidelake.operators import stats

    rows = spark.createDataFrame([(i, float(i), 2.0 * i, -1.0 * i, 5.0) for i in range(1, 6)], "k int, x double, up double, down double, flat double")
    one = rows.agg(stats.pearson("x", "up").alias("a"), stats.pearson("x", "down").alias("b"), stats.pearson("x", "flat").alias("c"), stats.positive_share(F.col("x") - 2).alias("p")).first()
    assert one.a == pytest.approx(1) and one.b == pytest.approx(-1) and one.c is None and one.p == pytest.approx(0.6)
    ranks = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "k int, v int").select("k", F.lit(1).alias("g"), "v").select("k", stats.average_rank("v", ["g"]).alias("r"))
    assert [r.r for r in ranks.orderBy("k").collect()] == [1, 2.5, 2.5, 4]


def test_tracking(spark):
    rows = [(f"c{k}", date(2024, 1, 1 + d), 10.0 + k * 0.1 * d) for k in range(1, 9) for d in range(20)]
    panel = spark.createDataFrame(rows, "ts_code string, trade_date date, close double")
    found = factors.track(panel, factors.Factor("m", "momentum", "m", {"window": 2}), date(2024, 1, 1), date(2024, 1, 20), horizon=2, layers=3)
    ic = {r.trade_date: r.rank_ic for r in found.ic.collect()}
    assert len(ic) == 20 and ic[date(2024, 1, 1)] is None and ic[date(2024, 1, 10)] == pytest.approx(1.0)
    sizes = {r.layer: r.n for r in found.layers.where("trade_date = '2024-01-10'").collect()}
    assert sizes == {0: 2, 1: 2, 2: 4}  # the remainder is the last layer's
    s = found.stats.first()
    assert s.samples == 20 and s.top_layer_avg > s.bottom_layer_avg


def test_streams(spark, tmp_path):
    from tidelake.sources.lake import Lake
    from tidelake.streaming import bars

    rows = [(1, f"2024-01-01 10:{m:02d}:00", float(m)) for m in (1, 5, 5, 59)] + [(1, "2024-01-01 13:00:00", 1.0)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = bars.tumbling_bars(read()).writeStream.format("memory").queryName("ohlc").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = spark.table("ohlc").orderBy("start").first()
    assert (first.open, first.high, first.low, first.close, first.vol) == (1.0, 59.0, 1.0, 59.0, 4)
    q = bars.without_repeats(read(), ["user_id", "value"], "ts", "5 hours").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    lake = Lake(spark, str(tmp_path / "lake"))
    cal = read().selectExpr("cast(user_id as string) exchange", "cast(ts as date) cal_date", "cast(1 as long) is_open", "cast(null as date) pretrade_date")
    for _ in range(2):
        bars.into_lake(cal, lake, "trade_cal", str(tmp_path / "c3")).awaitTermination()
    assert lake.read("trade_cal").count() == 5


def test_waiting_orders_are_tried_once_a_bar(monkeypatch):
    from tidelake.plans import broker, strategies

    tries, held = [], broker.reaches
    monkeypatch.setattr(broker, "reaches", lambda *a: tries.append(1) or held(*a))
    codes = [f"{600000 + i}.SH" for i in range(300)]
    bars = {f"2024-01-0{d}": {c: b.Bar(10.0, 10.0, 10.0, 10.0 - d / 100, 1e6) for c in codes} for d in (2, 3)}
    r = b.simulate(strategies.Limits(0.99), b.Config("2024-01-01", "2024-12-31", 1e8, tuple(codes)), b.Market(bars))
    assert len(r.orders) == 600 and len(tries) <= 4 * 600


def test_positions_are_added_up_when_asked(monkeypatch):
    sums = []
    monkeypatch.setattr(Broker, "_settle", lambda self, f=Broker._settle: (sums.append(1) if self._stale else None, f(self)) and None)
    from tidelake.plans import strategies

    codes = [f"{600000 + i}.SH" for i in range(200)]
    bars = {f"2024-01-0{d}": {c: b.Bar(10.0, 10.0, 10.0, 10.0, 1e6) for c in codes} for d in (2, 3)}
    r = b.simulate(strategies.Hold(2), b.Config("2024-01-01", "2024-12-31", 1e8, tuple(codes)), b.Market(bars))
    assert len(r.trades) == 400 and len(sums) <= 8
    assert r.nav[0]["positions_value"] == pytest.approx(200 * 100 * 10.0) and r.nav[1]["positions_value"] == 0


def test_hold_buys_all_on_credit():
    from tidelake.plans import strategies

    codes = ("600000.SH", "600001.SH", "600002.SH")
    bars = {f"2024-01-0{d}": {c: b.Bar(10.0, 10.0, 10.0, 10.0, 1e6) for c in codes} for d in (2, 3)}
    r = b.simulate(strategies.Hold(2, 0.0), b.Config("2024-01-01", "2024-12-31", 1500.0, codes), b.Market(bars))
    assert [t["amount"] for t in r.trades] == [100] * 6 and r.nav[0]["cash"] < 0 and r.nav[1]["cash"] > 1400


def test_runs_that_pass_by_tell_what_whole_ones_do(spark):
    from pyspark.sql import functions as F

    from tidelake.plans import strategies

    rows = [(f"{600000 + c}.SH", f"2024-01-{d:02d}", *[10.0 + (c * d) % 7] * 4, 5000.0, 1.0, float((c * d) % 11)) for c in range(40) for d in range(1, 29) if (c + d) % 5]
    bars = spark.createDataFrame(rows, "ts_code string, time string, open double, high double, low double, close double, volume double, amount double, amount_rank double")
    kinds = [("a", "averages", {}), ("r", "rotation", {}), ("l", "limits", {}), ("h", "hold", {"until": 9}), ("x", "none", {})]
    jobs = spark.createDataFrame([(i, s, json.dumps(p), "2024-01-05", "2024-12-31", 90_000.0, None if i != "a" else [f"{600000 + c}.SH" for c in range(30)], "600003.SH") for i, s, p in kinds], "run_id string, strategy string, params string, start string, end string, capital double, universe array<string>, benchmark string")
    actions = spark.createDataFrame([(f"{600000 + c}.SH", d, 0.1, 0.0, 0.0, 0.5) for c in range(0, 40, 3) for d in ("2024-01-07", "2024-01-08")], "ts_code string, ex_date string, allotted_ps double, rationed_ps double, rationed_px double, bonus_ps double")
    whole = b.run_many(jobs, bars, strategies.ALL, actions).cache()
    by = b.navs(jobs, bars, strategies.ALL, actions)
    same = ["run_id", "time", "value", "cash", "positions_value", "returns", "benchmark", "summary", "error"]
    want = sorted(map(tuple, whole.select(same).collect()), key=repr)
    assert sorted(map(tuple, by.select(same).collect()), key=repr) == want and len(want) == 4 * 24 + 1
    trades = b.run_trades(jobs, bars, strategies.ALL, actions)
    assert sorted(map(tuple, trades.collect())) == sorted(map(tuple, b.trades_of(whole).select(trades.columns).collect())) and trades.select(F.count_distinct("run_id")).first()[0] == 3


def test_passing_keeps_what_is_looked_back_on():
    import numpy as np

    from tidelake.plans.passing import Passing

    m = Passing({"close": 2})
    for d in range(1, 10):
        m.push(f"2024-01-0{d}", ["a"] if d == 1 else ["b", "c"], np.full((1 if d == 1 else 2, 6), float(d)), {})
    assert len(m.kept) == 3 and m.values(["a", "b", "z"], m.times[-2:], "close") == {"a": [1.0, 1.0], "b": [8.0, 9.0], "z": [0.0, 0.0]}
    with pytest.raises(ValueError):
        m.values(["a"], m.times[:2], "close")
