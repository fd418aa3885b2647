import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.operators import analytics, carry

KINDS = ("last", "next", "first", "lag", "sum", "max", "min", "product", "peak")


def plain(values):
    """Each kind of running value over one key's values, in order."""
    known = [v for v in values if v is not None]
    out = []
    for i in range(len(values)):
        upto = [v for v in values[: i + 1] if v is not None]
        after = [v for v in values[i:] if v is not None]
        sums = [sum(v for v in values[: j + 1] if v is not None) for j in range(i + 1) if any(v is not None for v in values[: j + 1])]
        product = 1.0
        for v in upto:
            product *= v
        out.append((upto[-1] if upto else None, after[0] if after else None, known[0] if known else None, values[i - 1] if i else None, sum(upto) if upto else None, max(upto, default=None), min(upto, default=None), product, max(sums, default=None)))
    return out


def times(kind, i):
    return {"date": lambda: date(2020, 1, 1) + timedelta(i), "ntz": lambda: datetime(2020, 1, 1) + timedelta(minutes=7 * i), "long": lambda: i - 50, "double": lambda: i / 3}[kind]()


@pytest.mark.parametrize("kind,sql", [("date", "date"), ("ntz", "timestamp_ntz"), ("long", "long"), ("double", "double")])
def test_all_kinds(spark, kind, sql):
    rng = random.Random(kind)
    rows, want = [], {}
    for key, n in (("hot", 120), ("one", 1), (None, 9), ("empty", 6), ("late", 5)):
        values = [None if key == "empty" or rng.random() < 0.3 else float(rng.choice([-2, -1, 0.5, 1, 2, 3, 0] if key == "late" else [-2, -1, 0.5, 1, 2])) for _ in range(n)]
        start = 100 if key == "late" else 0
        rows += [(key, times(kind, start + i), i, v) for i, v in enumerate(values)]
        want |= {(key, i): x for i, x in enumerate(plain(values))}
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, f"k string, t {sql}, i long, v double").repartition(3)
    found = carry.running(frame, ["k"], ["t", "i"], {f"r_{k}": carry.Running(k, F.col("v")) for k in KINDS}, blocks=16)
    assert found.columns == ["k", "t", "i", "v", *[f"r_{k}" for k in KINDS]]
    got = {(r.k, r.i): tuple(r)[4:] for r in found.collect()}
    assert got.keys() == want.keys()
    for place, row in want.items():
        for k, a, b in zip(KINDS, row, got[place]):
            assert b == pytest.approx(a), (place, k)


def test_a_hot_key_is_spread_over_tasks(spark):
    """All rows are of one key; no task has more than a few of its blocks, and the plan has no exchange by the key alone but for the blocks' own rows."""
    frame = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = carry.running(frame, ["k"], ["t"], {"s": carry.total("v"), "m": carry.most("v")}).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 4_000
        assert out.agg(F.max("s")).first()[0] == sum(i % 7 for i in range(20_000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(spark):
    empty = spark.createDataFrame([], "k string, t date, v double")
    assert carry.running(empty, ["k"], ["t"], {"v": carry.last("v")}).count() == 0
    rows = spark.createDataFrame([("a", None, 1.0), ("a", date(2020, 1, 1), None), ("a", date(2020, 1, 2), 3.0)], "k string, t date, v double")
    assert [r.v for r in carry.running(rows, ["k"], ["t"], {"v": carry.last("v")}).orderBy("t").collect()] == [1.0, 1.0, 3.0]
    for bad in ({"k": carry.last("v")}, {"t": carry.last("v")}):
        with pytest.raises(ValueError):
            carry.running(rows, ["k"], ["t"], bad)
    with pytest.raises(ValueError):
        carry.running(rows, ["k"], ["t"], {"x": carry.Running("mean", F.col("v"))})
    with pytest.raises(ValueError):
        carry.running(rows.withColumn("b", F.lit(True)), ["k"], ["b"], {"x": carry.last("v")})
    text = spark.createDataFrame([("a", f"2024-01-{i:02d}", float(i)) for i in range(1, 29)], "k string, t string, v double")
    assert [r.s for r in carry.running(text, ["k"], ["t"], {"s": carry.total("v")}, blocks=4).orderBy("t").collect()] == [i * (i + 1) / 2 for i in range(1, 29)]


def test_lots(spark):
    """Sales before, between and beyond purchases, at equal times and of equal amounts, against one trade after the other."""
    rng = random.Random(7)
    trades, want = [], {}
    for k in range(12):
        own = []
        for i in range(60):
            own.append((rng.choice(["buy", "sell", "sell"] if k % 3 == 0 else ["buy", "buy", "sell"]), rng.choice([100.0, 200.0, 0.5, 300.0]), round(rng.uniform(5, 15), 2)))
        want[k] = sorted((round(n, 6), a, b) for n, a, b in analytics.lot_pairs(own))
        trades += [("r", str(k), side, amount, price, datetime(2024, 1, 2) + timedelta(hours=i // 3), i) for i, (side, amount, price) in enumerate(own)]
    rng.shuffle(trades)
    frame = spark.createDataFrame(trades, "run_id string, security string, side string, amount double, price double, trade_time timestamp_ntz, trade_id long").repartition(3)
    found = analytics.lots(frame, ["run_id", "security"])
    got = {k: [] for k in want}
    for r in found.collect():
        got[int(r.security)].append((round(r.amount, 6), r.buy_price, r.sell_price))
    assert {k: sorted(v) for k, v in got.items()} == want and sum(map(len, want.values())) > 200
    row = analytics.fifo(frame).first()
    gains = [n * (b - a) for v in want.values() for n, a, b in v]
    assert row.wins == sum(g > 0 for g in gains) and row.losses == sum(g < 0 for g in gains)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    # what matches nothing: no trades of one side, null amounts
    odd = spark.createDataFrame([("x", "a", "sell", 5.0, 1.0, "2024-01-02", 1), ("x", "a", "buy", None, 1.0, "2024-01-03", 2), ("x", "a", "buy", 0.0, 1.0, "2024-01-04", 3)], "run_id string, security string, side string, amount double, price double, trade_time string, trade_id long")
    assert [tuple(r) for r in analytics.fifo(odd).collect()] == [("x", 0, 0, 0.0, 0.0)]


def test_lots_move_once_unless_a_key_is_large(spark):
    """The same lots by key and by blocks of time, also of keys that are large among others; keys a task can scan take one shuffle of their trades."""
    rng = random.Random(11)
    rows = [(k, rng.choice(["buy", "sell"]), float(rng.choice([1, 2, 3])), round(rng.uniform(5, 15), 2), rng.randrange(40), i) for k, n in (("a", 400), ("b", 30), (None, 30), *[(f"k{j}", 3) for j in range(20)]) for i in range(n)]
    frame = spark.createDataFrame(rows, "security string, side string, amount double, price double, trade_time long, trade_id long").repartition(3)
    found = {most: analytics.lots(frame, ["security"], most=most) for most in (1, 25, 200, 1000)}
    plans = {most: lots._jdf.queryExecution().executedPlan().toString() for most, lots in found.items()}
    assert plans[1000].count("Exchange hashpartitioning") == 1
    assert "__block" not in plans[1000] and "__block" in plans[200]
    got = {most: sorted(map(tuple, lots.collect()), key=repr) for most, lots in found.items()}
    assert got[1] == got[25] == got[200] == got[1000]
    want = {}
    for k, side, amount, price, t, i in sorted(rows, key=lambda r: r[4:]):
        want.setdefault(k, []).append((side, amount, price))
    assert got[200] == sorted(((k, a, b, n) for k, own in want.items() for n, a, b in analytics.lot_pairs(own)), key=repr)
