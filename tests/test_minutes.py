"""Minutes without gaps: the dense series is made where its minutes are."""

import math
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidelake.operators import carry, timeseries


def moved(spark, rows):
    """Rows that all shuffles of a run wrote, and the rows it gave."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    at = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for found in [stages()] for i in range(found.size()))}
    before = at()
    n = len(rows.collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(v for k, v in at().items() if k not in before), n


DAYS = [date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 8)]
CLOCK = [datetime(d.year, d.month, d.day) + timedelta(minutes=m) for d in DAYS for a, b in timeseries.SESSIONS for m in range(a, b + 1)]


def frames(spark, minutes, daily):
    bars = spark.createDataFrame(minutes, "ts_code string, trade_time timestamp_ntz, open double, high double, low double, close double, vol double, amount double").repartition(3)
    return bars, spark.createDataFrame([(d,) for d in DAYS], "trade_date date"), spark.createDataFrame(daily, "ts_code string, trade_date date, close double")


def test_only_the_minutes_there_are_move(spark):
    at = [CLOCK[i] for i in (0, 7, 300, 719)]
    bars, days, daily = frames(spark, [(f"c{k}", t, 1.0, 1.0, 1.0, float(k), 1.0, 1.0) for k in range(20) for t in at], [("seed", date(2024, 1, 2), 3.0)])
    shuffled, rows = moved(spark, timeseries.minute_filled(bars, days, daily))
    assert rows == 21 * len(CLOCK) and shuffled < rows / 10


def test_against_slot_after_slot(spark):
    """Gaps, null closes, minutes beside the slots and days, codes with closes of earlier days alone, and with none."""
    rng = random.Random(3)
    own, minutes = {}, []
    for k in range(12):
        code = f"c{k:02d}"
        times = sorted(rng.sample(CLOCK, rng.choice([0, 1, 5, 60]))) if k < 10 else []
        own[code] = {t: (*[round(rng.uniform(5, 9), 2) for _ in range(3)], None if rng.random() < (1.0 if k in (3, 4) else 0.3) else round(rng.uniform(5, 9), 2), rng.choice([None, 4.0]), 7.0) for t in times}
        minutes += [(code, t, *v) for t, v in own[code].items()]
        beside = [datetime(2024, 1, 3, 9, 30), datetime(2024, 1, 3, 12, 0), datetime(2024, 1, 3, 9, 31, 5), datetime(2024, 1, 5, 10, 0), datetime(2024, 1, 2, 10, 0), datetime(2024, 1, 9, 10, 0)]
        minutes += [(code, t, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for t in rng.sample(beside, 3)]
    minutes.append((None, CLOCK[5], 1.0, 1.0, 1.0, 1.0, 1.0, 1.0))
    seeds = {f"c{k:02d}": v for k, v in enumerate([3.0, None, 0.0, 4.5, -1.0, 2.0, 2.5, None, 8.0, None, 6.0])}
    daily = [(c, date(2024, 1, 2), v) for c, v in seeds.items()] + [(c, date(2023, 12, 29), 99.0) for c in seeds] + [("c11", date(2024, 1, 3), 5.0), (None, date(2024, 1, 2), 5.0)]
    want = {}
    for code, bars in own.items():
        seed, last = seeds.get(code), None
        none = all(v[3] is None for v in bars.values())
        for t in CLOCK:
            o, h, lo, c, vol, amount = bars.get(t, (None,) * 6)
            last = c if c is not None else last
            fill = last if last is not None else seed
            if last is not None or (none and seed is not None and seed > 0):
                want[code, t] = (*[fill if x is None else x for x in (o, h, lo, c)], vol or 0.0, amount if c is not None else "nan", c is None)
    found = timeseries.minute_filled(*frames(spark, minutes, daily)).collect()
    got = {(r[0], r[1]): (*r[2:7], "nan" if math.isnan(r[7]) else r[7], r[8]) for r in found}
    assert len(found) == len(got) and got == want and len({c for c, _ in want}) > 6


def test_lead(spark):
    frame = spark.range(40).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    got = {r.id: r.x for r in carry.running(frame, ["k"], ["id"], {"x": carry.lead("v")}, blocks=8).collect()}
    assert got == {i: i + 2 if i + 2 < 40 and (i + 2) % 3 else None for i in range(40)}
