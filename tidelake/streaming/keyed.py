"""Keyed state with timers: orders that expire, positions that reset with the day, rolling windows of bounded size.

State is in lists and values of a key; timers in event time evict what the watermark has passed, so that state doesn't
outlive its use. A batch's rows of a key are taken in the order of time; what comes later than the watermark is dropped by it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

_STORE = "spark.sql.streaming.stateStore.providerClass"


def started(writer: DataStreamWriter, spark) -> StreamingQuery:
    """Starts a query that keeps its state in RocksDB, which timers need; the session's own choice comes back after it."""
    was = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        if was is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, was)


def _micros(life: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(life).total_seconds() * 1_000_000)


def _timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    return rows.withColumn(at, F.col(at).cast("timestamp_ltz")).withWatermark(at, late).withColumn("time_us", F.unix_micros(at))


def _sorted(rows: Iterator, *by: str):
    import pandas as pd

    parts = [r for r in rows if len(r)]
    return pd.concat(parts).sort_values(list(by), kind="stable") if parts else pd.DataFrame(columns=list(by))


def _ms(micros: int) -> int:
    return -(-micros // 1000)


class _Expiry(StatefulProcessor):
    def __init__(self, key: str, order: str, life: int):
        self.key, self.order, self.life = key, order, life

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getListState("open", "id string, at long")

    def _told(self, key, ended):
        import pandas as pd

        return pd.DataFrame({self.key: [key[0]] * len(ended), "order": [e[0] for e in ended], "status": [e[1] for e in ended], "ended": [e[2] for e in ended]})

    def _keep(self, held) -> None:
        if held:
            self.open.put(held)
        elif self.open.exists():
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        held, ended = [(r[0], r[1]) for r in self.open.get()], []
        for r in _sorted(rows, "time_us").itertuples():
            own, t, event = r[1], int(r[2]), r[3]
            if event == "placed":
                held.append((own, t))
                self.handle.registerTimer(_ms(t + self.life))
                continue
            ends = [o for o in held if (own is None or own == o[0]) and o[1] < t <= o[1] + self.life]
            ended += [(i, event, t) for i, _ in ends]
            held = [o for o in held if o not in ends]
        self._keep(held)
        if ended:
            yield self._told(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [(r[0], r[1]) for r in self.open.get()] if self.open.exists() else []
        gone = [(i, "expired", t + self.life) for i, t in held if t + self.life <= now]
        if gone:
            self._keep([o for o in held if o[1] + self.life > now])
            yield self._told(key, gone)

    def close(self) -> None:
        pass


def expiring_orders(orders: DataFrame, key: str = "order_id", at: str = "ts", life: str = "6 hours", order: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, order, status, ended) of a stream of (key, at, event: placed, filled or cancelled), as orders end.

    A key may have many open orders; ``order`` names the column with their ids (by default the key itself is the only id). An event with an
    id ends that order, one with a null id all open orders of the key, if they were placed before it and no longer ago than ``life``. What
    nothing ends expires: it is told once the watermark has passed its placing by ``life``, at that time.
    """
    kind = orders.schema[key].dataType.simpleString()
    rows = _timed(orders, at, late).select(key, F.col(order or key).cast("string").alias("order"), "time_us", "event", at)
    shown = rows.groupBy(key).transformWithStateInPandas(_Ordered(_Expiry(key, "order", _micros(life)), ["order", "time_us", "event"]), f"{key} {kind}, order string, status string, ended long", "Append", "EventTime")
    return shown.withColumn("ended", F.timestamp_micros("ended"))


class _Ordered(StatefulProcessor):
    """A processor that gets the named columns of each row, in this order."""

    def __init__(self, inner: StatefulProcessor, columns: list[str]):
        self.inner, self.columns = inner, columns

    def init(self, handle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        yield from self.inner.handleInputRows(key, (r[self.columns] for r in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.inner.close()


class _Positions(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.state = handle.getValueState("position", "held long, sellable long, day long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held, sellable, day = self.state.get() if self.state.exists() else (0, 0, -1)
        out = []
        for r in _sorted(rows, "time_us", "id").itertuples():
            own, today, amount = int(r[1]), int(r[3]), int(r[4])
            if today != day:
                day, sellable = today, held
            n = amount if amount > 0 else -min(-amount, sellable)
            held, sellable = held + n, sellable + min(n, 0)
            out.append((own, n, held, sellable))
        self.state.update((held, sellable, day))
        if out:
            ids, done, all_, free = zip(*out)
            yield pd.DataFrame({self.key: [key[0]] * len(out), "id": ids, "done": done, "held": all_, "sellable": free})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from ()

    def close(self) -> None:
        pass


def positions(fills: DataFrame, key: str, at: str = "ts", id: str = "id", amount: str = "amount", late: str = "0 seconds") -> DataFrame:
    """(key, id, done, held, sellable) for each fill of a stream: what was bought can be sold from the next day on.

    A sale of more than is sellable is done as far as that goes. The day's bought shares become sellable with the key's first fill of another day.
    """
    kind = fills.schema[key].dataType.simpleString()
    rows = _timed(fills, at, late).select(key, F.col(id).cast("long").alias("id"), "time_us", F.unix_date(F.to_date(at)).alias("day"), F.col(amount).cast("long").alias("amount"), at)
    return rows.groupBy(key).transformWithStateInPandas(_Ordered(_Positions(key), ["id", "time_us", "day", "amount"]), f"{key} {kind}, id long, done long, held long, sellable long", "Append", "EventTime")


class _Rolling(StatefulProcessor):
    def __init__(self, key: str, span: int, most: int):
        self.key, self.span, self.most = key, span, most

    def init(self, handle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "at long, value double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held, out = [(r[0], r[1]) for r in self.rows.get()], []
        for r in _sorted(rows, "time_us", "id").itertuples():
            own, t, value = int(r[1]), int(r[2]), float(r[3])
            held = [h for h in [*held, (t, value)] if h[0] > t - self.span][-self.most :]
            out.append((own, len(held), sum(v for _, v in held), max(v for _, v in held)))
        if held:
            self.rows.put(held)
            self.handle.registerTimer(_ms(held[-1][0] + self.span))
        if out:
            ids, n, total, high = zip(*out)
            yield pd.DataFrame({self.key: [key[0]] * len(out), "id": ids, "n": n, "total": total, "high": high})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a key that has been still for the whole span keeps nothing
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.rows.exists() and all(r[0] + self.span <= now for r in self.rows.get()):
            self.rows.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling(ticks: DataFrame, key: str, span: str, most: int, at: str = "ts", id: str = "id", value: str = "value", late: str = "0 seconds") -> DataFrame:
    """(key, id, n, total, high) for each row of a stream, over the key's rows of the last ``span`` of time up to it, ``most`` rows at most."""
    kind = ticks.schema[key].dataType.simpleString()
    rows = _timed(ticks, at, late).select(key, F.col(id).cast("long").alias("id"), "time_us", F.col(value).cast("double").alias("value"), at)
    return rows.groupBy(key).transformWithStateInPandas(_Ordered(_Rolling(key, _micros(span), most), ["id", "time_us", "value"]), f"{key} {kind}, id long, n long, total double, high double", "Append", "EventTime")
