"""Time-series operators: calendars, dense grids, as-of lookups, fills, auction folding, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators import carry

#: The minute slots of a trading day, first and last of each session, in minutes after midnight.
SESSIONS = ((9 * 60 + 31, 11 * 60 + 30), (13 * 60 + 1, 15 * 60))


def calendar(bars: DataFrame, day: str = "trade_date") -> DataFrame:
    """The distinct days with any bar, ascending."""
    return bars.select(day).distinct().orderBy(day)


def calendar_tail(days: DataFrame, upto: Column, n: int, day: str = "trade_date") -> DataFrame:
    """The last n days up to a day, ascending."""
    return days.where(F.col(day) <= upto).orderBy(F.desc(day)).limit(n).orderBy(day)


def minute_clock(days: DataFrame, day: str = "trade_date") -> DataFrame:
    """(day, trade_time): the 240 slots of each trading day."""
    slots = F.concat(*[F.sequence(F.lit(a), F.lit(b)) for a, b in SESSIONS])
    each = days.select(day, F.explode(slots).alias("slot"))
    return each.select(day, (F.col(day).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("slot"))).alias("trade_time"))


def grid(days: DataFrame, codes: DataFrame) -> DataFrame:
    """Every day for every code: as many rows as the dense series has."""
    return codes.crossJoin(days)


def forward_filled(bars: DataFrame, slots: DataFrame, code: str, at: str, price: str, zeros: list[str], blanks: list[str] | None = None) -> DataFrame:
    """Slots with the bars' values; where a bar is missing, the last price before it, zeros and blanks (NaN).

    A code that has no bar up to a slot has a null price there. A code's slots are filled in blocks of time (carry.py).
    """
    joined = slots.join(bars.withColumn("__has", F.lit(True)), [code, at], "left")
    out = carry.running(joined, [code], [at], {price: carry.last(price)})
    fills = {c: 0.0 for c in zeros} | {c: float("nan") for c in blanks or []}
    for c, v in fills.items():
        out = out.withColumn(c, F.when(F.col("__has"), F.col(c)).otherwise(F.lit(v).cast(bars.schema[c].dataType)))
    return out.withColumn("suspended", F.col("__has").isNull()).drop("__has")


#: Fixed value: rows that a window of minutes may have.
MINUTE_ROWS = 3_000_000


#: Slots of a day, and those before each session.
DAY_SLOTS = sum(b - a + 1 for a, b in SESSIONS)
_BEFORE = [sum(b - a + 1 for a, b in SESSIONS[:i]) for i in range(len(SESSIONS))]

#: Fixed value: slots of a block of minutes at least, those of 31 days.
BLOCK_SLOTS = 31 * DAY_SLOTS


def _slot(minute: Column) -> Column:
    """The slot of a day that a minute after midnight is; null if it is none."""
    return F.coalesce(*[F.when(minute.between(a, b), minute - a + n) for (a, b), n in zip(SESSIONS, _BEFORE)])


def _time(day: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute.cast("int"))


def window_days(wanted: int, codes: Column, most: int = MINUTE_ROWS) -> Column:
    """Days of minutes to hold for so many codes: as many as wanted (two at least) while the rows stay below ``most``, and one at least."""
    wanted, most = max(2, wanted), most if most > 0 else MINUTE_ROWS
    fit = F.floor(F.lit(most) / (codes * sum(b - a + 1 for a, b in SESSIONS)))
    return F.when(codes > 0, F.greatest(F.lit(1), F.least(F.lit(wanted), fit))).otherwise(F.lit(wanted)).cast("int")


def minute_filled(minutes: DataFrame, days: DataFrame, daily: DataFrame, code: str = "ts_code", at: str = "trade_time", day: str = "trade_date") -> DataFrame:
    """(code, at, open, high, low, close, vol, amount, suspended) for the days' slots, without gaps.

    Missing minutes have the last close before them, no volume and NaN for the amount, from a code's first minute in the
    window on. A code with no minute in it is filled from its last daily close before the window, if there is one.

    Slots are numbered. Only the minutes that there are move, each with the number of its code's next one; the slots between
    the two are made where the minute is, last of all, so that the dense series is never shuffled.
    """
    prices = ["open", "high", "low", "close"]
    known = days.select(day).where(F.col(day).isNotNull()).distinct()
    begin, end = known.agg(F.min(day)), known.agg(F.max(day))
    seeds = daily.where(F.col(day) < begin.scalar()).groupBy(code).agg(F.max_by("close", day).alias("__seed")).where("__seed > 0")
    # one row a day goes to all tasks
    numbered = known.select(F.col(day).alias("__day"), (F.row_number().over(Window.orderBy(day)) - 1).alias("__d"))
    size = numbered.agg((F.count("*") * DAY_SLOTS).cast("int").alias("__n"))
    inside = minutes.where(F.to_date(at).between(begin.scalar(), end.scalar())).join(F.broadcast(numbered), F.to_date(at) == F.col("__day"))
    minute = F.hour(at) * 60 + F.minute(at)
    own = inside.where(F.col(at) == _time(F.col("__day"), minute)).withColumn("__k", F.col("__d") * DAY_SLOTS + _slot(minute)).where("__k IS NOT NULL")
    start = seeds.select(code, F.lit(-1).alias("__k"), "__seed")
    both = own.select(code, "__k", *prices, "vol", "amount").unionByName(start, allowMissingColumns=True).where(F.col(code).isNotNull())
    length = F.greatest(F.lit(BLOCK_SLOTS), F.ceil(F.col("__n") / carry.BLOCKS))
    span = size.select(F.lit(-1.0), (length * carry.BLOCKS - 2).cast("double"))
    has = F.col("close").isNotNull()
    found = {"__first": carry.first(F.when(has, F.col("__k"))), "__last": carry.last("close"), "__seed": carry.last("__seed"), "__next": carry.lead("__k")}
    out = carry.running(both, [code], ["__k"], found, span=span).where((F.col("__k") >= F.col("__first")) | (F.col("__first").isNull() & (F.col("__seed") > 0)))
    out = out.join(F.broadcast(size)).withColumn("__next", F.coalesce("__next", "__n"))
    # of minutes in one slot, the last is followed by the slots up to the next; a code's daily close has none itself
    until = F.greatest(F.col("__k"), F.col("__next") - 1)
    # few rows make many: as many tasks as a shuffle has, whatever the bytes
    spread = out.where("__k >= 0 OR __next > 0").repartition(int(minutes.sparkSession.conf.get("spark.sql.shuffle.partitions")), code, "__k")
    each = spread.withColumn("__s", F.explode(F.sequence(F.greatest(F.col("__k"), F.lit(0)), until)))
    mine, fill = F.col("__s") == F.col("__k"), F.coalesce("__last", "__seed")
    kept = lambda c: F.when(mine, F.col(c))
    place = F.col("__s") % DAY_SLOTS
    late = F.lit(0)
    for (_, b), (a, _), n in zip(SESSIONS, SESSIONS[1:], _BEFORE[1:]):
        late = late + F.when(place >= n, a - b - 1).otherwise(0)
    each = each.join(F.broadcast(numbered), F.floor(F.col("__s") / DAY_SLOTS) == F.col("__d")).withColumn("__suspended", ~mine | ~has)
    return each.select(
        code, _time(F.col("__day"), F.lit(SESSIONS[0][0]) + place + late).alias(at), *[F.coalesce(kept(c), fill).alias(c) for c in prices], F.coalesce(kept("vol"), F.lit(0.0)).alias("vol"),
        F.when(~F.col("__suspended"), F.col("amount")).otherwise(F.lit(float("nan"))).alias("amount"), F.col("__suspended").alias("suspended"),
    )


def resampled(minutes: DataFrame, width: str, code: str = "ts_code", at: str = "trade_time") -> DataFrame:
    """Bars of a wider frequency (such as "5 minutes"), named by their ends; a width must divide an hour or be whole hours."""
    end = F.window(F.col(at) - F.expr("INTERVAL 1 MICROSECOND"), width)["end"]
    return minutes.groupBy(code, end.alias("__end")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("vol").alias("vol"), F.sum("amount").alias("amount")
    ).withColumnRenamed("__end", at)


#: Spellings of frequencies.
FREQUENCIES = {"1d": "1d", "d": "1d", "day": "1d", "daily": "1d", "1m": "1m", "m": "1m", "1min": "1m", "min": "1m", "minute": "1m"}


def frequency(text: str) -> str:
    """1d or 1m for any of their spellings; others are an error."""
    found = FREQUENCIES.get(str(text).strip().lower())
    if found is None:
        raise ValueError(f"no such frequency: {text}")
    return found


def fold_auction(minutes: DataFrame, code: str = "ts_code", at: str = "trade_time") -> DataFrame:
    """The opening auction's 09:30 bar merged into 09:31; dropped where no 09:31 follows."""
    opening = (F.hour(at) == 9) & (F.minute(at) == 30)
    slot = F.when(opening, F.col(at) + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col(at))
    grouped = minutes.withColumn("slot", slot).withColumn("own", ~opening).groupBy(code, F.col("slot").alias("slot"))
    out = grouped.agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum("vol").alias("vol"),
        F.sum("amount").alias("amount"),
        F.bool_or("own").alias("own"),
    )
    return out.where("own").drop("own").withColumnRenamed("slot", at)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, fallback_first: bool = True, default: float | None = None) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` (key, at, value) at or before each row.

    Where there is none: the key's earliest value if ``fallback_first``, then ``default``. Both sides are stacked and the last value
    is carried on, in blocks of time (carry.py): one shuffle, no range join, and a hot key takes as many tasks as it has blocks.
    """
    names = left.columns
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__own", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("__v"), F.lit(0).alias("__own")), allowMissingColumns=True
    )
    found = {"__last": carry.last("__v")} | ({"__first": carry.first("__v")} if fallback_first else {})
    out = carry.running(both, [key], [at, "__own"], found).where("__own = 1")
    return out.select(*names, F.coalesce(*found, *([F.lit(default)] if default is not None else [])).alias(value))


def adjusted(bars: DataFrame, factors: DataFrame, fields: list[str], mode: str, cutoff: Column | None = None, code: str = "ts_code", day: str = "trade_date") -> DataFrame:
    """Bars with ``fields`` times the factor at the day (post), and divided by the factor at the cutoff (pre).

    mode: none, post (hfq) or pre (qfq). The factor at the cutoff is the latest one up to it, else the code's earliest.
    """
    if mode in ("none", ""):
        return bars
    own = as_of(bars, factors, code, day, "adj_factor", default=1.0)
    scale = F.col("adj_factor")
    if mode in ("pre", "qfq"):
        upto = F.lit(True) if cutoff is None else F.col(day) <= cutoff
        at = factors.groupBy(code).agg(F.coalesce(F.max_by(F.when(upto, F.col("adj_factor")), F.when(upto, F.col(day))), F.min_by("adj_factor", day)).alias("__at"))
        own = own.join(at, code, "left")
        scale = scale / F.coalesce("__at", F.lit(1.0))
    elif mode not in ("post", "hfq", "q"):
        raise ValueError(f"no such adjustment: {mode}")
    return own.select(*[(F.col(c) * scale).alias(c) if c in fields else F.col(c) for c in bars.columns])


def last_bars(bars: DataFrame, upto: Column, n: int, code: str = "ts_code", at: str = "trade_date") -> DataFrame:
    """Each code's newest n bars up to a time, ascending."""
    newest = Window.partitionBy(code).orderBy(F.desc(at))
    return bars.where(F.col(at) <= upto).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n").orderBy(code, at)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order. Tasks keep one row a key before anything moves."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*key).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def numbered(rows: DataFrame, day: str, order: list, start: int) -> DataFrame:
    """Rows with a sequence number that starts anew each day, after ``start``."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(day).orderBy(*order)) + F.lit(start))


def listed_on(basics: DataFrame, day: Column) -> DataFrame:
    """Securities listed on a day: listed by then (or without a date) and not delisted by then, in code order."""
    ok = (F.col("list_date").isNull() | (F.col("list_date") <= day)) & (F.col("delist_date").isNull() | (F.col("delist_date") > day))
    return basics.where(ok).orderBy("ts_code")


def volume_reconciliation(minutes: DataFrame, daily: DataFrame, tolerance: float = 0.05, scale: float = 100.0) -> DataFrame:
    """Per code and day the minutes' volume against the day's (in lots of ``scale``), and whether they agree."""
    m = minutes.groupBy("ts_code", F.to_date("trade_time").alias("trade_date")).agg(F.sum("vol").alias("minute_vol"))
    out = m.join(daily.select("ts_code", "trade_date", (F.col("vol") * scale).alias("daily_vol")), ["ts_code", "trade_date"])
    return out.withColumn("agrees", F.abs(F.col("minute_vol") - F.col("daily_vol")) <= F.col("daily_vol") * tolerance)


def moving_averages(bars: DataFrame, spans: dict[str, int], value: str = "close", code: str = "ts_code", at: str = "trade_date", digits: int | None = None) -> DataFrame:
    """Bars with the mean of the last so many values under each name, from a code's first bar on that all of them have enough values for.

    A span needs only the rows before it, so null values count as rows but not in the mean.
    """
    own = Window.partitionBy(code).orderBy(at)
    mean = lambda n: F.avg(value).over(own.rowsBetween(-(n - 1), 0))
    made = {name: mean(n) if digits is None else F.round(mean(n), digits) for name, n in spans.items()}
    return bars.withColumns(made | {"__n": F.row_number().over(own)}).where(F.col("__n") >= max(spans.values())).drop("__n")


#: Bytes of names that go to all tasks at most.
NAMES_SENT = 8 << 20


def looked_up(rows: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the columns of ``names`` (one row a key); null where a key has none. Small tables of names, by Spark's estimate, go to all tasks."""
    size = int(str(names._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.join(F.broadcast(names) if size <= NAMES_SENT else names, key, "left")
