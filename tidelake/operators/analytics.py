"""Performance analytics over a series of net asset values, for many runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators import carry, stats

YEAR = 252


def drawdowns(nav: DataFrame, run: str = "run_id", at: str = "trade_date", value: str = "value") -> DataFrame:
    """Rows with the simple return, the running peak, its first date and the drawdown; a run's history is scanned in blocks of time (carry.py)."""
    # of equal values the first date is the larger one
    high = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-carry.number(nav, at)).alias("n"), F.col(at).alias("at")))
    rows = carry.running(nav, [run], [at], {"__prev": carry.lag(value), "__high": carry.most(high)}).withColumns({"peak": F.col("__high.v"), "peak_date": F.col("__high.at")})
    out = rows.withColumn("ret", F.when(F.col("__prev") > 0, F.col(value) / F.col("__prev") - 1)).withColumn("drawdown", F.try_divide(F.col(value), F.col("peak")) - 1)
    return out.select(*nav.columns, "ret", "peak", "peak_date", "drawdown")


def metrics(nav: DataFrame, run: str = "run_id", at: str = "trade_date", value: str = "value", year: float = YEAR) -> DataFrame:
    """One row a run: returns, volatility, ratios, the deepest drawdown and its dates. Runs of one value give none; a run that
    starts at zero has null returns."""
    rows = drawdowns(nav, run, at, value)
    root = F.sqrt(F.lit(float(year)))
    m, s = F.avg("ret"), stats.population_std(F.col("ret"))
    down = F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret"))))
    out = rows.groupBy(run).agg(
        F.count("*").alias("n"),
        F.try_divide(F.max_by(value, at), F.min_by(value, at)).alias("growth"),
        m.alias("mean"),
        s.alias("sd"),
        down.alias("down"),
        stats.positive_share(F.col("ret")).alias("daily_win_rate"),
        F.min(F.struct("drawdown", F.col(at).alias("end"), F.col("peak_date").alias("start"))).alias("dd"),
    )
    annual = F.pow("growth", F.lit(float(year)) / (F.col("n") - 1)) - 1
    none = F.lit(0.0)
    return out.where("n >= 2").select(
        run,
        (F.col("growth") - 1).alias("total_return"),
        annual.alias("annualized_return"),
        (F.col("sd") * root).alias("volatility"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * root).otherwise(none).alias("sharpe"),
        F.when(F.col("down") > 0, F.col("mean") / F.col("down") * root).otherwise(none).alias("sortino"),
        F.col("dd.drawdown").alias("max_drawdown"),
        F.col("dd.start").alias("drawdown_start"),
        F.col("dd.end").alias("drawdown_end"),
        F.when(F.col("dd.drawdown") < 0, annual / F.abs("dd.drawdown")).otherwise(none).alias("calmar"),
        F.coalesce("daily_win_rate", none).alias("daily_win_rate"),
    )


def against_benchmark(nav: DataFrame, run: str = "run_id", at: str = "trade_date", value: str = "value", benchmark: str = "benchmark", year: float = YEAR) -> DataFrame:
    """One row a run: excess return, information ratio, beta and alpha against the benchmark column."""
    rows = carry.running(nav, [run], [at], {"__r": carry.lag(value), "__b": carry.lag(benchmark)})
    r = lambda c, before: F.when(F.col(before) > 0, F.col(c) / F.col(before) - 1)
    rows = rows.withColumns({"r": r(value, "__r"), "b": r(benchmark, "__b")}).withColumn("a", F.col("r") - F.col("b"))
    out = rows.groupBy(run).agg(
        (F.try_divide(F.max_by(value, at), F.min_by(value, at)) - F.try_divide(F.max_by(benchmark, at), F.min_by(benchmark, at))).alias("excess_return"),
        F.avg("a").alias("ma"),
        stats.population_std(F.col("a")).alias("sa"),
        stats.population_covariance("r", "b").alias("cov"),
        F.coalesce(F.var_pop("b"), F.lit(0.0)).alias("var"),
        F.avg("r").alias("mr"),
        F.avg("b").alias("mb"),
    )
    beta = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)
    return out.select(
        run,
        "excess_return",
        F.when(F.col("sa") > 0, F.col("ma") / F.col("sa") * F.sqrt(F.lit(float(year)))).otherwise(0.0).alias("information_ratio"),
        beta.alias("beta"),
        ((F.col("mr") - beta * F.col("mb")) * year).alias("alpha"),
    )


def lot_pairs(trades):
    """One run's first-in-first-out matches, on the driver: (amount, buy price, sell price) of (side, amount, price) tuples; surplus sales match nothing."""
    held: list[list[float]] = []
    for side, amount, price in trades:
        if side == "buy":
            held.append([amount, price])
            continue
        while amount > 0 and held:
            n = min(amount, held[0][0])
            yield n, held[0][1], price
            amount -= n
            held[0][0] -= n
            if held[0][0] <= 0:
                held.pop(0)


#: Amounts are added up exactly.
_AMOUNT = "decimal(28,6)"


#: Keys are counted in so many buckets. Keys of a bucket that has more rows than the second, and than the third times its share, are cut into blocks of time.
_BUCKETS, _BUCKET_ROWS, _SHARES = 4096, 1 << 20, 16


def lots(trades: DataFrame, key: list[str], order: tuple[str, ...] = ("trade_time", "trade_id"), most: int = _BUCKET_ROWS) -> DataFrame:
    """(key, buy_price, sell_price, amount): what each sale took of each purchase, first in first out; surplus sales match nothing.

    Units are numbered as they are bought and as they are sold. Sales beyond what was bought by then count for nothing: their sum
    so far is the highest that sales less purchases have been, above zero. The numbers at which purchases and sales end cut the
    units into pieces; a piece belongs to the purchase and the sale that end next. These are running sums, a running maximum
    and a look ahead, and no ranges are joined. Rows are counted by buckets of keys first, which is a job of its own. Keys of large
    buckets (fewer than 256, by their share) are cut into blocks of time (carry.py), so no task holds a hot key's whole history;
    that moves rows several times. All others move once, by key. ``most`` is the least number of rows that makes a bucket large.
    Trades with null or no positive amounts match nothing. Times as text are all ISO dates or times, or none is.
    """
    own = trades.where("amount > 0")
    bucket = F.pmod(F.xxhash64(*key), F.lit(_BUCKETS))
    counted = own.groupBy(bucket.alias("b")).count()
    limit = F.greatest(F.lit(most), F.sum("count").over(Window.partitionBy()) * _SHARES / _BUCKETS)
    large = [r.b for r in counted.withColumn("limit", limit).where("count > limit").collect()]
    if not large:
        return _lots_by_key(own, key, order)
    return _lots_by_key(own.where(~bucket.isin(large)), key, order).unionByName(_lots_by_blocks(own.where(bucket.isin(large)), key, order))


def _lots_by_key(trades: DataFrame, key: list[str], order: tuple[str, ...]) -> DataFrame:
    """One shuffle and two sorts: forward for the running sums, backward for what ends next. Narrow rows move, without what follows from them."""
    buy, n, zero = F.col("__buy"), F.col("__n"), F.lit(0).cast(_AMOUNT)
    moved = trades.select(*dict.fromkeys([*key, *order, "price", "amount"]), (F.col("side") == "buy").alias("__buy")).repartition(*key).withColumn("__n", F.col("amount").cast(_AMOUNT))
    so_far = Window.partitionBy(*key).orderBy(*order, F.desc("__buy")).rowsBetween(Window.unboundedPreceding, 0)
    flow = moved.withColumns({"__bought": F.sum(F.when(buy, n).otherwise(zero)).over(so_far), "__sold": F.sum(F.when(buy, zero).otherwise(n)).over(so_far)})
    flow = flow.withColumn("__surplus", F.max(F.col("__sold") - F.col("__bought")).over(so_far))
    ends = flow.withColumn("__at", F.when(buy, F.col("__bought")).otherwise(F.col("__sold") - F.greatest("__surplus", zero)).cast(_AMOUNT))
    # rows that end at one place come in the order of time: the first of them has the piece, sales that took nothing follow the one that did
    back = Window.partitionBy(*key).orderBy(F.desc("__at"), *[F.desc(c) for c in order], "__buy")
    following = lambda c: F.last(F.when(c, F.col("price")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    size = F.col("__at") - F.coalesce(F.lead("__at").over(back), zero)
    pieces = ends.select(*key, following(buy).alias("buy_price"), following(~buy).alias("sell_price"), size.cast("double").alias("amount"))
    return pieces.where("amount > 0 AND buy_price IS NOT NULL AND sell_price IS NOT NULL")


def _lots_by_blocks(trades: DataFrame, key: list[str], order: tuple[str, ...]) -> DataFrame:
    """All in blocks of time: of the trades first, then of the units."""
    when = [f"__o{i}" for i in range(len(order))]
    own = trades.select(*key, *order, F.col("side") == "buy", "price", F.col("amount").cast(_AMOUNT)).toDF(*key, *when, "buy", "price", "amount")
    net = F.when(F.col("buy"), -F.col("amount")).otherwise(F.col("amount"))
    zero = F.lit(0).cast(_AMOUNT)
    flow = carry.running(own, key, when, {"bought": carry.total(F.when(F.col("buy"), F.col("amount")).otherwise(zero)), "sold": carry.total(F.when(F.col("buy"), zero).otherwise(F.col("amount"))), "surplus": carry.peak(net)})
    at = F.when(F.col("buy"), F.col("bought")).otherwise(F.col("sold") - F.greatest("surplus", zero))
    ends = flow.select(*key, *when, at.cast(_AMOUNT).alias("at"), F.when(F.col("buy"), F.col("price")).alias("buy_price"), F.when(~F.col("buy"), F.col("price")).alias("sell_price"))
    # rows that end at one place come in the order of time: the first of them has the piece, sales that took nothing follow the one that did
    units = own.groupBy(*key).agg(F.sum(F.when(F.col("buy"), F.col("amount"))).alias("n")).agg(F.lit(0.0), F.coalesce(F.max("n"), F.lit(0)).cast("double"))
    pieces = carry.running(ends, key, ["at", *when], {"__from": carry.lag("at"), "buy_price": carry.following("buy_price"), "sell_price": carry.following("sell_price")}, span=units)
    size = F.col("at") - F.coalesce("__from", zero)
    return pieces.withColumn("amount", size.cast("double")).where("amount > 0 AND buy_price IS NOT NULL AND sell_price IS NOT NULL").select(*key, "buy_price", "sell_price", "amount")


def fifo(trades: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("trade_time", "trade_id")) -> DataFrame:
    """One row a run: matched lots that won and lost, their share and the mean win over the mean loss (no fees)."""
    gain = F.col("amount") * (F.col("sell_price") - F.col("buy_price"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    found = lots(trades, [run, "security"], order).withColumn("gain", gain).groupBy(run).agg(
        count(F.col("gain") > 0).alias("wins"), count(F.col("gain") < 0).alias("losses"), F.sum(F.when(F.col("gain") > 0, F.col("gain")).otherwise(0.0)).alias("won"), F.sum(F.when(F.col("gain") < 0, -F.col("gain")).otherwise(0.0)).alias("lost")
    )
    # a run whose trades match nothing has a row, too
    total = trades.select(run).distinct().join(found, run, "left").fillna(0, ["wins", "losses"]).fillna(0.0, ["won", "lost"])
    rate = F.coalesce(F.try_divide("wins", F.col("wins") + F.col("losses")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(F.try_divide("won", "wins"), F.try_divide("lost", "losses")), F.lit(0.0))
    return total.select(run, "wins", "losses", rate.alias("win_rate"), ratio.alias("profit_loss_ratio"))
