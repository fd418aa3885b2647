"""Queries of the engine's own operators and their SQL, keyed alike.

The driver's tables stand in for market data. E is a daily panel of the events (users as securities), S a monthly panel
of the line items (suppliers as securities).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.functions import dates, market
from tidelake.operators import analytics, compare, factors, pages, stats, timeseries
from tidelake.plans.tables import kept, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

E_SQL = """e AS (SELECT user_id AS ts_code, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS vol, round(sum(value), 6) AS amount FROM events GROUP BY 1, 2)"""
S_SQL = """s AS (SELECT l_suppkey AS ts_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, round(sum(l_quantity), 6) AS vol, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1, 2)"""
C_SQL = E_SQL + """, c AS (SELECT *, coalesce((close / nullif(lag(close) OVER w, 0) - 1) * 100, 0) AS pct_chg, vol / 10 AS turnover_rate, amount * 3 AS total_mv
    FROM e WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))"""


def register(name: str, sql: str | None = None):
    """Adds a query under ``name``, with its SQL if SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def e_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ts_code"), F.to_date("ts").alias("trade_date")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("vol"),
        F.round(F.sum("value"), 6).alias("amount"),
    )


def s_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ts_code"), F.trunc("l_shipdate", "month").alias("trade_date")).agg(
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.round(F.sum("l_quantity"), 6).alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount")
    )


def cross_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E with the inputs of all factor kinds."""
    own = Window.partitionBy("ts_code").orderBy("trade_date")
    return e_panel(spark, sf_dir).withColumns({
        "pct_chg": F.coalesce((F.try_divide("close", F.lag("close").over(own)) - 1) * 100, F.lit(0.0)),
        "turnover_rate": F.col("vol") / 10,
        "total_mv": F.col("amount") * 3,
    })


# scans, projections, filters, pages


@register("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount <= 0.05 AND l_tax > 0.02 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1996-01-01'")
def scan_project_filter(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").where((c("l_quantity") >= 10) & (c("l_quantity") < 40) & (c("l_discount") <= 0.05) & (c("l_tax") > 0.02) & (c("l_returnflag") == "R"))
    return rows.where(c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_quantity")


@register("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 5, 9, 13, 101)")
def filter_in_list(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_custkey").isin(1, 5, 9, 13, 101)).select("o_orderkey", "o_orderpriority")


@register("filter_semi_join", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 5000)")
def filter_semi_join(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(rich, "l_suppkey", "left_semi").select("l_orderkey", "l_suppkey")


@register("filter_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def filter_anti_join(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@register("named_query_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def named_query_page(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").offset(50).limit(100)


@register("unit_transform", f"WITH {E_SQL} SELECT ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, vol * 100 AS vol, round(amount * 1000, 4) AS amount FROM e")
def unit_transform(spark, d):
    return e_panel(spark, d).select("ts_code", dates.format_date(F.col("trade_date")).alias("trade_date"), (F.col("vol") * 100).alias("vol"), F.round(F.col("amount") * 1000, 4).alias("amount"))


@register(
    "rename_cast_scale",
    "SELECT concat(lpad(c_custkey::VARCHAR, 6, '0'), CASE WHEN c_nationkey % 2 = 0 THEN '.SS' ELSE '.SZ' END) AS strategy_code, upper(c_mktsegment) AS segment, round(c_acctbal * 0.001, 6) AS k_balance FROM customer",
)
def rename_cast_scale(spark, d):
    code = F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_nationkey") % 2 == 0, ".sh ").otherwise(".sz "))
    return table(spark, d, "customer").select(market.strategy_code(code).alias("strategy_code"), F.upper("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 0.001, 6).alias("k_balance"))


@register(
    "code_spellings",
    "SELECT s_suppkey, concat(lpad(s_suppkey::VARCHAR, 6, '0'), ['.SH', '.SZ', '.BJ'][(s_suppkey % 3 + 1)::INT]) AS lake, concat(lpad(s_suppkey::VARCHAR, 6, '0'), ['.XSHG', '.XSHE', '.BJ'][(s_suppkey % 3 + 1)::INT]) AS symbol FROM supplier",
)
def code_spellings(spark, d):
    code = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.element_at(F.array(*map(F.lit, (".ss", ".SZ ", ".jy"))), (F.col("s_suppkey") % 3 + 1).cast("int")))
    return table(spark, d, "supplier").select("s_suppkey", market.lake_code(code).alias("lake"), market.order_symbol(code).alias("symbol"))


@register(
    "date_parsing",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN CAST(o_orderdate AS DATE) END AS parsed, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS number FROM orders",
)
def date_parsing(spark, d):
    o = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(o, "yyyyMMdd")).when(k == 1, F.date_format(o, "yyyy-MM-dd")).when(k == 2, F.concat(F.date_format(o, "yyyyMMdd"), F.lit(".0"))).when(k == 3, "0").otherwise("no date")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(o).alias("d"), dates.parse_date_value(text).alias("parsed"), dates.date_number(o).alias("number"))


@register(
    "timestamp_parsing",
    "SELECT event_id, date_trunc('second', ts) AS parsed FROM events",
)
def timestamp_parsing(spark, d):
    t, k = F.col("ts"), F.col("event_id") % 3
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(t, "yyyyMMddHHmmss")).otherwise(F.unix_timestamp(t.cast("timestamp_ltz")).cast("string"))
    return table(spark, d, "events").select("event_id", dates.parse_timestamp_value(text).alias("parsed"))


@register(
    "point_in_time_listing",
    """WITH b AS (SELECT o_custkey AS ts_code, CAST(min(o_orderdate) AS DATE) AS list_date, CASE WHEN count(*) > 5 THEN CAST(max(o_orderdate) AS DATE) END AS delist_date FROM orders GROUP BY 1)
    SELECT * FROM b WHERE (list_date IS NULL OR list_date <= DATE '1998-06-30') AND (delist_date IS NULL OR delist_date > DATE '1998-06-30')""",
)
def point_in_time_listing(spark, d):
    day = F.to_date("o_orderdate")
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ts_code")).agg(F.min(day).alias("list_date"), F.when(F.count("*") > 5, F.max(day)).alias("delist_date"))
    return timeseries.listed_on(b, F.lit(date(1998, 6, 30)))


# calendars and bars


@register("trading_calendar", "SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events ORDER BY 1")
def trading_calendar(spark, d):
    return timeseries.calendar(table(spark, d, "events").select(F.to_date("ts").alias("trade_date")))


@register("calendar_tail", "SELECT * FROM (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events WHERE ts < TIMESTAMP '2024-01-21' ORDER BY 1 DESC LIMIT 5) ORDER BY 1")
def calendar_tail(spark, d):
    return timeseries.calendar_tail(trading_calendar(spark, d), F.lit(date(2024, 1, 20)), 5)


@register("ohlc_daily", f"WITH {E_SQL} SELECT * FROM e")
def ohlc_daily(spark, d):
    return e_panel(spark, d)


@register(
    "minute_clock",
    "SELECT CAST(day AS DATE) AS trade_date, CAST(day + to_minutes(CAST(slot AS INTEGER)) AS TIMESTAMP) AS trade_time FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events), (SELECT unnest(range(571, 691)) AS slot UNION ALL SELECT unnest(range(781, 901)))",
)
def minute_clock(spark, d):
    return timeseries.minute_clock(trading_calendar(spark, d))


_MIN_SQL = """m AS (SELECT user_id AS ts_code, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 570 MINUTE + INTERVAL (event_id % 4) MINUTE AS trade_time,
    round(sum(value), 6) AS open, max(value) AS high, min(value) AS low, round(avg(value), 6) AS close, count(*)::DOUBLE AS vol, round(sum(value), 6) AS amount FROM events GROUP BY 1, 2)"""


def _minutes(spark, d):
    t = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.lit(570) + F.col("event_id") % 4).cast("int"))
    total = F.round(F.sum("value"), 6)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ts_code"), t.alias("trade_time")).agg(
        total.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.round(F.avg("value"), 6).alias("close"), F.count("*").cast("double").alias("vol"), total.alias("amount")
    )


@register(
    "auction_fold",
    f"""WITH {_MIN_SQL}, f AS (SELECT *, CASE WHEN hour(trade_time) = 9 AND minute(trade_time) = 30 THEN trade_time + INTERVAL 1 MINUTE ELSE trade_time END AS slot FROM m)
    SELECT ts_code, slot AS trade_time, arg_min(open, trade_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_time) AS close, sum(vol) AS vol, round(sum(amount), 4) AS amount
    FROM f GROUP BY ts_code, slot HAVING bool_or(slot = trade_time)""",
)
def auction_fold(spark, d):
    return timeseries.fold_auction(_minutes(spark, d)).withColumn("amount", F.round("amount", 4))


@register(
    "suspension_fill",
    f"""WITH {E_SQL}, g AS (SELECT * FROM (SELECT DISTINCT ts_code FROM e), (SELECT DISTINCT trade_date FROM e))
    SELECT ts_code, trade_date, last_value(close IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date) AS close, coalesce(vol, 0) AS vol, coalesce(amount, 0) AS amount, vol IS NULL AS suspended
    FROM g LEFT JOIN e USING (ts_code, trade_date)""",
)
def suspension_fill(spark, d):
    e = e_panel(spark, d).select("ts_code", "trade_date", "close", "vol", "amount")
    slots = timeseries.grid(e.select("trade_date").distinct(), e.select("ts_code").distinct())
    return timeseries.forward_filled(e, slots, "ts_code", "trade_date", "close", ["vol", "amount"])


_ADJ_SQL = "a AS (SELECT ts_code, trade_date, 1 + (day(trade_date) % 7) / 10 AS adj_factor FROM e WHERE day(trade_date) % 5 = 2)"


def _adj(e: DataFrame) -> DataFrame:
    return e.where(F.dayofmonth("trade_date") % 5 == 2).select("ts_code", "trade_date", (F.lit(1) + (F.dayofmonth("trade_date") % 7) / 10).alias("adj_factor"))


@register(
    "asof_factor",
    f"""WITH {E_SQL}, {_ADJ_SQL}, firsts AS (SELECT ts_code, arg_min(adj_factor, trade_date) AS f FROM a GROUP BY 1)
    SELECT e.ts_code, e.trade_date, close, coalesce(a.adj_factor, f, 1.0) AS adj_factor FROM e ASOF LEFT JOIN a ON e.ts_code = a.ts_code AND e.trade_date >= a.trade_date LEFT JOIN firsts ON firsts.ts_code = e.ts_code""",
)
def asof_factor(spark, d):
    e = e_panel(spark, d)
    return timeseries.as_of(e.select("ts_code", "trade_date", "close"), _adj(e), "ts_code", "trade_date", "adj_factor", default=1.0)


@register(
    "asof_adjust",
    f"""WITH {E_SQL}, {_ADJ_SQL}, firsts AS (SELECT ts_code, arg_min(adj_factor, trade_date) AS f, arg_max(adj_factor, trade_date) FILTER (trade_date <= DATE '2024-01-20') AS l FROM a GROUP BY 1)
    SELECT e.ts_code, e.trade_date, round(close * coalesce(a.adj_factor, f, 1.0) / coalesce(l, f, 1.0), 6) AS close, round(vol * coalesce(a.adj_factor, f, 1.0) / coalesce(l, f, 1.0), 6) AS vol
    FROM e ASOF LEFT JOIN a ON e.ts_code = a.ts_code AND e.trade_date >= a.trade_date LEFT JOIN firsts ON firsts.ts_code = e.ts_code""",
)
def asof_adjust(spark, d):
    e = e_panel(spark, d)
    out = timeseries.adjusted(e.select("ts_code", "trade_date", "close", "vol"), _adj(e), ["close", "vol"], "pre", F.lit(date(2024, 1, 20)))
    return out.withColumns({c: F.round(c, 6) for c in ("close", "vol")})


@register("last_bars", f"WITH {E_SQL} SELECT ts_code, trade_date, close FROM e WHERE trade_date <= DATE '2024-01-25' QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 3")
def last_bars(spark, d):
    return timeseries.last_bars(e_panel(spark, d).select("ts_code", "trade_date", "close"), F.lit(date(2024, 1, 25)), 3)


@register(
    "volume_reconciliation",
    f"""WITH {_MIN_SQL}, {E_SQL} SELECT t.ts_code, t.trade_date, minute_vol, vol * 1.02 AS daily_vol, abs(minute_vol - vol * 1.02) <= vol * 1.02 * 0.05 AS agrees
    FROM (SELECT ts_code, CAST(trade_time AS DATE) AS trade_date, sum(vol) AS minute_vol FROM m GROUP BY 1, 2) t JOIN e USING (ts_code, trade_date)""",
)
def volume_reconciliation(spark, d):
    return timeseries.volume_reconciliation(_minutes(spark, d), e_panel(spark, d), scale=1.02)


# lake maintenance


@register(
    "dedupe_keep_first",
    "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1",
)
def dedupe_keep_first(spark, d):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return timeseries.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)


@register("partition_row_counts", "SELECT year(l_shipdate)::INTEGER AS year, count(*) AS rows FROM lineitem GROUP BY 1")
def partition_row_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("rows"))


@register(
    "ledger_reconcile",
    """WITH a AS (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS source_rows FROM orders GROUP BY 1), b AS (SELECT year(l_shipdate)::INTEGER AS year, count(*) AS target_rows FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT year, source_rows, target_rows, CASE WHEN target_rows IS NULL THEN 'missing' WHEN source_rows IS NULL THEN 'extra' WHEN source_rows = target_rows THEN 'ok' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (year)""",
)
def ledger_reconcile(spark, d):
    from tidelake.sources.lake import reconciled_partitions

    b = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select(F.year("l_shipdate").alias("year"))
    return reconciled_partitions(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), b, ["year"])


@register("materialize_cross", f"WITH {C_SQL} SELECT ts_code, trade_date, close, round(pct_chg, 6) AS pct_chg, vol, amount FROM c")
def materialize_cross(spark, d):
    out = cross_panel(spark, d).select("ts_code", "trade_date", "close", F.round("pct_chg", 6).alias("pct_chg"), "vol", "amount")
    return out.repartitionByRange("trade_date").sortWithinPartitions("trade_date", "ts_code")


@register(
    "union_by_key",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') OR o_custkey % 2 = 0",
)
def union_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    slices = [orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), orders.where("o_custkey % 2 = 0")]
    both = slices[0].withColumn("slice", F.lit(0)).unionByName(slices[1].withColumn("slice", F.lit(1))).unionByName(slices[2].withColumn("slice", F.lit(2)))
    return timeseries.keep_first(both, ["o_orderkey"], ["slice"]).select("o_orderkey", "o_orderstatus")


@register("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def set_difference(spark, d):
    """Customers without a large order that is filled."""
    large = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000")
    return table(spark, d, "customer").select("c_custkey").subtract(large.select("o_custkey"))


@register("deep_page", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 500 OFFSET (SELECT count(*) * 5 // 6 FROM lineitem)")
def deep_page(spark, d):
    """A page behind five sixths of the line items: ranges before it are counted, not sorted."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return pages.page(rows, rows.columns, rows.count() * 5 // 6, 500, few=5_000)


@register(
    "table_differences",
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders), b AS (SELECT k, CASE WHEN k % 97 = 3 THEN 'X' ELSE status END AS status, CASE WHEN k % 89 = 5 THEN NULL ELSE price END AS price, priority FROM a WHERE k % 101 <> 7
        UNION ALL SELECT -k, status, price, priority FROM a WHERE k % 103 = 9)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'differs' END AS status, f.field, CASE f.field WHEN 'status' THEN a.status WHEN 'price' THEN round(a.price, 2)::VARCHAR END AS a, CASE f.field WHEN 'status' THEN b.status WHEN 'price' THEN round(b.price, 2)::VARCHAR END AS b
    FROM a FULL JOIN b ON a.k = b.k JOIN (SELECT unnest(['status', 'price', NULL]) AS field) f ON (a.k IS NULL OR b.k IS NULL) = (f.field IS NULL) AND (f.field IS NULL OR (f.field = 'status' AND a.status <> b.status) OR (f.field = 'price' AND a.price IS DISTINCT FROM b.price))""",
)
def table_differences(spark, d):
    """Orders against a copy in which some differ, lack or come in addition, field by field."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    k = F.col("k")
    b = a.where(k % 101 != 7).withColumns({"status": F.when(k % 97 == 3, "X").otherwise(F.col("status")), "price": F.when(k % 89 == 5, None).otherwise(F.col("price"))})
    b = b.unionByName(a.where(k % 103 == 9).withColumn("k", -k))
    found = compare.differences(a.withColumnRenamed("status", "state"), b.withColumnRenamed("status", "state"), ["k"])
    return found.select("k", "status", F.when(F.col("field") == "state", "status").otherwise(F.col("field")).alias("field"), F.col("left").alias("a"), F.col("right").alias("b"))


@register("name_lookup", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def name_lookup(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return timeseries.looked_up(table(spark, d, "supplier"), names, ["s_nationkey"]).select("s_suppkey", "s_name", "n_name")


@register(
    "source_compare",
    "SELECT 'a' AS side, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders UNION ALL SELECT 'b', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem",
)
def source_compare(spark, d):
    one = lambda t, k, s: table(spark, d, t).agg(F.lit(s).alias("side"), F.count("*").alias("rows"), F.min(k).alias("first_key"), F.max(k).alias("last_key"))
    return one("orders", "o_orderkey", "a").unionByName(one("lineitem", "l_orderkey", "b"))


@register(
    "latency_percentiles",
    "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1",
)
def latency_percentiles(spark, d):
    return stats.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, most="most")


# factors


def _factor(kind: str, **params) -> factors.Factor:
    return factors.Factor(kind, kind, kind, params)


def _factor_query(name: str, factor: factors.Factor, panel, sql: str):
    @register(name, sql)
    def query(spark, d):
        own = panel(spark, d).select("ts_code", "trade_date", F.round(factors.value(factor), 6).alias("value"))
        return own.where("value is not null")


_factor_query("factor_momentum", _factor("momentum", window=3), s_panel, f"WITH {S_SQL} SELECT ts_code, trade_date, round(close / b - 1, 6) AS value FROM (SELECT *, lag(close, 3) OVER (PARTITION BY ts_code ORDER BY trade_date) AS b FROM s) WHERE b > 0")
_factor_query("factor_reversal", _factor("reversal", window=3), s_panel, f"WITH {S_SQL} SELECT ts_code, trade_date, round(-(close / b - 1), 6) AS value FROM (SELECT *, lag(close, 3) OVER (PARTITION BY ts_code ORDER BY trade_date) AS b FROM s) WHERE b > 0")
_W = "WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), o AS (PARTITION BY ts_code ORDER BY trade_date)"
_factor_query("factor_volatility", _factor("volatility", window=5), cross_panel, f"WITH {C_SQL} SELECT ts_code, trade_date, round(v, 6) AS value FROM (SELECT *, stddev_samp(pct_chg) OVER w AS v, row_number() OVER o AS n FROM c {_W}) WHERE n > 5")
_factor_query("factor_turnover", _factor("turnover", window=5), cross_panel, f"WITH {C_SQL} SELECT ts_code, trade_date, round(v, 6) AS value FROM (SELECT *, avg(turnover_rate) OVER w AS v, row_number() OVER o AS n FROM c {_W}) WHERE n > 5")
_factor_query("factor_size", _factor("size"), cross_panel, f"WITH {C_SQL} SELECT ts_code, trade_date, round(ln(total_mv), 6) AS value FROM c WHERE total_mv > 0")
_factor_query("factor_field", _factor("field", field="turnover_rate"), cross_panel, f"WITH {C_SQL} SELECT ts_code, trade_date, round(turnover_rate, 6) AS value FROM c")


@register("forward_return", f"WITH {S_SQL} SELECT ts_code, trade_date, round(lead(close, 2) OVER (PARTITION BY ts_code ORDER BY trade_date) / close - 1, 6) AS ret FROM s")
def forward_return(spark, d):
    return s_panel(spark, d).select("ts_code", "trade_date", F.round(factors.forward_return(2), 6).alias("ret"))


_START, _END, _H, _L = date(1996, 1, 1), date(2001, 1, 1), 2, 3
# the months that a window of 30 days each way needs are read for a lag of one row, so the load range covers them
_TRACK = _factor("momentum", window=200)
_PAIR_SQL = f"""{S_SQL}, p AS (SELECT ts_code, trade_date, CASE WHEN lag(close, 3) OVER o > 0 THEN close / lag(close, 3) OVER o - 1 END AS value,
    CASE WHEN close > 0 THEN lead(close, {_H}) OVER o / close - 1 END AS ret FROM s WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date)),
    d AS (SELECT * FROM p WHERE trade_date BETWEEN DATE '{_START}' AND DATE '{_END}'),
    q AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM d WHERE value IS NOT NULL AND ret IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, value) - 1) / 2 AS vr,
        rank() OVER (PARTITION BY trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2 AS rr,
        least((row_number() OVER (PARTITION BY trade_date ORDER BY value, ts_code) - 1) // (n // {_L}), {_L} - 1)::INTEGER AS layer FROM q WHERE n >= 2 * {_L})"""


def _pairs(spark, d):
    momentum = _factor("momentum", window=3)
    out = s_panel(spark, d).select("ts_code", "trade_date", factors.value(momentum).alias("value"), factors.forward_return(_H).alias("ret"))
    return out.where(F.col("trade_date").between(F.lit(_START), F.lit(_END)))


@register("factor_ic", f"WITH {_PAIR_SQL} SELECT trade_date, round(corr(value, ret), 6) AS ic, round(corr(vr, rr), 6) AS rank_ic, count(*) AS n FROM r GROUP BY 1")
def factor_ic(spark, d):
    return factors.daily_ic(factors.qualified(_pairs(spark, d), _L)).withColumns({c: F.round(c, 6) for c in ("ic", "rank_ic")})


@register("factor_layers", f"WITH {_PAIR_SQL} SELECT trade_date, layer, round(avg(ret), 6) AS ret, count(*) AS n FROM r GROUP BY 1, 2")
def factor_layers(spark, d):
    return factors.layer_returns(factors.qualified(_pairs(spark, d), _L)).withColumn("ret", F.round("ret", 6))


@register("factor_layer_cum", f"WITH {_PAIR_SQL}, l AS (SELECT trade_date, layer, avg(ret) AS ret FROM r GROUP BY 1, 2) SELECT trade_date, layer, round(product(1 + ret / {_H}) OVER (PARTITION BY layer ORDER BY trade_date) - 1, 2) AS cum FROM l")
def factor_layer_cum(spark, d):
    return factors.layer_cumulative(factors.layer_returns(factors.qualified(_pairs(spark, d), _L)), _H).select("trade_date", "layer", F.round("cum", 2).alias("cum"))


@register("average_ranks", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS r FROM customer")
def average_ranks(spark, d):
    return table(spark, d, "customer").select("c_custkey", stats.average_rank("c_nationkey", ["c_mktsegment"]).alias("r"))


@register(
    "factor_stats",
    f"""WITH {_PAIR_SQL}, i AS (SELECT trade_date, corr(value, ret) AS ic, corr(vr, rr) AS rank_ic FROM r GROUP BY 1)
    SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(rank_ic), 6) AS rank_ic_mean, round(stddev_samp(rank_ic), 6) AS rank_ic_std,
    round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS rank_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS ic_positive_ratio, count(*) AS days FROM i""",
)
def factor_stats(spark, d):
    out = factors.ic_summary(factors.daily_ic(factors.qualified(_pairs(spark, d), _L)))
    return out.select(*[F.round(c, 6).alias(c) if c != "days" else F.col(c) for c in out.columns])


@register("factor_coverage", f"WITH {_PAIR_SQL} SELECT trade_date, count(*) AS universe, count(value) AS valid, round(count(value) / count(*), 6) AS coverage FROM d GROUP BY 1")
def factor_coverage(spark, d):
    return factors.daily_coverage(_pairs(spark, d)).withColumn("coverage", F.round("coverage", 6))


@register(
    "factor_universe_spread",
    f"""WITH {_PAIR_SQL}, l AS (SELECT layer, avg(ret) AS ret FROM (SELECT trade_date, layer, avg(ret) AS ret FROM r GROUP BY 1, 2) GROUP BY 1)
    SELECT round((SELECT avg(ret) FROM r), 6) AS universe_avg, round(max(ret) FILTER (layer = {_L} - 1), 6) AS top_layer_avg, round(max(ret) FILTER (layer = 0), 6) AS bottom_layer_avg FROM l""",
)
def factor_universe_spread(spark, d):
    ranked = factors.qualified(_pairs(spark, d), _L)
    ends = factors.layer_returns(ranked).groupBy("layer").agg(F.avg("ret").alias("ret"))
    at = lambda k: F.round(F.max(F.when(F.col("layer") == k, F.col("ret"))), 6)
    return ranked.agg(F.round(F.avg("ret"), 6).alias("universe_avg")).crossJoin(ends.agg(at(_L - 1).alias("top_layer_avg"), at(0).alias("bottom_layer_avg")))


@register(
    "factor_track",
    f"""WITH {S_SQL}, p AS (SELECT ts_code, trade_date, CASE WHEN lag(close, 20) OVER o > 0 THEN close / lag(close, 20) OVER o - 1 END AS value, CASE WHEN close > 0 THEN lead(close, 5) OVER o / close - 1 END AS ret
        FROM s WHERE trade_date BETWEEN DATE '1997-11-17' AND DATE '2000-01-16' WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date)),
    d AS (SELECT * FROM p WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-01-01'), q AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM d WHERE value IS NOT NULL AND ret IS NOT NULL),
    i AS (SELECT trade_date, corr(value, ret) AS ic FROM q WHERE n >= 10 GROUP BY 1)
    SELECT u.trade_date, round(ic, 6) AS ic FROM (SELECT DISTINCT trade_date FROM d) u LEFT JOIN i USING (trade_date)""",
)
def factor_track(spark, d):
    panel = s_panel(spark, d)
    found = factors.track(panel, _factor("momentum", window=20), date(1998, 1, 1), date(2000, 1, 1))
    return found.ic.select("trade_date", F.round("ic", 6).alias("ic"))


_TRACKED_SQL = f"""{S_SQL}, p AS (SELECT ts_code, trade_date, CASE WHEN lag(close, 20) OVER o > 0 THEN close / lag(close, 20) OVER o - 1 END AS value, CASE WHEN close > 0 THEN lead(close, 5) OVER o / close - 1 END AS ret
        FROM s WHERE trade_date BETWEEN DATE '1997-11-17' AND DATE '2000-01-16' WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date)),
    d AS (SELECT * FROM p WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-01-01'), q AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM d WHERE value IS NOT NULL AND ret IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, value) - 1) / 2 AS vr, rank() OVER (PARTITION BY trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2 AS rr,
        least((row_number() OVER (PARTITION BY trade_date ORDER BY value, ts_code) - 1) // (n // 5), 4)::INTEGER AS layer FROM q WHERE n >= 10),
    l AS (SELECT trade_date, layer, avg(ret) AS ret, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT *, product(1 + ret / 5) OVER (PARTITION BY layer ORDER BY trade_date) - 1 AS cum FROM l),
    i AS (SELECT trade_date, corr(value, ret) AS ic, corr(vr, rr) AS rank_ic FROM r GROUP BY 1), days AS (SELECT u.trade_date, ic, rank_ic FROM (SELECT DISTINCT trade_date FROM d) u LEFT JOIN i USING (trade_date))"""


def _tracked(spark, d) -> factors.Tracking:
    return factors.track(s_panel(spark, d), _factor("momentum", window=20), date(1998, 1, 1), date(2000, 1, 1))


@register("factor_track_layers", f"WITH {_TRACKED_SQL} SELECT trade_date, layer, round(ret, 5) AS ret, n, round(cum, 3) AS cum FROM c")
def factor_track_layers(spark, d):
    return _tracked(spark, d).layers.select("trade_date", "layer", F.round("ret", 5).alias("ret"), "n", F.round("cum", 3).alias("cum"))


@register("factor_track_coverage", f"WITH {_TRACKED_SQL} SELECT trade_date, count(*) AS universe, count(value) AS valid, round(count(value) / count(*), 5) AS coverage FROM d GROUP BY 1")
def factor_track_coverage(spark, d):
    return _tracked(spark, d).coverage.select("trade_date", "universe", "valid", F.round("coverage", 5).alias("coverage"))


@register(
    "factor_track_stats",
    f"""WITH {_TRACKED_SQL}, e AS (SELECT layer, arg_max(cum, trade_date) AS cum, avg(ret) AS ret FROM c GROUP BY 1)
    SELECT round(avg(ic), 5) AS ic_mean, round(stddev_samp(ic), 5) AS ic_std, round(avg(ic) / stddev_samp(ic), 4) AS ir, round(avg(rank_ic), 5) AS rank_ic_mean, round(avg(rank_ic) / stddev_samp(rank_ic), 4) AS rank_ir,
    round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 5) AS ic_positive_ratio, count(*) AS samples, (SELECT round(max(cum) FILTER (layer = 4) - max(cum) FILTER (layer = 0), 3) FROM e) AS long_short_cum,
    (SELECT round(max(ret) FILTER (layer = 4), 5) FROM e) AS top_layer_avg, (SELECT round(max(ret) FILTER (layer = 0), 5) FROM e) AS bottom_layer_avg, (SELECT round(avg(ret), 5) FROM r) AS universe_avg FROM days""",
)
def factor_track_stats(spark, d):
    r = lambda c, n=5: F.round(c, n).alias(c)
    return _tracked(spark, d).stats.select(r("ic_mean"), r("ic_std"), r("ir", 4), r("rank_ic_mean"), r("rank_ir", 4), r("ic_positive_ratio"), "samples", r("long_short_cum", 3), r("top_layer_avg"), r("bottom_layer_avg"), r("universe_avg"))


@register("top_n_screen", f"WITH {E_SQL} SELECT ts_code, amount AS value FROM e WHERE trade_date = DATE '2024-01-15' AND amount BETWEEN 50 AND 800 ORDER BY amount DESC, ts_code DESC LIMIT 10")
def top_n_screen(spark, d):
    day = e_panel(spark, d).where(F.col("trade_date") == F.lit(date(2024, 1, 15))).select("ts_code", F.col("amount").alias("value"))
    return factors.top_n(day, 10, band=F.col("value").between(50, 800))


@register("bottom_n_band", "SELECT s_suppkey AS ts_code, s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 7")
def bottom_n_band(spark, d):
    return factors.bottom_n(table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ts_code"), "s_acctbal"), 7, "s_acctbal")


@register(
    "ma_cross_signal",
    f"""WITH {S_SQL}, a AS (SELECT ts_code, trade_date, avg(close) OVER (o ROWS 2 PRECEDING) AS fast, avg(close) OVER (o ROWS 7 PRECEDING) AS slow, row_number() OVER o AS n FROM s WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date))
    SELECT ts_code, trade_date, round(fast, 3) AS fast, round(slow, 3) AS slow, round(fast, 3) > round(slow, 3) AS above FROM a WHERE n >= 8""",
)
def ma_cross_signal(spark, d):
    out = timeseries.moving_averages(s_panel(spark, d), {"fast": 3, "slow": 8}, digits=3)
    return out.select("ts_code", "trade_date", "fast", "slow", (F.col("fast") > F.col("slow")).alias("above"))


# performance and trades

_NAV_SQL = """nav AS (SELECT o_orderstatus AS run_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, round(sum(o_totalprice), 2) AS value, round(sum(o_custkey), 2)::DOUBLE AS benchmark FROM orders GROUP BY 1, 2),
    r AS (SELECT *, value / lag(value) OVER o - 1 AS ret, benchmark / lag(benchmark) OVER o - 1 AS b, max(value) OVER o AS peak FROM nav WINDOW o AS (PARTITION BY run_id ORDER BY trade_date))"""


def _nav(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("run_id"), F.trunc("o_orderdate", "month").alias("trade_date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.sum("o_custkey").cast("double").alias("benchmark"))


@register("nav_drawdown", f"WITH {_NAV_SQL} SELECT run_id, trade_date, round(value / peak - 1, 6) AS drawdown, round(ret, 6) AS ret FROM r")
def nav_drawdown(spark, d):
    return analytics.drawdowns(_nav(spark, d)).select("run_id", "trade_date", F.round("drawdown", 6).alias("drawdown"), F.round("ret", 6).alias("ret"))


@register(
    "nav_metrics",
    f"""WITH {_NAV_SQL}, g AS (SELECT run_id, count(*) AS n, arg_max(value, trade_date) / arg_min(value, trade_date) AS growth, avg(ret) AS m, stddev_pop(ret) AS sd, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) AS down,
        avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS wins, min(value / peak - 1) AS dd, arg_min(trade_date, row(value / peak - 1, trade_date)) AS de FROM r GROUP BY 1)
    SELECT run_id, round(growth - 1, 6) AS total_return, round(pow(growth, 252.0 / (n - 1)) - 1, 4) AS annualized_return, round(sd * sqrt(252), 6) AS volatility, round(m / sd * sqrt(252), 6) AS sharpe, round(m / down * sqrt(252), 6) AS sortino,
    round(dd, 6) AS max_drawdown, de AS drawdown_end, round(wins, 6) AS daily_win_rate FROM g""",
)
def nav_metrics(spark, d):
    out = analytics.metrics(_nav(spark, d))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return out.select("run_id", r("total_return"), r("annualized_return", 4), r("volatility"), r("sharpe"), r("sortino"), r("max_drawdown"), "drawdown_end", r("daily_win_rate"))


@register(
    "benchmark_metrics",
    f"""WITH {_NAV_SQL} SELECT run_id, round(arg_max(value, trade_date) / arg_min(value, trade_date) - arg_max(benchmark, trade_date) / arg_min(benchmark, trade_date), 6) AS excess_return,
    round(avg(ret - b) / stddev_pop(ret - b) * sqrt(252), 6) AS information_ratio, round(covar_pop(ret, b) / var_pop(b), 6) AS beta, round((avg(ret) - covar_pop(ret, b) / var_pop(b) * avg(b)) * 252, 6) AS alpha FROM r GROUP BY 1""",
)
def benchmark_metrics(spark, d):
    out = analytics.against_benchmark(_nav(spark, d))
    return out.select("run_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "run_id"])


@register(
    "fees_slippage",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 100 AS amount, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(price * (1 + side * 0.001) + 1e-7, 4) AS fill, round(greatest(amount * price * 0.0003, 5) + amount * price * 0.0000487 + CASE WHEN side < 0 THEN amount * price * 0.001 ELSE 0 END + 1e-7, 3) AS fees FROM f""",
)
def fees_slippage(spark, d):
    side = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    price, amount = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(market.execution_price(price, side, 0.002) + 1e-7, 4).alias("fill"), F.round(market.fees(amount * price, side < 0) + 1e-7, 3).alias("fees"))


@register(
    "lots_and_limits",
    """SELECT o_orderkey, CASE WHEN substr(o_custkey::VARCHAR, 1, 2) IN ('11', '12', '13') THEN 10 ELSE 100 END AS lot, trunc(o_totalprice / 37.5)::BIGINT AS shares,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice <= 100000 ELSE o_totalprice >= 100000 END AS marketable FROM orders""",
)
def lots_and_limits(spark, d):
    amount = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return table(spark, d, "orders").select(
        "o_orderkey", market.lot_size(F.col("o_custkey").cast("string")).alias("lot"), market.affordable(F.col("o_totalprice"), F.lit(37.5)).alias("shares"), market.marketable(amount, F.col("o_totalprice"), F.lit(100000.0)).alias("marketable")
    )


@register("fundamentals_lookup", f"WITH {C_SQL} SELECT ts_code, round(total_mv * 10000, 2) AS total_value, printf('%.6f%%', turnover_rate) AS turnover FROM c WHERE trade_date = DATE '2024-01-10' ORDER BY ts_code")
def fundamentals_lookup(spark, d):
    day = cross_panel(spark, d).where(F.col("trade_date") == F.lit(date(2024, 1, 10)))
    return day.select("ts_code", F.round(market.valuation("total_value"), 2).alias("total_value"), market.percent_text(market.valuation("turnover_rate")).alias("turnover")).orderBy("ts_code")


@register("trade_numbers", "SELECT event_id, CAST(ts AS DATE) AS trade_date, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) + 5000 AS number FROM events")
def trade_numbers(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("trade_date"))
    return timeseries.numbered(rows, "trade_date", ["ts", "event_id"], 5000).select("event_id", "trade_date", F.col("number").cast("long").alias("number"))


@register("primary_keys", "SELECT l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS key, count(*) AS n FROM lineitem GROUP BY 1")
def primary_keys(spark, d):
    return table(spark, d, "lineitem").groupBy(market.primary_key("l_orderkey", "l_linenumber").alias("key")).agg(F.count("*").alias("n"))


@register(
    "mark_to_market",
    f"WITH {E_SQL}, h AS (SELECT DISTINCT user_id AS security, (user_id % 7 + 1) * 100 AS amount, 50.0 AS last_price FROM events) SELECT security, round(h.amount * coalesce(close, last_price), 4) AS value FROM h LEFT JOIN e ON security = ts_code AND trade_date = DATE '2024-01-12'",
)
def mark_to_market(spark, d):
    held = table(spark, d, "events").select(F.col("user_id").alias("security")).distinct().withColumns({"amount": (F.col("security") % 7 + 1) * 100, "last_price": F.lit(50.0)})
    bars = e_panel(spark, d).where(F.col("trade_date") == F.lit(date(2024, 1, 12))).select(F.col("ts_code").alias("security"), "close")
    return held.join(bars, "security", "left").select("security", F.round(F.col("amount") * F.coalesce("close", "last_price"), 4).alias("value"))


# backtests: sequential, so SQL can't tell them; tests compare them with single runs


def _runs(spark: SparkSession, d: str, trades: bool = False) -> DataFrame:
    import json

    from tidelake.plans import backtest, strategies

    day = Window.partitionBy("trade_date").orderBy("amount", "ts_code")
    bars = e_panel(spark, d).withColumn("amount_rank", F.row_number().over(day).cast("double")).select(
        F.format_string("%06d.SH", "ts_code").alias("ts_code"), dates.format_date_iso(F.col("trade_date")).alias("time"), "open", "high", "low", "close", (F.col("vol") * 10000).alias("volume"), "amount", "amount_rank"
    )
    jobs = [("averages-2-5", "averages", {"fast": 2, "slow": 5}), ("averages-3-8", "averages", {"fast": 3, "slow": 8}), ("rotation-3", "rotation", {"n": 3}), ("limits-98", "limits", {"below": 0.98})]
    table_ = spark.createDataFrame([(i, s, json.dumps(p), "2024-01-01", "2024-12-31", 1_000_000.0, None) for i, s, p in jobs], "run_id string, strategy string, params string, start string, end string, capital double, universe array<string>")
    # trades have no place for an error: a run that fails fails the query
    return backtest.run_trades(table_, bars, strategies.ALL, strict=True) if trades else backtest.navs(table_, bars, strategies.ALL)


@register("backtest_runs")
def backtest_runs(spark, d):
    return _runs(spark, d).select("run_id", "time", F.round("value", 4).alias("value"), F.round("cash", 4).alias("cash"), "error")


@register("backtest_trades")
def backtest_trades(spark, d):
    return _runs(spark, d, trades=True)


@register("backtest_metrics")
def backtest_metrics(spark, d):
    return analytics.metrics(kept(_runs(spark, d).where("value is not null")), at="time")


@register("fifo_lot_stats")
def fifo_lot_stats(spark, d):
    return analytics.fifo(kept(_runs(spark, d, trades=True)))
