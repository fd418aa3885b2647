"""Cross-sectional factors: values, forward returns, information coefficients, quantile layers, coverage.

A panel is a DataFrame of (ts_code, trade_date, close, pct_chg, turnover_rate, total_mv, and more fields). All windows
share one shuffle by code; what is done per day takes one more.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.functions.market import finite
from tidelake.operators import carry, stats

#: Factor kinds with their parameters as (name, type, default), and the fields of the ``field`` kind.
KINDS = {
    "momentum": (("window", "int", 20),),
    "reversal": (("window", "int", 5),),
    "volatility": (("window", "int", 20),),
    "turnover": (("window", "int", 20),),
    "size": (("log", "bool", True),),
    "field": (("field", "string", "pb"),),
}
FIELDS = ("pb", "pe_ttm", "ps_ttm", "dv_ttm", "total_mv", "circ_mv", "turnover_rate", "close")
INPUTS = ("close", "pct_chg", "turnover_rate", "pb", "pe_ttm", "ps_ttm", "dv_ttm", "total_mv", "circ_mv")


@dataclass
class Factor:
    id: str
    kind: str
    name: str = ""
    params: dict = field(default_factory=dict)
    description: str = ""
    direction: str = ""
    created_at: str = ""

    def param(self, name: str):
        return self.params.get(name, {n: d for n, _, d in KINDS[self.kind]}.get(name))

    @property
    def window(self) -> int:
        """The parameter if it is positive, else the kind's default."""
        otherwise = next((d for n, _, d in KINDS[self.kind] if n == "window"), 20)
        w = int(self.params.get("window", otherwise))
        return w if w > 0 else otherwise

    def validate(self) -> None:
        if not self.id.strip() or not self.name.strip():
            raise ValueError("a factor needs an id and a name")
        if self.kind not in KINDS:
            raise ValueError(f"no such factor kind: {self.kind}")
        if self.direction not in ("", "positive", "negative"):
            raise ValueError("direction is positive or negative")
        for name, kind, _ in KINDS[self.kind]:
            value = self.params.get(name)
            if value is None:
                continue
            if kind == "int" and (isinstance(value, bool) or float(value) != int(float(value))):
                raise ValueError(f"{name} must be an integer")
            if kind == "bool" and str(value).lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"{name} must be true or false")


class FactorRegistry:
    """Factors in a JSON file, sorted by id and replaced at once."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.items = {x["id"]: Factor(**x) for x in json.loads(self.path.read_text())} if self.path.exists() else {}

    def list(self) -> list[Factor]:
        return [self.items[k] for k in sorted(self.items)]

    def get(self, key: str) -> Factor | None:
        return self.items.get(key)

    def put(self, factor: Factor) -> None:
        factor.validate()
        if factor.id not in self.items:
            factor.created_at = datetime.now(timezone.utc).isoformat()
        self.items[factor.id] = factor
        self._save()

    def delete(self, key: str) -> None:
        if key not in self.items:
            raise KeyError(f"no factor {key}")
        del self.items[key]
        self._save()

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        tmp = self.path.with_suffix(".tmp")
        tmp.write_text(json.dumps([asdict(f) for f in self.list()], ensure_ascii=False, indent=2))
        os.replace(tmp, self.path)


def catalog() -> list[dict]:
    return [{"kind": k, "params": [dict(zip(("name", "type", "default"), p)) for p in ps]} for k, ps in KINDS.items()]


def value(factor: Factor, null_as_zero: bool = True, code: str = "ts_code", day: str = "trade_date") -> Column:
    """The factor's value on each row of a panel, null where it isn't defined.

    Missing inputs count as zero unless ``null_as_zero`` is false.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if null_as_zero else F.col(c)
    own = Window.partitionBy(code).orderBy(day)
    n = factor.window
    last = own.rowsBetween(-(n - 1), 0)
    enough = F.row_number().over(own) > n
    if factor.kind in ("momentum", "reversal"):
        base = F.lag(num("close"), n).over(own)
        out = F.when(base > 0, num("close") / base - 1)
        out = -out if factor.kind == "reversal" else out
    elif factor.kind == "volatility":
        out = F.when(enough, F.stddev_samp(num("pct_chg")).over(last))
    elif factor.kind == "turnover":
        out = F.when(enough, F.avg(num("turnover_rate")).over(last))
    elif factor.kind == "size":
        mv = num("total_mv")
        out = F.when(mv > 0, F.ln(mv) if str(factor.param("log")).lower() in ("true", "1") else mv)
    elif factor.kind == "field" and factor.param("field") in FIELDS:
        out = num(factor.param("field"))
    else:
        out = F.lit(None).cast("double")
    return finite(out)


def forward_return(horizon: int, code: str = "ts_code", day: str = "trade_date") -> Column:
    """close after ``horizon`` rows over close, less one; null where the series ends earlier or the base isn't positive."""
    close = F.coalesce(F.col("close"), F.lit(0.0))
    return F.when(close > 0, F.lead(close, horizon).over(Window.partitionBy(code).orderBy(day)) / close - 1)


def load_range(start, end, window: int, horizon: int | None) -> tuple:
    """Calendar days that are read: windows and returns look no farther than this."""
    return start - timedelta(days=2 * window + 5), end + timedelta(days=2 * horizon + 5 if horizon else 0)


def paired(panel: DataFrame, factor: Factor, start, end, horizon: int, null_as_zero: bool = True, day: str = "trade_date") -> DataFrame:
    """(ts_code, day, value, ret) for the days from start to end."""
    lo, hi = load_range(start, end, factor.window, horizon)
    some = panel.where(F.col(day).between(F.lit(lo), F.lit(hi)))
    out = some.select("ts_code", day, value(factor, null_as_zero, day=day).alias("value"), forward_return(horizon, day=day).alias("ret"))
    return out.where(F.col(day).between(F.lit(start), F.lit(end)))


def daily_coverage(pairs: DataFrame, day: str = "trade_date") -> DataFrame:
    """(day, universe, valid, coverage)."""
    return pairs.groupBy(day).agg(F.count("*").alias("universe"), F.count("value").alias("valid"), (F.count("value") / F.count("*")).alias("coverage"))


def qualified(pairs: DataFrame, layers: int, day: str = "trade_date") -> DataFrame:
    """Pairs with both sides, of days that have at least two for each layer, with their number and ranks."""
    both = pairs.where("value is not null and ret is not null")
    each = Window.partitionBy(day)
    out = both.withColumn("n", F.count("*").over(each)).where(F.col("n") >= 2 * layers)
    out = out.withColumns({"value_rank": stats.average_rank("value", [day]), "ret_rank": stats.average_rank("ret", [day])})
    rn = F.row_number().over(each.orderBy("value", "ts_code"))
    # the remainder goes to the last layer, unlike ntile's
    return out.withColumn("layer", F.least(F.floor((rn - 1) / F.floor(F.col("n") / layers)), F.lit(layers - 1)).cast("int"))


def daily_ic(ranked: DataFrame, day: str = "trade_date") -> DataFrame:
    """(day, ic, rank_ic, n)."""
    return ranked.groupBy(day).agg(stats.pearson("value", "ret").alias("ic"), stats.pearson("value_rank", "ret_rank").alias("rank_ic"), F.count("*").alias("n"))


def layer_returns(ranked: DataFrame, day: str = "trade_date") -> DataFrame:
    return ranked.groupBy(day, "layer").agg(F.avg("ret").alias("ret"), F.count("*").alias("n"))


def layer_cumulative(returns: DataFrame, horizon: int, day: str = "trade_date") -> DataFrame:
    """Each layer's compounded return, a day's return spread over the horizon."""
    return carry.running(returns, ["layer"], [day], {"cum": carry.product(1 + F.col("ret") / horizon)}).withColumn("cum", F.col("cum") - 1)


def ic_summary(daily: DataFrame) -> DataFrame:
    """One row of statistics of the daily coefficients."""
    parts = []
    for c, p in (("ic", ""), ("rank_ic", "rank_")):
        mean, std = F.avg(c), stats.sample_std(F.col(c))
        parts += [mean.alias(f"{p}ic_mean"), std.alias(f"{p}ic_std"), F.try_divide(mean, std).alias(f"{p}ir")]
    return daily.agg(*parts, stats.positive_share(F.col("ic")).alias("ic_positive_ratio"), F.count("*").alias("days"))


@dataclass
class Tracking:
    """A factor's record; ``stats`` is one row, the rest is by day (and layer)."""

    ic: DataFrame
    layers: DataFrame
    coverage: DataFrame
    stats: DataFrame


def track(panel: DataFrame, factor: Factor, start, end, horizon: int = 5, layers: int = 5, null_as_zero: bool = True) -> Tracking:
    """Daily coefficients, layers, coverage and their statistics; days with too few pairs have null coefficients."""
    horizon, layers = horizon if horizon > 0 else 5, layers if layers > 0 else 5
    pairs = paired(panel, factor, start, end, horizon, null_as_zero)
    ranked = qualified(pairs, layers)
    coverage = daily_coverage(pairs)
    ic = coverage.select("trade_date").join(daily_ic(ranked), "trade_date", "left")
    rets = layer_returns(ranked)
    cum = layer_cumulative(rets, horizon)
    ends = cum.groupBy("layer").agg(F.max_by("cum", "trade_date").alias("cum"), F.avg("ret").alias("avg"))
    at = lambda c, k: F.max(F.when(F.col("layer") == k, F.col(c)))
    spread = ends.agg((at("cum", layers - 1) - at("cum", 0)).alias("long_short_cum"), at("avg", layers - 1).alias("top_layer_avg"), at("avg", 0).alias("bottom_layer_avg"))
    universe = ranked.agg(F.avg("ret").alias("universe_avg"))
    one = ic_summary(ic).withColumnRenamed("days", "samples").crossJoin(spread).crossJoin(universe)
    return Tracking(ic, cum, coverage, one)


def coverage(panel: DataFrame, factor: Factor, start, end, null_as_zero: bool = True) -> DataFrame:
    lo, _ = load_range(start, end, factor.window, None)
    some = panel.where(F.col("trade_date").between(F.lit(lo), F.lit(end)))
    own = some.select("ts_code", "trade_date", value(factor, null_as_zero).alias("value")).where(F.col("trade_date") >= F.lit(start))
    return daily_coverage(own)


def top_n(scores: DataFrame, n: int, score: str = "value", band: Column | None = None) -> DataFrame:
    """The n highest scores, ties by the larger code, within an optional band."""
    rows = scores if band is None else scores.where(band)
    return rows.orderBy(F.desc(score), F.desc("ts_code")).limit(n)


def bottom_n(scores: DataFrame, n: int, score: str) -> DataFrame:
    return scores.orderBy(F.col(score), "ts_code").limit(n)
