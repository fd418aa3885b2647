"""Aggregates whose empty and degenerate cases matter: factor statistics (sample moments) and analytics (population)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def pearson(x: str, y: str) -> Column:
    """The correlation of x and y; null for fewer than three pairs or a constant side."""
    pairs = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))))
    return F.when(pairs >= 3, r)


def average_rank(x: str, group: list[str]) -> Column:
    """The rank from 1 within the group; equal values share the mean of their ranks."""
    ties = F.count("*").over(Window.partitionBy(*group, x))
    return F.rank().over(Window.partitionBy(*group).orderBy(x)) + (ties - 1) / 2


def sample_std(x: Column) -> Column:
    """With n - 1; null for fewer than two."""
    return F.stddev_samp(x)


def population_std(x: Column) -> Column:
    """With n; zero for fewer than two."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def population_covariance(x: str, y: str) -> Column:
    return F.coalesce(F.covar_pop(x, y), F.lit(0.0))


def positive_share(x: Column) -> Column:
    return F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0))


def running_product(x: Column, order: WindowSpec) -> Column:
    """The product of x up to each row; null counts as one. Works for factors of any sign."""
    log = F.sum(F.coalesce(F.when(x != 0, F.ln(F.abs(x))), F.lit(0.0))).over(order)
    minus = F.sum(F.when(x < 0, 1).otherwise(0)).over(order)
    zero = F.max(F.when(x == 0, 1).otherwise(0)).over(order)
    return F.when(zero == 1, 0.0).otherwise(F.exp(log) * F.when(minus % 2 == 1, -1.0).otherwise(1.0))


def percentiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], most: str | None = None) -> DataFrame:
    """For each key the least value that so large a share of its values doesn't exceed, under each name, and the largest under ``most``; nulls don't count."""
    ranks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)").alias(n) for n, q in shares.items()]
    return rows.groupBy(*key).agg(*ranks, *([F.max(value).alias(most)] if most else []))
