"""Market time-series analytics on Spark: typed lake, named queries, factors, time-series operators, backtests."""

__version__ = "0.1.0"
