"""Typed predicates on a dataset's fields, joined by AND, and the partitions that they imply."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.registry import TYPES, Dataset

OPERATORS = ("=", "in", ">=", "<=", ">", "<")
#: Lists longer than this are joined, not listed in the plan.
LIST_MOST = 1000
_PYTHON = {"string": str, "date": date, "timestamp": datetime, "float64": (float, int), "int64": int, "bool": bool}


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: object

    def fitting(self, dataset: Dataset) -> list:
        """The values of the field's own kind, each once; one of another kind is never equal, more or less."""
        kind = dataset.type_of(self.field)
        if self.op not in OPERATORS:
            raise ValueError(f"no such operator: {self.op}")
        values = list(self.value) if self.op == "in" else [self.value]
        # a datetime is a date to Python, and a bool a number
        fits = [v for v in values if isinstance(v, _PYTHON[kind]) and isinstance(v, datetime) == (kind == "timestamp") and isinstance(v, bool) == (kind == "bool")]
        return list(dict.fromkeys(float(v) if kind == "float64" else v for v in fits))

    def literals(self, dataset: Dataset) -> list[Column]:
        return [F.lit(v).cast(TYPES[dataset.type_of(self.field)]) for v in self.fitting(dataset)]

    def column(self, dataset: Dataset) -> Column:
        """A condition with literals of the field's own type; a value of another kind is never true, as null is."""
        c, literals = F.col(self.field), self.literals(dataset)
        if not literals:
            return F.lit(False)
        if self.op == "in":
            return c.isin(*literals)
        return {"=": c == literals[0], ">=": c >= literals[0], "<=": c <= literals[0], ">": c > literals[0], "<": c < literals[0]}[self.op]


def applied(rows: DataFrame, dataset: Dataset, predicates: list[Predicate]) -> DataFrame:
    """Rows that meet all predicates. Long lists become semi joins, with the same values as short ones would have."""
    for p in predicates:
        if p.field not in dataset.names:
            raise KeyError(f"{dataset.name} has no field {p.field}")
    short = [p for p in predicates if p.op != "in" or len(p.fitting(dataset)) <= LIST_MOST]
    if short:
        rows = rows.where(reduce(lambda a, b: a & b, [p.column(dataset) for p in short]))
    for p in predicates:
        if p not in short:
            kind = TYPES[dataset.type_of(p.field)]
            listed = rows.sparkSession.createDataFrame([(v,) for v in p.fitting(dataset)], T.StructType([T.StructField(p.field, kind)]))
            rows = rows.join(listed, p.field, "left_semi")
    return rows


def time_bounds(dataset: Dataset, predicates: list[Predicate]) -> tuple[date | None, date | None]:
    """The days that the predicates leave for the dataset's time field; the first is past the last if none."""
    lo = hi = None
    day = lambda v: v.date() if isinstance(v, datetime) else v
    for p in predicates:
        if p.field != dataset.time_field:
            continue
        values = [day(v) for v in (p.value if p.op == "in" else [p.value]) if isinstance(v, date)]
        if not values:
            return date.max, date.min
        if p.op in ("=", "in", ">=", ">"):
            lo = max(lo or date.min, min(values))
        if p.op in ("=", "in", "<=", "<"):
            hi = min(hi or date.max, max(values))
    return lo, hi


def implied_partitions(dataset: Dataset, predicates: list[Predicate]) -> Column | None:
    """A condition on year and month partitions that holds for every row the predicates can match, or None.

    The year and month of the time field are partitions; this can't be inferred from files, so the plan says it.
    """
    lo, hi = time_bounds(dataset, predicates)
    parts = []
    if "year" not in dataset.partitions or (lo is None and hi is None):
        return None
    if lo and hi and lo > hi:
        return F.lit(False)
    # rows without a date lie in year=unknown and match no range
    year = F.col("year")
    if lo:
        parts.append(year >= f"{lo.year:04d}")
    if hi:
        parts.append(year <= f"{hi.year:04d}")
    if "month" in dataset.partitions:
        month = F.col("month")
        if lo:
            parts.append((year > f"{lo.year:04d}") | (month >= f"{lo.month:02d}"))
        if hi:
            parts.append((year < f"{hi.year:04d}") | (month <= f"{hi.month:02d}"))
    return reduce(lambda a, b: a & b, parts)
