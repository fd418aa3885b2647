"""Deep pages of a sorted table: ranges of rows are counted and skipped, and only the page's own surroundings are sorted.

An offset with a limit sends offset + limit rows of each task to one. Here the rows are cut into ranges of the sort key by a small sample;
one aggregation counts them, and the range that holds the page's first row is cut again, until few rows are left before
the page. Filters by the ranges' ends reach the scan, so later rounds read less. A page after a known row needs no counts.
"""

from __future__ import annotations

import json
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows before the page that are sorted with it at most, and ranges that each round cuts.
FEW, RANGES = 100_000, 64


def _less(order: list[str], row: tuple, kinds: dict, or_equal: bool) -> Column:
    """Whether a row comes before ``row`` in ascending order, nulls first; or equals it."""
    out = F.lit(or_equal)
    for c, v in reversed(list(zip(order, row))):
        x = F.lit(v).cast(kinds[c])
        below = F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < x)
        out = below | (F.col(c).eqNullSafe(x) & out)
    return out


def page(rows: DataFrame, order: list[str], offset: int, limit: int, few: int = FEW, ranges: int = RANGES, seed: int = 7) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ascending order, nulls first; fewer where the table ends.

    ``order`` should tell rows apart; of rows equal in it, which come first isn't certain, and more than ``few`` equal ones are sorted together.
    The table must give the same rows each time it is read.
    """
    kinds = {c: rows.schema[c].dataType for c in order}
    rest, before, low = rows, offset, None
    while before > few:
        size = rest.count()
        if before >= size:
            return rows.limit(0)
        # a sample of bounded size: some rows for each range
        some = rest.select(*order).sample(min(1.0, 16 * ranges / size), seed).collect()
        key = lambda r: tuple((v is not None, v) for v in r)
        some = sorted({tuple(r) for r in some}, key=key)
        cuts = some[:: max(1, len(some) // ranges)][1:]
        if not cuts:
            break
        place = reduce(lambda a, b: a + b, [F.when(_less(order, c, kinds, True), 0).otherwise(1) for c in cuts])
        counts = {r.place: r["count"] for r in rest.groupBy(place.alias("place")).count().collect()}  # one row a range
        at, skipped = 0, 0
        while skipped + counts.get(at, 0) <= before:
            skipped += counts.get(at, 0)
            at += 1
        if at == 0 and counts.get(0, 0) == size:
            break
        # the ranges before are left out; those after it stay for the page's end
        last = skipped + counts.get(at, 0) >= before + limit
        if at:
            low = cuts[at - 1]
            rest = rows.where(~_less(order, low, kinds, True))
        if last and at < len(cuts):
            rest = rest.where(_less(order, cuts[at], kinds, True))
        if not skipped and not (last and at < len(cuts)):
            break
        before -= skipped
        seed += 1
    return rest.orderBy(*order).offset(before).limit(limit) if before else rest.orderBy(*order).limit(limit)


def token(row, order: list[str]) -> str:
    """What after() needs to go on behind a row."""
    return json.dumps([v.isoformat() if isinstance(v, (date, datetime)) else v for v in (row[c] for c in order)])


def after(rows: DataFrame, order: list[str], at: str, limit: int) -> DataFrame:
    """The ``limit`` rows behind the row that ``at`` tells (all from the first on, where it is empty), in ascending order; no row before them is sorted."""
    kinds = {c: rows.schema[c].dataType for c in order}
    if at:
        known = json.loads(at)
        if len(known) != len(order):
            raise ValueError("the token is of another order")
        rows = rows.where(~_less(order, tuple(known), kinds, True))
    return rows.orderBy(*order).limit(limit)
