"""Comparing datasets by hash trees: sums of row digests that don't depend on order, and a way down only where they differ.

A row's digest covers its fields, in order, with which of them are null. Rows fall into buckets of their partition by the hash of
their key. Digests of a bucket are added up, so equal rows in any order and any files give equal sums; a level of the tree is one
aggregation of each side, of which only differing buckets come out. The next level reads these buckets' rows alone, cut
finer; in the end only rows of buckets that still differ meet by key. Equal partitions are never joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that each level cuts a bucket into, and levels below the partitions.
WIDE, DEEP = 64, 2


def digest(fields: list[str], seed: int = 0) -> Column:
    """A row's digest; hashes skip nulls, so which fields are null goes in, too. NaN equals NaN and -0.0 equals 0.0."""
    return F.xxhash64(F.lit(seed), *[F.col(c).isNull() for c in fields], *fields)


def _placed(rows: DataFrame, keys: list[str], levels: int, wide: int) -> DataFrame:
    """Rows with their bucket of each level: places of the key's hash, read as digits."""
    h = F.xxhash64(*[F.col(k).isNull() for k in keys], *keys)
    digit = lambda i: F.pmod(F.shiftrightunsigned(h, 12 * i), F.lit(wide)).cast("int")
    return rows.withColumns({f"__b{i}": digit(i) for i in range(levels)})


def tree(rows: DataFrame, at: list[str], fields: list[str]) -> DataFrame:
    """(at, rows, s0, s1): the number of rows of each bucket and two sums of their digests; tasks add up before anything moves."""
    total = lambda seed: F.sum(digest(fields, seed).cast("decimal(38,0)"))
    return rows.groupBy(*at).agg(F.count("*").alias("rows"), total(1).alias("s0"), total(2).alias("s1"))


def _met(left: DataFrame, right: DataFrame, at: list[str], values: list[str]) -> DataFrame:
    """Both sides by null-safe equality of ``at``, their values as l_ and r_."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in [*at, *values]], F.lit(True).alias(f"{p}here"))
    same = reduce(lambda a, b: a & b, [F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in at])
    own = lambda c: F.when(F.col("l_here"), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c)
    return side(left, "l_").join(side(right, "r_"), same, "full_outer").select(*[own(c) for c in at], *[f"{p}{c}" for p in ("l_", "r_") for c in [*values, "here"]])


def compared_partitions(left: DataFrame, right: DataFrame, partitions: list[str]) -> DataFrame:
    """(partitions, left_rows, right_rows, status) of each partition: same, differs, missing (in right) or extra."""
    fields = [c for c in left.columns if c not in partitions]
    met = _met(tree(left, partitions, fields), tree(right.select(*left.columns), partitions, fields), partitions, ["rows", "s0", "s1"])
    same = (F.col("l_rows") == F.col("r_rows")) & (F.col("l_s0") == F.col("r_s0")) & (F.col("l_s1") == F.col("r_s1"))
    status = F.when(F.col("r_here").isNull(), "missing").when(F.col("l_here").isNull(), "extra").when(same, "same").otherwise("differs")
    return met.select(*partitions, F.col("l_rows").alias("left_rows"), F.col("r_rows").alias("right_rows"), status.alias("status"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], partitions: list[str] | None = None, wide: int = WIDE, deep: int = DEEP) -> DataFrame:
    """(partitions, keys, status, field, left, right): what differs between two tables of the same columns, by key.

    status: ``missing`` (the row is only in left), ``extra`` (only in right), both with a null field, or ``differs``, one row for each field
    whose values differ, as text. Null equals null, keys included. Rows of one key that repeat within a partition are paired in the order of their
    digests, so rows equal on both sides pair up unless others of the key come between. A key in another partition is missing there and extra here. The
    tables may be read several times: each level of the tree reads only partitions that differ, and of those the buckets left.
    """
    partitions = partitions or []
    fields = [c for c in left.columns if c not in keys and c not in partitions]
    sides = [_placed(df, keys, deep, wide) for df in (left, right.select(*left.columns))]
    all_ = [*keys, *fields]
    at: list[str] = list(partitions)
    for level in range(deep):
        at = [*at, f"__b{level}"]
        met = _met(*[tree(s, at, all_) for s in sides], at, ["rows", "s0", "s1"])
        differ = reduce(lambda a, b: a | b, [~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in ("rows", "s0", "s1")])
        # the buckets' numbers, WIDE of a partition in the first level, WIDE of each differing one after it
        left_over = met.where(differ).select(*at)
        if partitions and level == 0:
            # partitions that differ are named in the scans, so that files of the others aren't read; some dozens or hundreds
            named = left_over.select(*partitions).distinct().collect()
            some = reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.lit(r[p])) for p in partitions]) for r in named], F.lit(False))
            sides = [s.where(some) for s in sides]
        renamed = left_over.toDF(*[f"__d{i}" for i in range(len(at))])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__d{i}")) for i, c in enumerate(at)])
        sides = [s.join(renamed, same, "left_semi") for s in sides]
    turn = F.row_number().over(Window.partitionBy(*partitions, *keys).orderBy(digest(all_, 1), digest(all_, 2)))
    numbered = [s.select(*partitions, *all_, turn.alias("__n")) for s in sides]
    met = _met(*numbered, [*partitions, *keys, "__n"], fields)
    text = lambda c: F.col(c).cast("string")
    each = [F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.struct(F.lit(c).alias("field"), text(f"l_{c}").alias("left"), text(f"r_{c}").alias("right"))) for c in fields]
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in ("field", "left", "right")]))
    changed = F.array_compact(F.array(*each)) if each else none
    one_side = F.col("l_here").isNull() | F.col("r_here").isNull()
    status = F.when(F.col("r_here").isNull(), "missing").when(F.col("l_here").isNull(), "extra").otherwise("differs")
    told = met.select(*partitions, *keys, status.alias("status"), F.explode(F.when(one_side, none).otherwise(changed)).alias("c"))
    return told.select(*partitions, *keys, "status", "c.field", "c.left", "c.right")
