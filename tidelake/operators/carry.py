"""Running values over keys of any length, in two levels: blocks of time within a key, then what each block hands on.

A window by key puts a key's whole history into one task. Here a key's rows are cut into blocks of time; rows move once, by key and
block, and each block is scanned by itself. What a block hands on (its last value, sum, maximum, ...) is one row, made before
anything moves; a scan over a key's blocks, at most BLOCKS of them, gives each block what comes before it, and that is added to the
block's own running values. So a hot key is spread over as many tasks as it has blocks, and no task holds more than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Blocks that the whole span of time is cut into, at most.
BLOCKS = 256


@dataclass(frozen=True)
class Running:
    """A value for each row from its key's rows up to it, itself included.

    ``last``: the last that isn't null; ``next``: the first that isn't null from the row on; ``first``: the key's first that isn't null, wherever;
    ``lag``: the row before's; ``lead``: the row after's; ``sum``, ``max``, ``min``, ``product``; ``peak``: the highest that the running sum has been.
    """

    kind: str
    value: Column


def _made(kind: str):
    return lambda c: Running(kind, F.col(c) if isinstance(c, str) else c)


last, following, first, lag, lead, total, most, least, product, peak = map(_made, ("last", "next", "first", "lag", "lead", "sum", "max", "min", "product", "peak"))


def number(rows: DataFrame, c: str) -> Column:
    """A time, or a number, as a number that grows with it; text counts as ISO dates or times, all of it or none."""
    kind = rows.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast(`{c}` AS timestamp_ntz))").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)").cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(c).cast("double")
    raise ValueError(f"{c} is no time or number")


def running(rows: DataFrame, key: list[str], order: list[str], values: dict[str, Running], blocks: int = BLOCKS, span: DataFrame | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values``, over the rows of the same key in ascending order.

    order[0] is a time or a number, which blocks are cut by, evenly from its least to its largest value; ``span`` is one row with both, where
    they are known, or with others that blocks are to be cut by. Rows equal in all of ``order`` come in no certain order, as in a window. Null keys are one key, and null times come
    first. Sums and extremes of no values are null, products one, and null values change none of them. An empty table gives none. ``values``
    may replace columns, but not those of the key or the order.
    """
    parts: dict[str, Running] = {}
    for name, v in values.items():
        if name in key or name in order:
            raise ValueError(f"{name} can't be replaced")
        if v.kind == "product":  # of any sign: the logarithm's sum, how often it is negative, whether it is zero
            parts |= {f"__{name}_l": Running("sum", F.when(v.value != 0, F.ln(F.abs(v.value)))), f"__{name}_m": Running("sum", F.when(v.value < 0, 1).otherwise(0)), f"__{name}_z": Running("max", F.when(v.value == 0, 1).otherwise(0))}
        else:
            parts[f"__{name}_v"] = v
    at = number(rows, order[0])
    span = rows.agg(F.min(at), F.max(at)) if span is None else span
    place = F.floor((at - F.col("__lo")) * blocks / (F.col("__hi") - F.col("__lo") + 1)).cast("int")
    own = rows.select("*", *[v.value.alias(f"{n}i") for n, v in parts.items()])
    # one row goes to all tasks
    placed = own.join(F.broadcast(span.toDF("__lo", "__hi"))).withColumn("__block", F.greatest(F.coalesce(place, F.lit(-1)), F.lit(-1))).drop("__lo", "__hi")
    moved = placed.repartition(*key, "__block")
    inside = Window.partitionBy(*key, "__block").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*key).orderBy("__block")
    before, after, all_ = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing), over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if any(v.kind == "peak" for v in parts.values()):  # a block's own peak needs its order
        sums = [F.sum(f"{n}i").over(so_far).alias(f"{n}s") for n, v in parts.items() if v.kind == "peak"]
        placed = moved = moved.select("*", *sums)
    when = F.struct(*order)
    handed, carried, local = [], [], {}
    for n, v in parts.items():
        i, h, c = F.col(f"{n}i"), f"{n}h", F.col(f"{n}c")
        known = F.when(i.isNotNull(), when)
        if v.kind == "last":
            handed.append(F.max_by(i, known).alias(h))
            carried.append(F.last(h, ignorenulls=True).over(before).alias(f"{n}c"))
            local[n] = F.coalesce(F.last(i, ignorenulls=True).over(so_far), c)
        elif v.kind == "next":
            handed.append(F.min_by(i, known).alias(h))
            carried.append(F.first(h, ignorenulls=True).over(after).alias(f"{n}c"))
            local[n] = F.coalesce(F.first(i, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)), c)
        elif v.kind == "first":
            handed.append(F.min_by(i, known).alias(h))
            carried.append(F.first(h, ignorenulls=True).over(all_).alias(f"{n}c"))
            local[n] = c
        elif v.kind == "lag":  # a null before counts, so it is wrapped
            handed.append(F.max_by(F.struct(i.alias("x")), when).alias(h))
            carried.append(F.last(h, ignorenulls=True).over(before).alias(f"{n}c"))
            local[n] = F.coalesce(F.lag(F.struct(i.alias("x"))).over(inside), c)["x"]
        elif v.kind == "lead":
            handed.append(F.min_by(F.struct(i.alias("x")), when).alias(h))
            carried.append(F.first(h, ignorenulls=True).over(after).alias(f"{n}c"))
            local[n] = F.coalesce(F.lead(F.struct(i.alias("x"))).over(inside), c)["x"]
        elif v.kind == "sum":
            handed.append(F.sum(i).alias(h))
            carried.append(F.sum(h).over(before).alias(f"{n}c"))
            mine = F.sum(i).over(so_far)
            local[n] = F.coalesce(mine + c, mine, c)
        elif v.kind in ("max", "min"):
            f, g = (F.max, F.greatest) if v.kind == "max" else (F.min, F.least)
            handed.append(f(i).alias(h))
            carried.append(f(h).over(before).alias(f"{n}c"))
            local[n] = g(f(i).over(so_far), c)
        elif v.kind == "peak":
            handed += [F.sum(i).alias(h), F.max(f"{n}s").alias(f"{n}p")]
            upto = F.coalesce(F.sum(h).over(before), F.lit(0))
            carried += [upto.alias(f"{n}c"), (upto + F.col(f"{n}p")).alias(f"{n}q")]
            local[n] = F.greatest(F.max(f"{n}s").over(so_far) + c, F.col(f"{n}q"))
        else:
            raise ValueError(f"no such kind: {v.kind}")
    hand = placed.groupBy(*key, "__block").agg(*handed)
    carry = hand.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(key)], F.col("__block").alias("__b"), *carried)
    if peaks := [n for n, v in parts.items() if v.kind == "peak"]:
        earlier = Window.partitionBy(*[f"__k{j}" for j in range(len(key))]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.withColumns({f"{n}q": F.max(f"{n}q").over(earlier) for n in peaks})
    same = F.col("__block") == F.col("__b")
    for j, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    met = moved.join(carry, same)
    made = met.select(*rows.columns, *[local[n].alias(n) for n in parts])
    out = {}
    for name, v in values.items():
        if v.kind == "product":
            sign = F.when(F.col(f"__{name}_m") % 2 == 1, -1.0).otherwise(1.0)
            out[name] = F.when(F.col(f"__{name}_z") == 1, 0.0).otherwise(F.exp(F.coalesce(f"__{name}_l", F.lit(0.0))) * sign)
        else:
            out[name] = F.col(f"__{name}_v")
    return made.select(*[F.col(c) for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])
