"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import free, numbered, written

#: Hex digits of the hash that each histogram resolves, and the number of histograms, each of the last one's boundary bucket.
DIGITS, LEVELS = 3, 5
#: Histograms of what the last of these can't tell apart: by texts, then by rows.
TIES = 6
#: Bytes of sources, one row each, to be broadcast at most; more of them are shuffled.
SOURCES_BYTES = 16 << 20


def n_words(text: str = "text") -> Column:
    """The number of words, runs of anything but the six ASCII white spaces; zero for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, source_size, target) for totals of (source, source_size).

    The weights go to the sources by code point, null last, and repeat. Together the targets are all sizes; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above. That is
    min(l * weight, most * size) for one level l: in the order of most * size / weight the sources that stop come
    first, and l is what remains after them over the remaining weight.
    """
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(everyone) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", level)
    # the first source, in this order, that doesn't stop sets the level
    l = F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(l * F.col("w"), F.col("cap"))).alias("target"))


def _sums(rows: DataFrame, bound: DataFrame, key: str, level: int, sent) -> DataFrame:
    """(source, prefix, size, left, upto): the histogram by ``level`` times DIGITS digits of ``key`` within the bound's buckets (__s, __prefix, left)."""
    inside = rows.join(sent(bound), F.col("source").eqNullSafe(F.col("__s")) & F.startswith(key, "__prefix")).select("source", F.substr(key, F.lit(1), F.lit(DIGITS * level)).alias("prefix"), "size", "left")
    sums = inside.groupBy("source", "prefix").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    return sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("prefix")))


def _boundary(sums: DataFrame) -> DataFrame:
    """(__s, __prefix, left): the first bucket of each source in which its sums pass what is left, and what is left there."""
    first = sums.where("upto > left").groupBy("source").agg(F.min_by(F.struct("prefix", (F.col("left") - F.col("upto") + F.col("size")).alias("left")), "prefix").alias("b"))
    return first.select(F.col("source").alias("__s"), F.col("b.prefix").alias("__prefix"), F.col("b.left").alias("left"))


def copies(sized: DataFrame, weights: list[float], most: float) -> DataFrame:
    """``sized`` (source, size, hash and tie: hex text, and more) with source_size, target and copies (int).

    Each document gets the whole part of target / source_size; the rest of the target goes, as one copy more, to the
    documents with the least hashes. Where that ends is found by sums over hash buckets: the bucket in which they
    reach the rest is looked into again, by the next digits, and so on; no documents are sorted. What the hash's last digits
    can't tell apart, such as rows that repeat an id, is a table of its own, in which ``tie`` goes on in the same way. The document in which the rest
    ends is taken, or left, whichever comes nearer.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = goal.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    goal = written(goal.withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "__source"))
    # one row a source: sent to all tasks if that is little, so that a hot source's documents stay where they are
    told = goal.agg(F.sum(F.octet_length(F.coalesce("__source", F.lit(""))) + 100).alias("bytes")).first()
    sent = F.broadcast if (told.bytes or 0) <= SOURCES_BYTES else lambda df: df
    bound = goal.select(F.col("__source").alias("__s"), F.lit("").alias("__prefix"), F.col("part").alias("left"))
    for level in range(1, LEVELS + 1):
        bound = _boundary(_sums(sized, bound, "hash", level, sent))
    edge = written(bound)
    # the rows of these buckets, a document each where ids don't repeat
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.substr("hash", F.lit(1), F.lit(DIGITS * LEVELS)) == F.col("__prefix"))
    ties = written(sized.join(sent(edge), same).select("source", "tie", "size"))
    bound = edge.select("__s", F.lit("").alias("__prefix"), "left")
    for level in range(1, TIES):
        bound = _boundary(_sums(ties, bound, "tie", level, sent))
    last = _sums(ties, bound, "tie", TIES, sent)
    # "g" comes after all hex digits: the whole bucket is taken
    past = F.concat(F.substr(F.min("prefix"), F.lit(1), F.lit(DIGITS * (TIES - 1))), F.lit("g"))
    stop = last.groupBy(F.col("source").alias("__t")).agg(F.coalesce(F.min(F.when(F.col("upto") - F.col("size") / 2 > F.col("left"), F.col("prefix"))), past).alias("__tie"))
    ends = edge.select("__s", "__prefix").join(stop, F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__t")
    goal = written(goal.join(ends, F.col("__source").eqNullSafe(F.col("__s")), "left"))
    out = sized.join(sent(goal), F.col("source").eqNullSafe(F.col("__source")))
    own = F.substr("hash", F.lit(1), F.lit(DIGITS * LEVELS))
    # a source whose sums never pass the rest takes one copy more of everything
    taken = F.col("__prefix").isNull() | (own < F.col("__prefix")) | ((own == F.col("__prefix")) & (F.substr("tie", F.lit(1), F.lit(DIGITS * TIES)) < F.col("__tie")))
    return out.withColumn("copies", F.col("whole") + F.when((F.col("part") > 0) & taken, 1).otherwise(0)).select(*sized.columns, "source_size", "target", "copies")


def document_hash() -> Column:
    """Hex digits that depend on the id and, where that is null, on the text."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))))


def tie_hash(row: str) -> Column:
    """Hex digits of the text, then of the row's number: what tells rows of one id apart."""
    return F.concat(F.substr(F.md5(F.coalesce("text", F.lit(""))), F.lit(1), F.lit(DIGITS * 2)), F.substr(F.md5(F.col(row).cast("string")), F.lit(1), F.lit(DIGITS * (TIES - 2))))


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    size is the text's number of words (null and empty: 0), copies how often the mix takes the document and taken the
    words of that. A null source is a source of its own. The choice depends on ids (or texts, for null ids) alone, so
    reruns agree; rows that repeat the last id that is taken are told apart by their texts, and equal ones by their places, which
    changes none of the rows' numbers. An empty table gives no rows; other columns are ignored.
    """
    rows = numbered(docs, "_row_")
    sized = written(rows.select("doc_id", "source", n_words().alias("size"), document_hash().alias("hash"), tie_hash("_row_").alias("tie")))
    return copies(sized, list(weights), most).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: list[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns, whatever these are called.

    Null and empty texts, null sources and ids, and rows that repeat are as in mix(); an empty table gives no rows.
    """
    row, own, n = (free([*docs.columns, "hash", "tie", "size", "source_size", "target"], x) for x in ("row", "own_row", "copies"))
    rows = numbered(docs, row)
    slim = written(rows.select(F.col(row).alias(own), "source", n_words().alias("size"), document_hash().alias("hash"), tie_hash(row).alias("tie")))
    often = copies(slim, list(weights), most).where("copies > 0").select(F.col(own), F.col("copies").alias(n))
    found = rows.join(often, F.col(row) == F.col(own))
    return found.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(F.col(f"`{c}`") for c in docs.columns))
