"""Alignment of two tokenizers by a dictionary of groups.

Both sides' tokens of a text are cut into groups at the bytes where tokens of both end. Few groups differ, as words repeat, so
each different group is interned once, with the number of documents that hold it; its links are expanded once, and the
counts of pairs of ids are sums of those numbers. A document that holds a pair in several of its groups would count more than
once there; it says so itself, and that surplus comes off. What a group adds to its documents goes back to them by the group's key.

A group's key is its ids themselves, so no two groups share one. The most frequent groups, SENT of them at most, are sent to
all tasks; a document's other groups meet theirs by shuffle. So what moves are the tasks' distinct groups and the documents' rare
ones, never the tokens.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm import kernels
from tidelake.llm.common import joined_on_hot, numbered, text_bytes, tidy, written
from tidelake.llm.tokens import alphabet

#: Groups that are sent to all tasks, of some forty bytes each.
SENT = 1 << 17


@cache
def pieces(model: str) -> str:
    """The pieces of a sentencepiece model of merges by score, as java/Pieces.java reads them: [name, id, rank], rank -1 for bytes."""
    from sentencepiece import sentencepiece_model_pb2 as parts

    told = parts.ModelProto()
    with open(model, "rb") as f:
        told.ParseFromString(f.read())
    normal, kinds = told.normalizer_spec, parts.ModelProto.SentencePiece
    if told.trainer_spec.model_type != told.trainer_spec.BPE or not told.trainer_spec.byte_fallback or told.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{model} is no model of merges with single bytes")
    if normal.precompiled_charsmap or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError(f"{model} changes texts")
    names = [(i, p.piece, p.score) for i, p in enumerate(told.pieces) if p.type == kinds.NORMAL]
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in told.pieces) or any(" " in n or "▁" in n.lstrip("▁") for _, n, _ in names):
        raise ValueError(f"{model} has pieces of other forms")
    rank = {s: r for r, s in enumerate(sorted({s for _, _, s in names}, reverse=True))}
    single = [(int(p.piece[3:5], 16), i, -1) for i, p in enumerate(told.pieces) if p.type == kinds.BYTE]
    return json.dumps([(n.replace("▁", " "), i, rank[s]) for i, n, s in names] + single)


def _frequent(groups: DataFrame, most: int) -> DataFrame:
    """The groups (key, docs) held by as many documents as the ``most``-th, by a histogram of eighths of powers of two."""
    step = F.floor(8 * F.log2("docs")).cast("int")
    total, least = 0, None
    for r in groups.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred rows
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["step"]
    return groups.where(F.lit(False) if least is None else step >= least)


def alignment(docs: DataFrame, left: str, right: str, sent: int = SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    left is a byte-level file, right a sentencepiece model, which sets a space before each text, as is done for left. Special
    strings are plain text. A pair's count is how many rows hold it linked, repeated rows each; n_best counts the links whose pair
    has the highest count of its A id, ties included, and count_sum sums the counts over all links. Texts that are null, empty,
    no UTF-8 or hold the mark for spaces (U+2581) have no tokens: zeros and an empty string. Null ids stay, an empty table
    gives no rows, other columns are ignored.
    """
    known = alphabet(left)
    if known is None or known.words:
        raise ValueError(f"{left} isn't of byte level")
    args = (left, known.kinds, known.lower, pieces(right))
    rows = numbered(docs, "_row_")
    told = written(kernels.apply(rows.select(text_bytes().alias("text")), "GroupCounts", "key binary, a int, b int, n long", *args))
    groups = written(told.where("key is not null").groupBy("key").agg(F.sum("n").alias("docs")))
    links = written(kernels.apply(groups, "GroupLinks", "key binary, a int, b int, times int, docs long", *args))
    surplus = told.where("key is null").select("a", "b", (-F.col("n")).alias("n"), F.lit(0).alias("groups"))
    pairs = links.select("a", "b", F.col("docs").alias("n"), F.lit(1).alias("groups")).union(surplus).groupBy("a", "b").agg(F.sum("n").alias("count"), F.sum("groups").alias("n"))
    # an id has fewer partners than the other vocabulary has ids
    best = pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    joined = joined_on_hot(links.select("key", "a", "b", "times"), written(best), ["a", "b"], links.count())
    worth = joined.groupBy("key").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best"), F.sum(F.col("times") * F.col("count")).alias("counts"))
    worth = written(worth.join(groups, "key"))
    tidy(told, links, groups)
    frequent = _frequent(worth, sent).select("key", "best", "counts")
    base = kernels.apply(rows.select("_row_", text_bytes().alias("text")), "AlignTokens", "_row_ long, n_a long, n_b long, n_groups long, n_links long, digest binary, keys array<binary>, times array<int>", *args)
    each = base.select("*", F.posexplode_outer(F.arrays_zip("keys", "times")).alias("at", "g"))
    first = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c))  # noqa: E731  a row's own figures go with its first group
    own = [first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "digest")]
    met = each.select("_row_", *own, F.col("g.keys").alias("key"), F.col("g.times").alias("t")).join(F.broadcast(frequent), "key", "left")
    rare = F.when(F.col("best").isNull(), F.col("key"))
    sums = [F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "digest")]
    # the groups found are summed before anything moves: a row a document and one for each of its rare groups
    parts = written(met.groupBy("_row_", rare.alias("key")).agg(*sums, F.sum(F.col("t") * F.col("best")).alias("n_best"), F.sum(F.col("t") * F.col("counts")).alias("count_sum"), F.sum("t").alias("t")))
    seldom = parts.where("key is not null").select("_row_", "key", "t")
    asked = seldom.groupBy("key").agg(F.count("*").alias("n")).join(worth.select("key", "best", "counts"), "key")
    late = joined_on_hot(seldom, asked, ["key"], seldom.count()).select("_row_", (F.col("t") * F.col("best")).alias("n_best"), (F.col("t") * F.col("counts")).alias("count_sum"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("digest", "binary"))]
    stacked = parts.select("_row_", "n_a", "n_b", "n_groups", "n_links", "digest", "n_best", "count_sum").union(late.select("_row_", *nothing, "n_best", "count_sum"))
    zero = F.lit(0).cast("long")
    whole = stacked.groupBy("_row_").agg(*sums, F.coalesce(F.sum("n_best"), zero).alias("n_best"), F.coalesce(F.sum("count_sum"), zero).alias("count_sum"))
    return rows.select("_row_", "doc_id").join(whole, "_row_").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"))
