"""Repeated passages: every byte that some ``width``-byte string covers which also starts elsewhere in the corpus.

In the corpus's suffix order, the suffixes that share their first ``width`` bytes stand together; a suffix has an earlier
(or later) match of that length if, and only if, its interval has a smaller (or larger) position. Which interval a
suffix belongs to is all that is needed, and the interval's hash tells it. A suffix array of the corpus would take many
times its size on disk (README.md has the figures); longest_previous_factors() makes one, with the previous and next
smaller positions in it, for a text that fits into memory.

So as to write down few hashes, starting places are taken together as long as they can be:

1. Whole copies of a text lose all their bytes (SHA-256 tells them); one of them stays as evidence for other texts.
2. Places whose strings have the same anchor (java/Runs.java) form a run. A run whose anchor's key is found nowhere else
   has no repeated string. These are most, and their keys are all that is ever written of them.
3. Of the others, a run's outer passage is all that its strings cover. If it repeats, so do all of them. Else the run is
   cut into blocks of places by their distance to the anchor; what all strings of a whole block share is the block's key.
4. Step 3 is done again with the blocks, which get smaller down to single strings. A block meets those with the same
   key only, and of blocks with the same outer passage one is enough.

Keys have 64 bits and only choose what is looked at further; passages are told by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.common import joined_on_hot, numbered, removed, text_bytes, tidy, written

#: Places in a block, level after level.
BLOCKS = (32, 4, 1)
_SPAN = "array<struct<start: long, end: long>>"
_PASSAGE = "row long, known boolean, at int, lo int, hi int, key long, h1 long, h2 long"


def _settled(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written passages: (row, lo, hi) of those that are found again, and (row, items) of what to cut further.

    A passage that is ``known`` is settled already and serves as evidence for others only.
    """
    total = passages.count()
    outer = written(
        passages.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min(F.struct("row", "at", "lo", "hi")).alias("one"))
        .select("*", F.expr("n > 1 or known").alias("sure"))
    )
    again = outer.where("n > 1").select("h1", "h2", "n")
    sure = written(joined_on_hot(passages.where("not known"), again, ["h1", "h2"], total).select("row", "lo", "hi"))
    open_ = outer.groupBy("key").agg(F.count("*").alias("n"), F.min("sure").alias("all")).where("n > 1 and not all").select("key", "n")
    todo = joined_on_hot(outer.select("key", "one", "sure"), open_, ["key"], total).select("one.*", "sure")
    items = written(todo.groupBy("row").agg(F.collect_list(F.struct("at", "lo", "hi", F.col("sure").alias("known"))).alias("items")))
    removed(outer)
    return sure, items


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, sha) for every row of ``docs``.

    Texts are UTF-8 bytes (null: empty). spans are the maximal runs of removed bytes: those that a string of ``width``
    bytes covers which also starts elsewhere, in this text or another; strings don't run over a text's end. kept holds
    what is left of a text that lost bytes, else null, and sha is the SHA-256 of what is left. Copies of a text all
    lose their bytes. Repeated rows are texts of their own; an empty table gives none; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = numbered(docs.select("doc_id", "text")).select("row", "doc_id", text_bytes().alias("text"))
    facts = written(kernels.apply(source, "TextFacts", f"row long, doc_id {kind}, n_bytes long, sha binary, keys array<long>", width))
    total = facts.count()
    copies = facts.where(F.col("n_bytes") >= width).groupBy("sha").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    copied = written(joined_on_hot(facts.select("row", "sha"), copies, ["sha"], total).select("row", F.expr("row = first").alias("stays")))
    status = facts.select("row", "keys").join(copied, "row", "left")
    keys = written(status.where("stays is null or stays").select("row", F.expr("stays is not null").alias("copied"), F.explode("keys").alias("key")))
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = joined_on_hot(keys, twice, ["key"], keys.count()).groupBy("row", "copied").agg(F.collect_set("key").alias("keys"))
    # a text that shares nothing with another one needn't be looked at again
    texts = written(source.select("row", "text").join(shared, "row").select("row", "copied", "text", "keys"))
    passages = written(kernels.apply(texts, "RunPassages", _PASSAGE, width))
    tidy(keys)
    found = []
    for size in BLOCKS:
        sure, items = _settled(passages)
        found.append(sure)
        tidy(passages)
        passages = written(kernels.apply(texts.select("row", "text").join(items, "row"), "BlockPassages", _PASSAGE, width, size))
        tidy(items)
    sure, items = _settled(passages)
    found.append(sure)
    tidy(passages, items)
    places = found[0]
    for more in found[1:]:
        places = places.union(more)
    gone = texts.where("not copied").select("row", "text").join(places.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("places")), "row")
    cut = kernels.apply(gone, "CutSpans", f"row long, spans {_SPAN}, kept binary", width)
    whole = facts.select("row", "doc_id", "n_bytes", "sha").join(copied, "row", "left").join(cut, "row", "left")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    kept = F.when(F.col("stays").isNotNull(), F.lit(b"")).otherwise(F.col("kept"))
    return whole.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("stays").isNotNull(), all_).otherwise(F.coalesce("spans", F.array().cast(_SPAN))).cast(_SPAN).alias("spans"),
        kept.alias("kept"),
        F.coalesce(F.sha2(kept, 256), F.lower(F.hex("sha"))).alias("sha"),
    )


def suffix_array(text: bytes):
    """Suffix positions in order, by doubling the length of the compared prefixes."""
    import numpy as np

    n = len(text)
    rank = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    size = 1
    while n:
        after = np.concatenate([rank[size:], np.zeros(min(size, n), np.int64)])
        _, rank = np.unique(rank * (max(n, 256) + 2) + after, return_inverse=True)
        rank = rank.ravel() + 1
        if rank.max() == n or size >= n:
            break
        size *= 2
    return np.argsort(rank, kind="stable")


def longest_previous_factors(text: bytes) -> list[int]:
    """For each place the length of the longest string that starts there and also starts earlier.

    The earlier place that shares most is, in the suffix order, the nearest smaller one before or after; both are found
    with a stack, and each text place starts from what its predecessor shared, less one.
    """
    n = len(text)
    order = suffix_array(text).tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for p in order:
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    out, shared = [0] * n, {"before": 0, "after": 0}
    for i in range(n):
        for side, at in (("before", before[i]), ("after", after[i])):
            k = max(0, shared[side] - 1)
            if at < 0:
                k = 0
            else:
                while i + k < n and text[at + k] == text[i + k]:
                    k += 1
            shared[side] = 0 if at < 0 else k
            out[i] = max(out[i], k)
    return out
