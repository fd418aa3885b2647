"""Spelling variants: words that are one edit apart are found by sorted dictionaries, forwards and backwards.

Let p be the length of the longest common prefix of two words that differ by one inserted, deleted or replaced code point: the edit
can be told to lie at p. If p lies in the upper half of the shorter word, the first half is intact, else the
other one is, so near words stand together in the dictionary sorted forwards or in the one sorted backwards: in a block of
words that share that half. A block is scanned within a task if it has MOST words at most; any larger one is subdivided:
the interval of places in which p may lie is halved, and what is shared grows by what the new half leaves intact, at either end. An
interval of one place ends this: such a block's words differ in one letter at one place, so it has no more words than there
are letters. As p is one place, a pair lies in one interval of each level, so it is found once.

Replacements and insertions have blocks of their own, as other parts of the words stay intact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.common import joined_on_hot, removed, written

#: Words of a block that one task compares with one another at most.
MOST = 512


def words(docs: DataFrame, every: int = 31, least: int = 7) -> DataFrame:
    """(word, n): how often each word of at least ``least`` code points occurs in the texts, with one letter deleted from some.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z. Let h be the crc32 of ``<doc_id>:<run>``; where ``every`` divides
    h, the code point at h % length goes. A null doc_id is written ``null``. Spark's functions alone do this; a task's words are counted before they move.
    """
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # shorter runs can't give a word
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]{%d,}" % least), F.lit(0))).alias("run"))
    h, size = F.col("h"), F.char_length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    found = runs.withColumn("h", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary"))).select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _blocks(listed: DataFrame) -> DataFrame:
    """(word, n, kind, size, longer, low, high, key): every word in both halves of its intervals, for each part it can have in a pair.

    kind: r for replacements, i for insertions; size: the shorter word's length; longer: whether this is the other word; low to
    high: where p may lie; key: what is intact then.
    """
    length = F.char_length("word")
    part = lambda kind, size, longer: F.struct(F.lit(kind).alias("kind"), size.alias("size"), F.lit(longer).alias("longer"))
    parts = listed.select("word", "n", F.explode(F.array(part("r", length, False), part("i", length, False), part("i", length - 1, True))).alias("p")).select("word", "n", "p.*")
    return _halved(parts.withColumn("low", F.lit(0)).withColumn("high", F.when(F.col("kind") == "r", F.col("size") - 1).otherwise(F.col("size"))))


def _halved(parts: DataFrame) -> DataFrame:
    """Each row in both halves of its interval, with new keys."""
    middle = F.expr("(low + high + 1) div 2").cast("int")
    # in the upper half the prefix grows: the dictionary sorted forwards; in the lower half the suffix does
    up, down = F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), (middle - 1).alias("high"))
    halves = parts.withColumn("half", F.explode(F.array(up, down))).drop("low", "high").select("*", "half.*").drop("half")
    # of the shorter word's letters, those after p (replaced there) or from p on (one inserted there) are intact
    tail = F.when(F.col("kind") == "r", F.col("size") - 1 - F.col("high")).otherwise(F.col("size") - F.col("high"))
    ends = F.when(tail > 0, F.substring("word", -tail, tail)).otherwise("")
    return halves.withColumn("key", F.concat_ws(".", F.concat("kind", F.col("size").cast("string")), "low", "high", F.substring("word", F.lit(1), F.col("low")), ends))


def near_words(listed: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, form, form_n): for each word of ``listed`` (word, n) that has near ones, their number and the one of largest n.

    Ties go to the smallest in code-point order. Blocks of more than ``most`` words are subdivided until none is left.
    """
    rest, told = _blocks(listed), None
    while True:
        own = written(rest)
        longer = F.col("longer").cast("int")
        size = own.groupBy("key").agg(F.count("*").alias("n"), F.sum(longer).alias("longer"), F.first("kind").alias("kind"))
        # a block without a pair of the kind has nothing to find
        size = size.where(F.when(F.col("kind") == "r", F.col("n") > 1).otherwise(F.col("longer").between(1, F.col("n") - 1))).select("key", "n")
        blocks = written(joined_on_hot(own.withColumnRenamed("n", "own_n"), size, ["key"], own.count()).withColumnRenamed("n", "words").withColumnRenamed("own_n", "n"))
        removed(own)
        large = (F.col("words") > most) & (F.col("low") < F.col("high"))
        scanned = blocks.where(~large).select("key", "longer", "word", "n", "low", "high").repartition("key").sortWithinPartitions("key", "longer", "word")
        found = written(kernels.apply(scanned, "ScanBlocks", "word string, n_near long, form string, form_n long"))
        told = found if told is None else told.union(found)
        rest = blocks.where(large).drop("words", "key")
        if rest.isEmpty():
            break
        rest = _halved(rest)
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("first")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", "first.form", (-F.col("first.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the end of each word's chain, by doubling its steps; forms are more frequent, so chains end."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        removed(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, every: int = 31, least: int = 7, times: int = 2, ratio: int = 10, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of words() that occurs ``times`` times or more in ``docs``.

    form is the near word of largest n (ties: the smallest) if that n is ``ratio`` times the word's n or more, else null; root is
    the last word of the chain of forms, the word itself without a form. Null and empty texts have no words; repeated rows count
    each; an empty table gives no rows; other columns are ignored.
    """
    listed = written(words(docs, every, least).where(F.col("n") >= times))
    near = near_words(listed, most)
    is_form = F.col("form_n") >= ratio * F.col("n")
    own = listed.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    own = written(own)
    roots = _roots(own.where("form is not null").select("word", "form"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
