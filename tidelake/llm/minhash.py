"""MinHash near-duplicates by SuperMinHash signatures.

A text's set of shingles gets a signature of ROWS * BANDS places (java/SuperMinHash.java). Each element deals the places in a
random order of its own, and the later a place comes, the larger is its value, so the places of a signature depend on one
another in a way that makes the share of equal places vary less than with independent hashes, and an element stops as soon
as it can't improve any place. Sets that agree in all ROWS places of some band are candidates; a pair at similarity s
misses all bands with probability (1 - s^ROWS)^BANDS, 8e-7 at 0.85. Every candidate is confirmed on the full sets.

Groups form by union-find, as alternating stars over tables, in two steps. First each bucket's hub meets its members: the one that
meets most others in all its buckets, as the origin of copies does; that settles most buckets. Of the others, small ones
give their pairs, each once. Larger ones are read as blocks of bounded size: a task holds a block's sets, skips what one
component holds already and gives only links that join two components. A bucket too large for one block is dealt into
parts, and each two parts meet in a block. So every candidate pair is either compared on its whole sets or joined already,
and no pair within a group is written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.common import joined_on_hot, numbered, removed, text_bytes, tidy, written
from tidelake.llm.components import components

ROWS, BANDS = 10, 64
#: Buckets of so many members at most give their pairs.
SMALL = 6
#: Shingles that a part of a larger bucket has, about; a block has two parts at most.
PART = 1 << 20
#: Partners of a row that one task compares it with, about.
PARTNERS = 1000


def signatures(docs: DataFrame, words: int, row: str) -> DataFrame:
    """(doc_id, row, same: the set's digest of 128 bits, n: its size, keys) for every row; an empty set has no keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col(row).alias("row"), text_bytes().alias("text"))
    return kernels.apply(source, "SuperMinHash", f"doc_id {kind}, row long, same binary, n long, keys array<long>", words, ROWS, BANDS)


def _similar(pairs: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """The written ``pairs`` (u, v: nodes) whose texts (node, text) are as similar as ``share``, by their whole sets; a written table.

    u is the hub. Only the texts of these nodes move; a hub of many partners meets them in several tasks, PARTNERS to each.
    """
    many = pairs.groupBy("u").agg(F.count("*").alias("n"))
    turns = F.ceil(F.col("n") / PARTNERS).cast("int")
    dealt = joined_on_hot(pairs, many, ["u"], pairs.count()).select("u", "v", F.pmod(F.xxhash64("v"), turns).cast("int").alias("turn"))
    left = many.select(F.col("u").alias("node"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn")).join(texts, "node").select(F.col("node").alias("u"), "turn", F.col("text").alias("text_u"))
    # v has fewer partners than there are hubs in its buckets
    right = dealt.join(texts.toDF("v", "text_v"), "v")
    return written(kernels.apply(right.join(left, ["u", "turn"]).select("u", "v", "text_u", "text_v"), "SimilarPairs", "u long, v long", words, share))


def grouped(sets: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """(node, label) of components() for ``sets`` (node, n, keys) under all candidate pairs as similar as ``share``; texts: (node, text)."""
    sized = lambda a, b: F.least(a, b) >= share * F.greatest(a, b)  # noqa: E731  sizes alone rule out other pairs
    keyed = written(sets.select("node", F.col("n").alias("size"), F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(joined_on_hot(keyed, shared, ["key"], keyed.count()))
    removed(keyed)
    asked = written(members.groupBy("node").agg(F.sum("n").alias("degree")))
    texts = written(joined_texts(texts, asked))
    left = written(members.join(asked, "node").select("key", "node", "size", "degree"))
    removed(members)
    rows = left.count()
    # the first round: each bucket's hub is told to its members
    hub = left.groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("degree", -F.col("node"))).alias("hub"), F.count("*").alias("n"))
    met = joined_on_hot(left, hub, ["key"], rows).where((F.col("node") != F.col("hub.node")) & sized("size", "hub.size"))
    tested = written(met.select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct())
    edges = _similar(tested, texts, words, share)
    found = components(edges)
    # what a bucket still has to settle: its members by component
    labelled = left.join(found, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    labels = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("size").alias("size"), *[F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in (0, 1)])
    each = labels.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("labels"), F.sum("size").alias("all"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where("labels > 1")
    # buckets of the same members are one
    once = each.groupBy("n", "h0", "h1").agg(F.min("key").alias("key"), F.first("all").alias("all")).select("key", "n", "all")
    open_ = written(joined_on_hot(labelled, once, ["key"], rows))
    few = open_.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "size", "label"))).alias("m"))
    pairs = few.select(F.explode(F.expr("flatten(transform(m, (a, i) -> transform(slice(m, i + 2, size(m)), b -> struct(a, b))))")).alias("p")).where(F.col("p.a.label") != F.col("p.b.label"))
    pairs = pairs.where(sized("p.a.size", "p.b.size")).select(F.col("p.a.node").alias("u"), F.col("p.b.node").alias("v")).distinct()
    before = tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = written(pairs.join(before, ["u", "v"], "left_anti"))
    more = _similar(pairs, texts, words, share)
    blocks = written(kernels.apply(_blocks(open_.where(F.col("n") > SMALL), texts), "BlockLinks", "u long, v long", words, share))
    out = components(found.toDF("u", "v").union(more).union(blocks))
    tidy(left, texts, tested, edges, open_, pairs, more, blocks)
    return out


def _blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, i, j, part, node, label, text) of ``members`` (key, node, size, label, n, all): each two parts of a bucket in one block, sorted."""
    parts = F.ceil(F.col("all") / PART).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = met.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label").join(texts, "node")
    return own.select("key", "i", "j", "part", "node", "label", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def joined_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts (node, text) of the nodes asked for."""
    return texts.join(asked.select("node"), "node", "left_semi").select("node", "text")


def near_duplicates(docs: DataFrame, words: int = 5, share: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id is the smallest doc_id that chains of links reach, the row's own included; kept tells whether it is the row's own.
    Texts that are null or without words have no shingles and link with nothing, so each such row is its own component. Rows with a
    null doc_id get the smallest id of their component, null if no row in it has one, and aren't kept. Rows that repeat stay, each
    with the same answer; an empty table gives none; other columns are ignored.
    """
    rows = numbered(docs, "_row_")
    own = written(signatures(rows, words, "_row_"))
    sets = written(own.where("n > 0").groupBy("same").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    texts = rows.select(F.col("_row_").alias("node"), text_bytes().alias("text"))
    labels = grouped(sets.select("node", "n", "keys"), texts, words, share)
    each = sets.select("same", "node", "least", "rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = written(each.select("same", "label", "least", "rows"))
    whole = each.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = joined_on_hot(each, whole, ["label"], each.count()).select("same", "component_id", F.col("rows").alias("n"))
    told = own.select("doc_id", "same", F.col("n").alias("n_shingles"))
    linked = joined_on_hot(told.where("n_shingles > 0"), ids, ["same"], own.count()).select("doc_id", "n_shingles", "component_id")
    found = linked.union(told.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
