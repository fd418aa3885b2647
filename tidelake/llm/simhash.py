"""SimHash near-duplicates with covering locality-sensitive hashing.

A document's fingerprint has 64 bits. Two fingerprints link if they differ in ``radius`` bits or fewer. The tables are
those of a covering code: bit i gets a non-zero vector m(i) of radius+1 bits, and table v (one for each non-zero vector)
keeps bit i if m(i) and v have an odd inner product. For any set of at most ``radius`` bits some v is orthogonal to all
their vectors, so that table keeps none of these bits and the pair collides there with certainty: no link is lost.
"""

from __future__ import annotations

from itertools import combinations
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import chunks, free, numbered, text_bytes, written
from tidelake.llm.components import components

BITS = 64
#: Buckets with more distinct fingerprints than this are linked through common centres, not within one task.
BUCKET_MOST = 4096


def fingerprint(text: bytes, words: int) -> int:
    """The signed 64-bit fingerprint of a text: a bit is set if more than half of the shingles' hashes have it."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxh64_intdigest(line, 42)]
    else:
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(tokens) - words + 1].tolist()
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(start, end[words - 1 :].tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, row=None) -> DataFrame:
    """(doc_id, row, fp: long) for every row of ``docs``; null and empty texts get fingerprint zero.

    row is the column given, null without one.
    """

    def each(batches):
        import pyarrow as pa

        for part in chunks(batches, 2):
            fps = [fingerprint(b, words) for b in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], ["doc_id", "row", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (F.lit(None) if row is None else F.col(row)).cast("long").alias("row"), text_bytes().alias("text")).mapInArrow(each, f"doc_id {kind}, row long, fp long")


def masks(radius: int) -> list[int]:
    """The bits that each table keeps, as signed longs.

    All vectors come in turn where there are no more of them than bits. Else they are drawn, and of some draws the one is
    taken whose poorest table keeps most bits; tables that keep few bits would have large buckets.
    """
    every = range(1, 2 ** (radius + 1))

    def tables(vectors):
        return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in every]

    if len(every) <= BITS:
        kept = tables([i % len(every) + 1 for i in range(BITS)])
    else:
        draws = (tables(Random(seed).sample(every, BITS)) for seed in range(64))
        kept = max(draws, key=lambda t: min(m.bit_count() for m in t))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in kept]


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _forests(members: DataFrame, radius: int) -> DataFrame:
    """Links that join what is linked within each bucket (fps: at most BUCKET_MOST longs), one fewer than its members at most."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            us, vs = [], []
            for fps in batch.column(0):
                rest = np.unique(np.asarray(fps.values, np.int64).view(np.uint64))
                while len(rest) > 1:
                    todo, rest = [rest[0]], rest[1:]
                    while todo and len(rest):
                        u = todo.pop()
                        near = np.bitwise_count(rest ^ u) <= radius
                        found, rest = rest[near], rest[~near]
                        us.append(np.full(len(found), u))
                        vs.append(found)
                        todo.extend(found)
            cat = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([cat(us), cat(vs)], ["u", "v"])

    return members.mapInArrow(each, "u long, v long")


def _stars(fps: DataFrame, radius: int) -> DataFrame:
    """Links of all pairs within the radius, through the points at half of it: as many rows as there are such points.

    Two fingerprints are within the radius if, and only if, some point lies within its upper half of the one and its
    lower half of the other. So each point links what lies in its upper half to one that lies in its lower half.
    """
    near, far = radius // 2, radius - radius // 2
    flips = [(sum(1 << i for i in bits), n <= near) for n in range(far + 1) for bits in combinations(range(BITS), n)]
    flips = [(m - (1 << BITS) if m >> (BITS - 1) else m, core) for m, core in flips]
    table = fps.sparkSession.createDataFrame(flips, "flip long, core boolean")
    # a fixed number of rows, 2081 for a radius of 4
    points = fps.join(F.broadcast(table)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "core")
    hubs = points.groupBy("point").agg(F.min(F.when(F.col("core"), F.col("fp"))).alias("hub"), F.count("*").alias("n"))
    return points.join(hubs.where("n > 1 and hub is not null"), "point").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, radius: int, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp: long) whose components are those of all pairs within the radius.

    Buckets of two are compared by expressions; those of up to ``bucket_most`` are joined within a task, of bounded
    size; the fingerprints of any larger bucket are linked through common points instead (see _stars).
    """
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key"))
    size = keys.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    size = written(size)
    pairs = size.where("n = 2").where(_differing("u", "v") <= radius).select("u", "v")
    some = size.where((F.col("n") > 2) & (F.col("n") <= bucket_most)).select("t", "key")
    lists = keys.join(some, ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    many = keys.join(size.where(F.col("n") > bucket_most).select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    return pairs.union(_forests(lists, radius)).union(_stars(many, radius)).distinct()


def _labelled(own: DataFrame, radius: int) -> DataFrame:
    """(fp, label) for the distinct fingerprints of ``own``: those of one component have one label."""
    fps = own.select("fp").distinct()
    found = components(links(fps, radius)).withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that chains of links reach, the row's own included. Null and empty texts have
    fingerprint zero and link like any other; rows with a null doc_id get the component of their fingerprint, null if
    no row in it has an id. Rows that repeat stay; an empty table gives none; other columns are ignored.
    """
    own = written(fingerprints(docs, words))
    labels = _labelled(own, radius)
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(labels, "fp")
    whole = least.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labels.join(whole, "label").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id, null ids last, then the first such row.

    Null and empty texts are one component; an empty table gives no rows; other columns stay, whatever their names.
    """
    row, keep = (free(docs.columns, x) for x in ("row", "kept"))
    rows = numbered(docs, row)
    own = written(fingerprints(rows, words, row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    each = own.groupBy("fp").agg(first.alias("first")).join(_labelled(own, radius), "fp")
    kept = each.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(keep))
    return rows.join(kept, F.col(row) == F.col(keep), "left_semi").drop(row)
