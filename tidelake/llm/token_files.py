"""Token files: the ids of all documents in ascending order of doc_id, coded in blocks (see java/Coder.java).

A table of files in Parquet, which any file system of Spark's can hold. A row is a block: the shard it belongs to (the
shards follow one another), its number in it, its code, and what it holds: pieces of documents, each with the
document's id, its number in the shard, the ids of the shard before it, the piece's number and its ids. A document is
one piece unless it has more ids than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm import kernels, tokens
from tidelake.llm.common import text_bytes

#: Ids in a block, at most.
BLOCK = 1 << 16


def write(docs: DataFrame, path: str, tokenizer: str, end: int, shards: int | None = None) -> None:
    """Writes the ids of whole texts, each document's followed by ``end``; null and empty texts have the end alone.

    Rows with equal ids follow one another by a hash of their texts, null ids come first, repeated rows are all
    written, and an empty table makes an empty table of files. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    placed = docs.select("doc_id", text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = placed.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = f"shard int, block int, code binary, pieces array<struct<doc_id: {kind}, doc: long, at: long, piece: int, n: long>>"
    kernels.apply(tokens.encoded(placed.drop("tie"), tokenizer), "WriteBlocks", schema, end, BLOCK).write.parquet(path)


def _pieces(files: DataFrame) -> DataFrame:
    """(shard, doc, doc_id, at, piece, n, crc) for each piece, from its decoded ids."""
    kind = files.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()
    return kernels.apply(files.select("shard", "code", "pieces"), "ReadBlocks", f"shard int, doc long, doc_id {kind}, at long, piece int, n long, crc long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document of the files, from the decoded ids.

    start counts the ids of all documents before it and ids_crc32 is the unsigned checksum of the document's ids, end
    included, as little-endian unsigned 32-bit integers. A damaged block is an error.
    """
    files = spark.read.parquet(path)
    pieces = _pieces(files)
    # few documents have more than one piece; only theirs meet
    alone = F.col("n_pieces") == 1
    docs = pieces.groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("at").alias("at"), F.sum("n").alias("n_tokens"), F.count("*").alias("n_pieces"), F.first("crc").alias("crc"),
        F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("p"),
    ).withColumn("p", F.when(~alone, F.col("p")))
    total = files.select("shard", F.explode("pieces.n").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = total.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = files.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def each(batches):
        import pyarrow as pa

        for b in batches:
            crc = b.column(3).to_pylist()
            for i, p in enumerate(b.column(4).to_pylist()):
                for k, x in enumerate(p or []):
                    crc[i] = joined(crc[i], x["crc"], 4 * x["n"]) if k else x["crc"]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = docs.join(before, "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "crc", "p")
    return placed.mapInArrow(each, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def joined(a: int, b: int, size: int) -> int:
    """The CRC-32 of two byte strings one after another, from the CRC-32 of each and the second's length.

    Appending zero bytes to a message is a linear map of its checksum over bits; its powers come from squaring.
    """
    # one zero bit: shift right, and the reflected polynomial if a bit falls out
    step = [0xEDB88320, *(1 << k for k in range(31))]

    def apply(m, v):
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= m[k]
        return out

    bits = 8 * size
    while bits:
        if bits & 1:
            a = apply(step, a)
        step = [apply(step, c) for c in step]
        bits >>= 1
    return a ^ b
