"""Near-duplicates by the share of shingles: pairs of texts whose sets of shingles have a Jaccard similarity of ``share`` or more.

Candidates come from two sides. The covering tables of simhash.py give, with certainty, all pairs whose 64-bit
fingerprints differ in RADIUS bits or fewer. Texts that share four fifths of their shingles differ in ten bits on
average, farther than covering tables can reach; MinHash finds these: BANDS keys of ROWS least hashes each, of which a
pair at similarity s shares none with probability (1 - s^ROWS)^BANDS, 8e-6 at 0.8. Both kinds of keys are buckets of one
kind to minhash.grouped(), which confirms each candidate on its shingles and joins what is similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels, minhash, simhash
from tidelake.llm.common import free, numbered, removed, text_bytes, written

ROWS, BANDS, RADIUS = 8, 64, 4


def _sketches(docs: DataFrame, words: int, row: str) -> DataFrame:
    """(doc_id, row, same: the set's digest, n: its size, fp: its fingerprint, keys) for every row; an empty set has no keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col(row).alias("row"), text_bytes().alias("text"))
    return kernels.apply(source, "Sketches", f"doc_id {kind}, row long, same binary, n long, fp long, keys array<long>", words, ROWS, BANDS)


def _keys() -> Column:
    """The MinHash keys of a row and what each covering table keeps of its fingerprint, with the table's number."""
    tables = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(simhash.masks(RADIUS))]
    return F.concat("keys", F.array(*tables))


def one_of_each(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component of pairs as similar as ``share``: that with the smallest doc_id, null ids last, then the first such row.

    Null and empty texts are one component; an empty table gives no rows; other columns stay, whatever their names.
    """
    row, keep = (free(docs.columns, x) for x in ("row", "kept"))
    rows = numbered(docs, row)
    own = written(_sketches(rows, words, row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("first")
    sets = written(own.groupBy("same").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), first))
    removed(own)
    texts = rows.select(F.col(row).alias("node"), text_bytes().alias("text"))
    labels = minhash.grouped(sets.where("n > 0").select("node", "n", _keys().alias("keys")), texts, words, share)
    each = sets.select("node", "first").join(labels, "node", "left")
    kept = each.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(keep))
    return rows.join(kept, F.col(row) == F.col(keep), "left_semi").drop(row)
