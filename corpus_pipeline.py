"""The corpus pipeline: five stages that turn the documents into token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and gives it, read again, to the next stage. All but the last return the columns of the documents.

1. quality: documents that the co-trained classifier scores below one half go.
2. near_duplicates: of each component of links one document stays, that with the smallest id. Two documents link if
   their sets of five-word shingles have a Jaccard similarity of SHARE or more: SimHash's covering tables and, for pairs
   that lie farther apart than those reach, MinHash find the candidates; the shingles themselves confirm them (README.md).
3. decontamination: documents that hold ten consecutive words of a benchmark item go.
4. mixing: sources are mixed by weights 5, 2 and 1; a document comes as often as the mix takes it, or not at all.
5. token_files: the documents' ids, coded in files in ascending order of doc_id, and read again: one row a document.

In all stages null texts count as empty, rows with null ids and rows that repeat are documents like any other, an empty
table gives none, and columns beyond those of the documents stay, whatever their names.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import decontaminate, mixing, quality, similar, token_files
from tidelake.llm.common import shared_dir, table, written
from tidelake.llm.queries import tokenizer

SHARE = 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score one half or more; without labels of both kinds, all of them."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; null and empty texts are one component."""
    return similar.one_of_each(docs, words=5, share=SHARE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without ten consecutive words, or the whole of a shorter item, of the benchmark; null and empty texts stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; those without words are taken like the others of their hashes."""
    return mixing.mixed(docs, weights=[5, 2, 1], most=3)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the files themselves stay in the shared folder."""
    path = f"{shared_dir(spark)}/tables/{uuid4().hex}"
    token_files.write(docs, path, tokenizer("word_bpe_49k.json"), end=1)
    return token_files.read(spark, path)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", weighted), ("token_files", tokenized)]

#: A classifier's verdicts can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
