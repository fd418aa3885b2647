"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers hold the texts of at most this many bytes of documents at a time (one longer document alone).
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. On one machine, where it is unset, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if more than this part of all rows have it; there are at most as many such keys as its inverse.
HOT = 1 / 1000


def joined_on_hot(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """left joined with right, which has one row a key and in column n how many of left's ``total`` rows have it.

    Rows with hot keys meet their key's row where they are; as keys without nulls go, there are fewer than 1 / HOT of
    those, so they are sent to all tasks. All other keys meet by shuffle, with few rows each.
    """
    most = int(total * HOT) + 1
    hot = right.where(F.col("n") > most)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col("n") <= most), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def removed(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(*tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more, and lets Spark delete the shuffles that made them."""
    for df in tables:
        removed(df)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def chunks(batches, text: int = 1, limit: int = CHUNK_BYTES):
    """Slices record batches into pieces whose column number ``text`` (binary) has about ``limit`` bytes or one row."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        block = (np.cumsum(size, dtype=np.int64) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def free(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it needs to clash with none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(name: str = "text") -> Column:
    """A text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def _files(df: DataFrame) -> list[str] | None:
    """The Parquet files of a table that is merely read, projected and filtered; None for anything else."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, relations = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "LogicalRelation":
            relations.append(node.relation())
        elif node.nodeName() not in ("Project", "Filter"):
            return None
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if len(relations) != 1 or "_metadata" in df.columns or not plan.deterministic():
        return None
    if relations[0].getClass().getSimpleName() != "HadoopFsRelation" or relations[0].fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    files = list(relations[0].location().inputFiles())
    return files if len(files) == len(set(files)) else None


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a number for each row, the same one in every read, however files are split and whichever executors live.

    Rows of Parquet files that are merely read, projected and filtered have the file's number and their place in it;
    any others are written with their numbers first.
    """
    files = _files(df)
    if files is None:
        return written(df.withColumn(name, F.monotonically_increasing_id()))
    # Hadoop writes file:/ where the listing has file:///
    file, at, base = (free([*df.columns, name], n) for n in ("file", "at", "base"))
    known = df.sparkSession.createDataFrame([(re.sub("^([^:/]+):/+", r"\1:/", f), n << 40) for n, f in enumerate(sorted(files))], f"{file} string, {base} long")
    own = df.select("*", F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/").alias(file), F.col("_metadata.row_index").alias(at))
    start = F.coalesce(base, F.raise_error(F.concat(F.lit("a file that wasn't listed: "), file)).cast("long"))
    return own.join(F.broadcast(known), file, "left").withColumn(name, start + F.col(at)).drop(file, at, base)
