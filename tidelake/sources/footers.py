"""Footers of Parquet files as a table: executors read the footers alone and give the statistics of each row group's columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.predicates import Predicate
from tidelake.registry import TYPES, Dataset

#: Files whose footers one task reads, about.
FILES_A_TASK = 64

_STATS = "row_group int, rows long, field string, low string, high string, nulls long, bytes long"


def located(path: str):
    """(file system, path in it) for pyarrow, of a path as Spark writes it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def footers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(all columns of ``files``, row_group, rows, field, low, high, nulls, bytes) for each column of each row group.

    ``files`` has a column ``file`` with paths of Parquet files, of any file system that pyarrow opens. low and high are text
    that casts back to the field's type: null without statistics, or where all values are null. bytes are as compressed. A file
    without row groups gives no rows.
    """
    own = files.columns

    def each(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        def text(x):
            return None if x is None else x.isoformat(sep=" ") if hasattr(x, "hour") else x.isoformat() if hasattr(x, "isoformat") else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)

        for batch in batches:
            for row in batch.to_pylist():
                system, path = located(row["file"])
                with system.open_input_file(path) as f:
                    told = pq.ParquetFile(f).metadata
                out = []
                for g in range(told.num_row_groups):
                    group = told.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        s = column.statistics
                        known = s is not None and s.has_min_max
                        nulls = s.null_count if s is not None and s.has_null_count else None
                        out.append((*row.values(), g, group.num_rows, column.path_in_schema, text(s.min) if known else None, text(s.max) if known else None, nulls, column.total_compressed_size))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [*batch.schema.types, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])], [*batch.schema.names, "row_group", "rows", "field", "low", "high", "nulls", "bytes"])

    schema = T.StructType([*files.schema.fields, *T._parse_datatype_string(_STATS).fields])
    tasks = max(1, files.count() // FILES_A_TASK)
    return files.repartition(tasks, "file").select(*own).mapInArrow(each, schema)


def may_match(dataset: Dataset, predicates: list[Predicate]) -> Column:
    """Whether a row of the group can meet the predicates on the row's field, by its statistics; true for other fields."""
    tests = [F.lit(True)]
    for p in predicates:
        kind = TYPES[dataset.type_of(p.field)]
        low, high = F.col("low").cast(kind), F.col("high").cast(kind)
        values = p.literals(dataset)
        if not values:
            found = F.lit(False)
        elif p.op in ("=", "in"):
            found = reduce(lambda a, b: a | b, [(low <= v) & (high >= v) for v in values])
        else:
            found = {">=": high >= values[0], ">": high > values[0], "<=": low <= values[0], "<": low < values[0]}[p.op]
        # all null: nothing compares true with null
        found = F.coalesce(found, F.coalesce(F.col("nulls") < F.col("rows"), F.lit(True)))
        tests.append((F.col("field") != p.field) | found)
    return reduce(lambda a, b: a & b, tests)
