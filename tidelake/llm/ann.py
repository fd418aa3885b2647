"""Approximate nearest neighbours by cosine: an inverted file, whose cells are searched exactly.

Vectors, scaled to length one, belong to the nearest of some coarse centroids. A query looks into the cells of its nearest
centroids and ranks all their vectors by the exact cosine of the original vectors: products of matrices, which cost less
than tables of coded parts and lose nothing where many vectors of a cell have the same code.

Centroids come from a bounded sample of rows; every row is indexed. A cell is split into blocks of bounded size, and a
query visits all blocks of a cell, so that no task gets a whole large cell; nor does one get all queries that visit it, for
they come in blocks, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import written

#: Rows that centroids are fitted on, at most.
SAMPLE = 20_000
#: Rows in a block of a cell, about; cells are made so that one has CELL_ROWS on average, up to CELLS of them.
BLOCK_ROWS, CELL_ROWS, CELLS = 8192, 1000, 4096
#: Queries that visit a block in one task, about.
QUERY_ROWS = 4096
#: Cosines of scaled vectors may differ so much from the exact ones, at most.
SLACK = 1e-9


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    dim: int
    centres: np.ndarray  # cells by dimensions
    probe: int  # cells that a query visits

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int = 42) -> Index:
        x = np.unique(sample, axis=0)  # many copies of a vector tell no more than one
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        x = x[np.random.default_rng(seed).permutation(len(x))]
        centres = _k_means(x, min(cells, len(x)), 12, seed)
        own = cls(sample.shape[1], centres, len(centres))
        own.probe = own.wanted(x)
        return own

    def wanted(self, x: np.ndarray, k: int = 5, share: float = 0.995, queries: int = 256) -> int:
        """How many cells a query must visit to meet this share of its k nearest neighbours, by the sample itself.

        In the sample neighbours are farther than among all rows, so that more cells are wanted rather than fewer.
        """
        cell, some = _nearest(x, self.centres), x[:queries]
        near = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        rank = np.argsort(self.probes(some, len(self.centres)), axis=1)
        at = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
        return int(at[min(len(at) - 1, int(share * len(at)))]) + 1 if len(at) else len(self.centres)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        return _nearest(x / np.sqrt((x * x).sum(axis=1))[:, None], self.centres)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector."""
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return np.argsort(0.5 * (self.centres * self.centres).sum(axis=1) - x @ self.centres.T, axis=1, kind="stable")[:, :n]


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """For each query the k best of these rows, the query's own left out: (query id, id, cosine) as three arrays.

    Equal vectors count as one until the end, where the least ids stand for them. Products of scaled vectors choose those
    that may be among the best; their cosines are then taken from the vectors as they are.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    _, first, kind = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[by_kind], np.arange(len(first) + 1))
    ux = x[first]
    norm = np.sqrt((ux * ux).sum(axis=1))
    unit = (ux / norm[:, None]).T
    out = ([], [], [])
    for a in range(0, len(q), 128):
        part = q[a : a + 128]
        size = np.sqrt((part * part).sum(axis=1))
        near = (part / size[:, None]) @ unit
        # the query's own vector may be one of them
        some = min(k + 1, len(ux))
        least = np.partition(near, len(ux) - some, axis=1)[:, len(ux) - some] - SLACK
        for i in range(len(part)):
            t = np.flatnonzero(near[i] >= least[i])
            exact = (ux[t] * part[i]).sum(axis=1) / (norm[t] * size[i])
            found = []
            for j in np.argsort(-exact, kind="stable"):
                if len(found) > k and exact[j] < found[k - 1][0]:
                    break
                members = ids[by_kind[begin[t[j]] : begin[t[j] + 1]]]
                found += [(exact[j], int(m)) for m in members[members != q_ids[a + i]][:k]]
            for s, m in sorted(found, key=lambda f: (-f[0], f[1]))[:k]:
                out[0].append(int(q_ids[a + i]))
                out[1].append(m)
                out[2].append(float(s))
    return out


def _vectors(column) -> np.ndarray:
    """Rows of doubles from an Arrow column of lists of one length."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id: long, v: array<double>): rows that can take part.

    Null ids, null, empty and zero vectors, and those with a null or non-finite component take no part, nor do vectors
    whose length isn't that of the most rows (of equally many, the larger one).
    """
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (most.n if most else 0))


def search(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``is_query`` (a Column on vec_id) holds for.

    Candidates are all rows that can take part (see usable) but those with the query's own id; ties go to smaller ids.
    A query visits ``probes`` cells, or as many as the index finds that it wants (see Index.wanted); small tables have
    one cell. Rows that repeat an id and a vector are candidates of their own, but one query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector)
    n = rows.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    drawn = rows.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(sample).toArrow()
    index = spark.sparkContext.broadcast(Index.fit(_vectors(drawn.column("v")), max(1, min(CELLS, n // CELL_ROWS))))

    def place(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cell = index.value.place(_vectors(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    def look(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cells = index.value.probes(_vectors(b.column(1)), probes or index.value.probe).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(cells), pa.list_(pa.int32()))], ["query_id", "q", "cells"])

    placed = written(rows.mapInArrow(place, "vec_id long, v array<double>, cell int"))
    asked = written(rows.where(is_query).distinct().mapInArrow(look, "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell")))
    # one row for each cell, of which there is a fixed number at most
    parts = lambda n: F.greatest(F.ceil(F.count("*") / n), F.lit(1)).cast("int")
    shape = placed.groupBy("cell").agg(parts(BLOCK_ROWS).alias("blocks")).join(asked.groupBy("cell").agg(parts(QUERY_ROWS).alias("turns")), "cell")
    shape = F.broadcast(written(shape))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c, "cell"), F.col(n)).cast("int")
    held = placed.join(shape, "cell").withColumns({"block": dealt("vec_id", "blocks"), "turn": each("turns")})
    asked = asked.join(shape, "cell").withColumns({"turn": dealt("query_id", "turns"), "block": each("blocks")})

    def visit(queries, members):
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not members.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        found = best(_vectors(queries.column("q")), np.asarray(queries.column("query_id")), _vectors(members.column("v")), np.asarray(members.column("vec_id")), k)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=names)

    key = ("cell", "block", "turn")
    near = asked.select(*key, "query_id", "q").groupBy(*key).cogroup(held.select(*key, "vec_id", "v").groupBy(*key)).applyInArrow(visit, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
