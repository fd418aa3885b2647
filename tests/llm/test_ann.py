import numpy as np
from pyspark.sql import functions as F

from tidelake.llm import ann


def naive(ids, x, queries, k):
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in queries:
        cos = (x @ x[i]) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -cos)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), cos[j]) for j in order]
    return out


def test_recall_scores_and_order(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = emb.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    want = naive(ids, x, np.flatnonzero(ids % 50 == 0), 5)
    got = {}
    for r in ann.search(emb, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    at = {v: i for i, v in enumerate(ids)}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for v, s in found:
            a, b = x[at[q]], x[at[v]]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_ties_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, [float("inf"), 1.0]), (10, [1.0]), (None, [1.0, 0.0]), (11, [])]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, code string, cell int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table, F.col("vec_id").isin(0, 6), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)]
    assert [r.vec_id for r in ann.search(table, F.col("vec_id") == 4, k=9).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert ann.search(table.limit(0), F.lit(True)).count() == 0


def test_many_copies_in_split_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.search(table, F.col("vec_id") == 300, k=5).orderBy("rank").collect()]
    assert got == [0, 3, 6, 9, 12]


def test_rows_that_repeat_are_candidates_of_their_own(spark):
    table = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.search(table, F.col("vec_id") % 50 == 0, k=5).orderBy("rank").collect()]
    assert got == [1, 2, 2]
    # a query that comes twice is one query
    twice = table.union(table.where("vec_id = 50"))
    assert [r.vec_id for r in ann.search(twice, F.col("vec_id") % 50 == 0, k=5).orderBy("rank").collect()] == [1, 2, 2]


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = ann.search(table, F.col("vec_id") % 3 == 0, k=4).collect()
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    assert sorted(map(tuple, ann.search(table, F.col("vec_id") % 3 == 0, k=4).collect())) == sorted(map(tuple, whole)) and len(whole) == 800


def test_many_near_copies_in_one_cell(spark):
    """More vectors that nearly agree than any shortlist by codes would keep, and vectors without any structure."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) + 1e-4 * rng.normal(size=(1500, 16)), rng.normal(size=(1500, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = naive(np.arange(len(x)), x, range(0, len(x), 50), 5)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)
