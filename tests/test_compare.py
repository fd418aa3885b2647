import random
from datetime import date, timedelta

import pytest

from tidelake.operators import compare, pages


def rows(rng, n):
    return {(f"p{i % 5}", i // 3 if i % 50 else None): [(float(rng.randrange(5)) if rng.random() < 0.8 else None, rng.choice(["x", "", None]), date(2020, 1, 1) + timedelta(rng.randrange(3)))] for i in range(n)}


def table(spark, cells):
    out = [(p, k, *row) for (p, k), each in cells.items() for row in each]
    random.Random(1).shuffle(out)
    return spark.createDataFrame(out, "part string, k long, a double, b string, c date").repartition(3)


def plain(left, right):
    """Keys that aren't repeated on either side."""
    out = []
    for at in left.keys() | right.keys():
        x, y = left.get(at, []), right.get(at, [])
        if x and not y:
            out += [(*at, "missing", None, None, None)] * len(x)
        elif y and not x:
            out += [(*at, "extra", None, None, None)] * len(y)
        else:
            out += [(*at, "differs", n, None if u is None else str(u), None if v is None else str(v)) for n, u, v in zip("abc", x[0], y[0]) if u != v]
    return sorted(map(str, out))


@pytest.mark.parametrize("partitions", [["part"], []])
def test_differences(spark, partitions):
    rng = random.Random(3)
    left = rows(rng, 600)
    right = {k: list(v) for k, v in left.items()}
    keys = [k for k in left if k[0] in ("p1", "p2") and k[1] is not None]
    for k in rng.sample(keys, 12):
        a, b, c = right[k][0]
        right[k] = [rng.choice([(None, b, c), (7.5, b, c), (a, "other", c), (a, None if b is not None else "", c), (1.25, "z", date(2030, 1, 1))])]
    for k in rng.sample(keys, 6):
        del right[k]
    right[("p2", 10_000)] = [(1.0, "n", None)]
    right[("p9", 1)] = [(None, None, None)]
    by = ["k"] if partitions else ["part", "k"]
    found = compare.differences(table(spark, left), table(spark, right), by, partitions, wide=4)
    assert found.columns == ["part", "k", "status", "field", "left", "right"]
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(left, right)
    told = {r.part: (r.left_rows, r.right_rows, r.status) for r in compare.compared_partitions(table(spark, left), table(spark, right), ["part"]).collect()}
    assert {p: s for p, (_, _, s) in told.items()} == {"p0": "same", "p1": "differs", "p2": "differs", "p3": "same", "p4": "same", "p9": "extra"}
    assert told["p0"][0] == told["p0"][1] == sum(k[0] == "p0" for k in left)


def test_equal_partitions_are_not_read_again(spark, tmp_path):
    left = rows(random.Random(4), 300)
    right = {k: [(9.0, "q", None)] if k == ("p3", 1) else v for k, v in left.items()}
    sides = []
    for name, cells in (("l", left), ("r", right)):
        table(spark, cells).write.partitionBy("part").parquet(str(tmp_path / name))
        sides.append(spark.read.parquet(str(tmp_path / name)).select("part", "k", "a", "b", "c"))
    found = compare.differences(*sides, ["k"], ["part"])
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [(part") >= 2 and "p3" in plan
    assert compare.differences(sides[0], sides[0], ["k"], ["part"]).count() == 0


def test_repeated_keys_and_empty_tables(spark):
    left = {("p", 1): [(1.0, "a", None), (1.0, "a", None), (2.0, "b", None)], ("p", 2): [(3.0, None, None)]}
    right = {("p", 1): [(2.0, "b", None), (1.0, "a", None)], ("p", 2): [(3.0, None, None)]}
    found = compare.differences(table(spark, left), table(spark, right), ["k"], ["part"]).collect()
    assert {r.status for r in found} <= {"missing", "differs"} and sum(r.status == "missing" for r in found) == 1
    nothing = table(spark, left).limit(0)
    assert sorted(r.status for r in compare.differences(nothing, table(spark, right), ["k"], ["part"]).collect()) == ["extra"] * 3
    assert compare.differences(nothing, nothing, ["k"], ["part"]).count() == 0


@pytest.mark.parametrize("offset,limit", [(0, 10), (5, 20), (950, 100), (2499, 10), (2500, 5), (1234, 700), (1700, 1)])
def test_pages(spark, offset, limit):
    rng = random.Random(5)
    # a hot value of the first column, nulls in both
    cells = [(None if i % 90 == 0 else "hot" if i % 3 else f"c{rng.randrange(40)}", None if i % 400 == 7 else i) for i in range(2500)]
    rng.shuffle(cells)
    frame = spark.createDataFrame(cells, "a string, b long").repartition(4)
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted(cells, key=key)[offset : offset + limit]
    assert [tuple(r) for r in pages.page(frame, ["a", "b"], offset, limit, few=50, ranges=8).collect()] == want


def test_pages_of_equal_rows_and_tokens(spark):
    same = spark.range(500).selectExpr("1 AS a")
    assert pages.page(same, ["a"], 400, 50, few=10).count() == 50 and pages.page(same, ["a"], 499, 50, few=10).count() == 1
    frame = spark.createDataFrame([(None if i < 3 else f"c{i % 4}", date(2020, 1, 1) + timedelta(i)) for i in range(30)], "a string, d date")
    want, got, at = frame.orderBy("a", "d").collect(), [], ""
    while part := pages.after(frame, ["a", "d"], at, 7).collect():
        got += part
        at = pages.token(part[-1], ["a", "d"])
    assert got == want
    with pytest.raises(ValueError):
        pages.after(frame, ["a"], at, 7)
