import re
from collections import Counter, defaultdict

import pytest

from tidelake.llm import mixing


def naive_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= over
    return target


def check(rows, texts_by_source):
    sizes = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ts) for s, ts in texts_by_source.items()}
    want = naive_targets(sizes, [5, 2, 1], 3)
    taken, largest = Counter(), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1


def test_documents(documents):
    by_source = defaultdict(list)
    for r in documents.collect():
        by_source[r.source].append(r.text)
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    check(rows, by_source)
    again = mixing.mix(documents.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    out = mixing.mixed(documents)
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_messy_rows(messy, nothing):
    by_source = defaultdict(list)
    for r in messy.collect():
        by_source[r.source].append(r.text)
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count()
    sizes = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ts) for s, ts in by_source.items()}
    want = naive_targets(sizes, [5, 2, 1], 3)
    assert all(r.target == pytest.approx(want[r.source]) for r in rows)
    assert mixing.mixed(messy).columns == messy.columns
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


@pytest.mark.parametrize("hot", [3, 11])
def test_an_id_that_two_thirds_of_a_source_have(spark, hot):
    """The rows of one id are told apart, so the source's words come as near to the target as one document allows."""
    rows = [(hot if i % 3 else 1000 + i, "w " * (10 + i % 7 if i % 2 else 12), "a") for i in range(150)] + [(2000 + i, "v " * 20, f"s{i % 3}") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_source = defaultdict(list)
    for _, t, s in rows:
        by_source[s].append(t)
    got = mixing.mix(frame.repartition(3)).collect()
    assert len(got) == len(rows)
    check(got, by_source)
    told = lambda found: sorted((r.doc_id, r.size, r.taken) for r in found)
    assert told(got) == told(mixing.mix(frame.repartition(5)).collect())
    assert Counter(r.doc_id for r in mixing.mixed(frame).collect()) == sum((Counter({r.doc_id: r.copies}) for r in got), Counter())


def test_plan_is_native(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
