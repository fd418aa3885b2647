import random
import re
import time

import pytest

from tests.llm.conftest import lower
from tidelake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def naive(texts, items, window):
    wins = {}
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = WORD.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (own := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[own]
        out.append((len(w), len(hit), sorted(found)))
    return out


def naive_longest(text, items, least):
    """The number of words of the longest verbatim match that holds a window."""
    w, best = WORD.findall(lower(text or "")), 0
    for _, other in items:
        o = WORD.findall(lower(other or ""))
        last = [0] * (len(o) + 1)
        for i in range(len(w)):
            now = [0] * (len(o) + 1)
            for j in range(len(o)):
                if w[i] == o[j]:
                    now[j + 1] = last[j] + 1
                    if now[j + 1] >= min(least, len(o)):
                        best = max(best, now[j + 1])
            last = now
    return best


def digest(row):
    return row["__n_words"], sum(r.end - r.start for r in row["__runs"]), row["__items"]


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_hits_are_those_of_all_windows(spark, sf_dir, documents, texts, block):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(documents.select("doc_id", "text"), bench, 10, block).collect()
    rows = {r.doc_id: digest(r) for r in found}
    ids = sorted(texts)
    items = {str(r.item_id): r.text for r in bench.collect()}
    some = [r for r in found if r["__longest"]]
    assert {r.doc_id for r in some} == {r.doc_id for r in found if r["__runs"]}
    for r in some[:25]:
        m, w = r["__longest"], WORD.findall(lower(texts[r.doc_id]))
        assert m.words == naive_longest(texts[r.doc_id], items.items(), 10)
        assert w[m.doc_at : m.doc_at + m.words] == WORD.findall(lower(items[m["item"]]))[m.item_at : m.item_at + m.words]
    want = naive([texts[i] for i in ids], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert [rows[i] for i in ids] == want
    assert any(w[1] for w in want)


def test_short_items_overlaps_and_text_ends(spark):
    bench = spark.createDataFrame([(1, "b c"), (2, "c d e f"), (3, "z"), (4, None), (5, "..."), (2, "q r s t")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b, C d e f!"), (2, "a b"), (3, "c d"), (4, "z z q r s"), (5, None), (6, "")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: digest(r) for r in decontaminate.scan(docs, bench, 4).collect()}
    want = naive([r.text for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 4)
    assert [rows[i] for i in range(1, 7)] == want


def test_longest_matches_go_on_beyond_the_sorted_depth(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[5:40])), (2, " ".join(words[10:30])), (3, "w50 w51")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    rows = [(r.item_at, r.doc_id, r.doc_at, r.n_words) for r in decontaminate.longest_matches(docs, bench, 3).collect()]
    assert rows == [(5, 1, 0, 35)]


def test_messy_rows(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps"), (None, "comes twice")], "item_id long, text string")
    rows = decontaminate.scan(messy, bench, 10).collect()
    assert len(rows) == messy.count()
    assert {r.doc_id for r in rows if r["__runs"]} == {6, 7, 3}
    assert [r["__items"] for r in rows if r.doc_id == 3 and r["__runs"]] == [["null"]]
    kept = decontaminate.decontaminated(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    assert decontaminate.scan(nothing, bench).count() == 0
    assert decontaminate.decontaminated(messy, bench.limit(0)).count() == messy.count()
    assert decontaminate.longest_matches(messy, bench.limit(0)).count() == 0


def test_long_runs_of_hit_words():
    """A text that repeats items a hundred thousand words long, in bounded time, with the matches that trying all places gives."""
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(f"w{rng.randrange(6)}" for _ in range(n))) for k, n in enumerate((40, 12, 300, 5))] + [("same", "x " * 40)]
    block = decontaminate.Block([(k, t.encode()) for k, t in items], 10)

    def plain(text):
        w, best = text.split(), None
        for p in range(len(w)):
            for name, t in items:
                seq = t.split()
                for q in range(len(seq)):
                    n = 0
                    while p + n < len(w) and q + n < len(seq) and w[p + n] == seq[q + n]:
                        n += 1
                    if n and (best is None or n > best[0]):
                        best = (n, p, name, q)
        return best

    texts = [" ".join([items[0][1]] * 3), " ".join(t for _, t in items), "x " * 100, items[3][1] + " q " + items[2][1][60:] + " " + items[1][1], " ".join(f"w{rng.randrange(6)}" for _ in range(400)) + " " + items[1][1]]
    found = decontaminate._find([t.encode() for t in texts], [None] * len(texts), [None] * len(texts), [None] * len(texts), block)
    for text, match in zip(texts, found[3]):
        n, p, name, q = plain(text)
        assert (match["words"], match["doc_at"], match["item"], match["item_at"]) == (n, p, name, q)
    began = time.time()
    long = [" ".join([items[0][1]] * 5000), "x " * 100_000]
    found = decontaminate._find([t.encode() for t in long], [None] * 2, [None] * 2, [None] * 2, block)
    assert [m["words"] for m in found[3]] == [40, 40] and time.time() - began < 30
