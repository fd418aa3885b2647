import random

import corpus_pipeline
from tests.llm.conftest import lower
from tidelake.llm import similar


def naive(text, words):
    tokens = lower(text or "").split()
    return {" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def kept_by_all_pairs(texts, words, share):
    sets, root = {i: naive(t, words) for i, t in texts.items()}, {i: i for i in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(k for k in keys if root[k] == k)


def copies(rng):
    """Texts of 300 words with copies in which some words are others, so that pairs lie on both sides of 0.8."""
    out = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        out.append(base)
        for changed in (2, 4, 5, 6, 7, 8, 10):
            other = list(base)
            for at in rng.sample(range(300), changed):
                other[at] = f"n{rng.randrange(10**6)}"
            out.append(other)
    rng.shuffle(out)
    return {i: " ".join(t) for i, t in enumerate(out)}


def test_the_stage_keeps_what_all_pairs_keep(spark):
    texts = copies(random.Random(3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect())
    assert got == kept_by_all_pairs(texts, 5, 0.8)


def test_documents(documents, texts):
    assert sorted(r.doc_id for r in similar.one_of_each(documents).collect()) == kept_by_all_pairs(texts, 5, 0.8)


def test_messy_rows(messy, nothing):
    kept = similar.one_of_each(messy, words=4)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and 10 not in ids and 0 in ids and 1 not in ids and 2 not in ids and ids.count(None) == 1 and ids.count(3) == 2
    assert similar.one_of_each(nothing).count() == 0
