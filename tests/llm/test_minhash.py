import random
import re

import pytest

from tests.llm.conftest import lower
from tidelake.llm import minhash


def naive(text, words):
    tokens = re.findall("[^ \t-\r]+", lower(text or ""))
    return {" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def all_pairs(texts, words, share):
    """{place: (size, component, kept)} for a list of (doc_id, text), by all pairs."""
    sets, root = [naive(t, words) for _, t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= round(100 * share) * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(texts):
        ids = [k for j, (k, _) in enumerate(texts) if find(j) == find(i) and k is not None]
        own = min(ids, default=None) if sets[i] else key
        out.append((key, len(sets[i]), own, key is not None and key == own))
    return sorted(map(str, out))


def got(frame, **options):
    found = minhash.near_duplicates(frame, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in found.collect())


def copies(rng):
    """Texts of 200 words with copies that differ in 1 to 6 words, so that pairs lie on both sides of 0.85; copies of copies; exact copies."""
    out = []
    for _ in range(20):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        out.append(base)
        for changed in (1, 2, 3, 3, 4, 6, 7, 8):
            other = list(rng.choice(out[-3:])) if rng.random() < 0.4 else list(base)
            for at in rng.sample(range(200), changed):
                other[at] = f"n{rng.randrange(10**6)}"
            out.append(other)
        out.append(list(base))
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("small,part", [(6, 1 << 20), (1, 500)])
def test_all_pairs(spark, monkeypatch, small, part):
    # the second time all buckets left are blocks, of several parts
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PART", part)
    texts = copies(random.Random(11))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert got(frame, words=5, share=0.85) == all_pairs(texts, 5, 0.85)


def test_a_hub_of_many_partners_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 7)
    base = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join([*base[: i + 5], f"x{i}", *base[i + 6 :]])) for i in range(60)] + [(99, " ".join(base))]
    assert got(spark.createDataFrame(texts, "doc_id long, text string")) == all_pairs(texts, 5, 0.85)


def test_documents(documents):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == all_pairs(texts, 5, 0.85)


def test_messy_rows(messy, nothing):
    texts = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert got(messy) == all_pairs(texts, 5, 0.85)
    assert got(messy, words=3, share=0.9) == all_pairs(texts, 3, 0.9)
    assert got(nothing) == []


