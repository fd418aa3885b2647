import random
import re

import pytest
from xxhash import xxh64_intdigest

from tests.llm.conftest import lower
from tidelake.llm import components, simhash


def naive(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    """{key: least key that is reachable} by comparing all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_and_components_are_those_of_all_pairs(documents, texts):
    want = {i: naive(t, 4) for i, t in texts.items()}
    rows = simhash.near_duplicates(documents, words=4, radius=4).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in rows} == want
    assert {r.doc_id: r.component_id for r in rows} == classes(want, 4)


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng, kept = random.Random(radius), [m & (2**64 - 1) for m in simhash.masks(radius)]
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & bits == 0 for m in kept)
    assert min(m.bit_count() for m in kept) >= 20


@pytest.mark.parametrize("radius", [3, 4])
def test_large_buckets_are_linked_through_centres(spark, radius):
    rng = random.Random(radius)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    signed = {x - (x >> 63 << 64): x for x in prints}
    found = components.components(simhash.links(spark.createDataFrame([(k,) for k in signed], "fp long"), radius, bucket_most=2))
    labels = {r.node: r.label for r in found.collect()}
    assert {k: labels.get(k, k) for k in signed} == classes(signed, radius)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)] + [(7, 7)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 40)}


def test_messy_rows(messy, nothing):
    rows = simhash.near_duplicates(messy, words=4).collect()
    assert len(rows) == messy.count()
    empty = [r for r in rows if r.fp == 0]
    assert {r.doc_id for r in empty} == {0, 1, 2, None} and {r.component_id for r in empty} == {0}
    assert {r.component_id for r in rows if r.doc_id in (9, 10)} == {9}
    kept = simhash.one_of_each(messy, words=4)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and 10 not in ids and 1 not in ids and ids.count(None) == 1 and ids.count(3) == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
