import random
from collections import Counter
from hashlib import sha256

import pytest

from tidelake.llm import repeats


def naive(texts, width):
    starts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if starts[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def digest(r):
    return r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.sha


def test_documents(documents, texts):
    ids = sorted(texts)
    rows = {r.doc_id: digest(r) for r in repeats.remove_repeats(documents).collect()}
    assert [rows[i] for i in ids] == naive([texts[i].encode() for i in ids], 400)


@pytest.mark.parametrize("width", [60, 150])
def test_pieces_put_together_at_random(spark, width):
    rng = random.Random(width)
    pieces = [bytes(rng.choice(b"abcdef \n") for _ in range(rng.choice([50, 90, 160, 320]))) for _ in range(10)]
    texts = [b"".join(rng.choice(pieces)[rng.randrange(30) :] for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    texts += [b"a" * 400, b"a" * 100, b"ab" * 200, b"", b"q" * (width - 1), b"q" * (width - 1)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: digest(r) for r in repeats.remove_repeats(docs, width).collect()}
    assert [rows[i] for i in range(len(texts))] == naive(texts, width)


def test_longest_previous_factors():
    rng = random.Random(3)
    for size in (0, 1, 40, 70):
        s = bytes(rng.choice(b"ab") for _ in range(size))
        want = [max([k for k in range(size - i + 1) if any(s[j : j + k] == s[i : i + k] for j in range(i))] or [0]) for i in range(size)]
        assert repeats.longest_previous_factors(s) == want
        assert repeats.suffix_array(s).tolist() == sorted(range(size), key=lambda i: s[i:])


def test_messy_rows(messy, nothing):
    rows = repeats.remove_repeats(messy, 400).collect()
    assert len(rows) == messy.count()
    want = naive([(r.text or "").encode() for r in messy.collect()], 400)
    assert sorted(map(digest, rows)) == sorted(want)
    assert repeats.remove_repeats(nothing).count() == 0
