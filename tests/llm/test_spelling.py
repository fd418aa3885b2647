import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tests.llm.conftest import lower
from tidelake.llm import spelling


def counted(texts, every=31, least=7):
    out = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'null' if key is None else key}:{run}".encode())
            out[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    out, forms, near_of = [], {}, {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        near_of[w], forms[w] = len(near), best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, near_of[w], words.get(forms[w])))
    return sorted(map(str, out))


def got(frame, **options):
    found = spelling.variants(frame, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(str(tuple(r)) for r in found.collect())


def crowd(rng):
    """Texts whose words crowd in few blocks: edits of a few words, many times, at either end, with repeated letters."""
    words, letters = ["aaaaaaaa", "constantly", "àéîõüàéî", "aaaabbbbaaaa", "abcabcabc"], "abcéÿ"
    for w in list(words):
        for _ in range(50):
            x, at = rng.choice(words), rng.randrange(len(w) + 1)
            words.append(rng.choice([x[:at] + rng.choice(letters) + x[at:], x[:at] + x[at + 1 :], x[:at] + rng.choice(letters) + x[at + 1 :]]))
    return [(i, " ".join(rng.choice(words) for _ in range(30)).upper() if i % 7 == 0 else " - ".join(rng.choice(words[: 5 + i]) for _ in range(30))) for i in range(250)]


@pytest.mark.parametrize("most", [4, 512])
def test_crowded_blocks(spark, most):
    texts = crowd(random.Random(5))
    words = counted(texts)
    want = brute(words)
    assert sum("None, '" not in w for w in want) > 20
    assert got(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), most=most) == want


def test_chains(spark):
    # each ten times as frequent as the one before; ties of the same count go to the smaller word
    texts = [(1, "mistakee " * 2 + "mistakes " * 20 + "mistaken " * 20 + "Mistake " * 300 + "zzzzzzz zzzzzzz short short")]
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"), every=10**9).collect()}
    assert (rows["mistakee"].form, rows["mistakee"].root, rows["mistakee"].n_near) == ("mistake", "mistake", 3)
    assert rows["mistaken"].form == "mistake" and rows["mistake"].form is None and rows["mistake"].root == "mistake"
    assert rows["zzzzzzz"].n_near == 0 and "short" not in rows


def test_messy_rows(messy, nothing):
    texts = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()] * 2
    assert got(messy.union(messy)) == brute(counted(texts))
    assert got(nothing) == []
