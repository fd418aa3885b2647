import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import lower
from tidelake.llm import kernels, lm
from tidelake.llm.queries import tokenizer

MODEL = "piece_bpe_32k.model"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check(rows, docs):
    counts = Counter(t for i, x in docs if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x in docs:
        own = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want.append((str(i), held(i), len(own), sum(counts[t] > 0 for t in own), n, pytest.approx(base, rel=1e-9)))
    key = lambda r: (r[0], r[2], r[3])
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    assert got == sorted(want, key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_documents(documents, texts, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 50)  # so that most words take the join
    check(lm.score(documents, tokenizer(MODEL)).collect(), list(texts.items()))


def test_messy_rows(messy, nothing):
    check(lm.score(messy, tokenizer(MODEL)).collect(), [(r.doc_id, r.text) for r in messy.collect()])
    assert lm.score(nothing, tokenizer(MODEL)).count() == 0


def test_lattice_sums_all_segmentations(spark):
    def naive(text, weights, start=True):
        if not text:
            return 1.0
        return sum(weights[text[:k]] * naive(text[k:], weights, False) for k in range(1, len(text) + 1) if text[:k] in weights and (start or "▁" not in text[:k]))

    weights = {"▁": 0.3, "▁a": 0.4, "▁ab": 0.3, "a": 0.2, "b": 0.3, "ab": 0.1, "ba": 0.1, "aab": 0.05} | {f"<0x{b:02X}>": 0.0001 for b in range(256)}
    pieces = lm.Pieces(list(weights), [math.log(w) for w in weights.values()], math.log(0.2))
    words = ["a", "ab", "abab", "aabbab", "é", "ab" * 4000, "a▁b", "b🙂"]
    df = spark.createDataFrame([(w.encode(),) for w in words], "word binary").coalesce(1)
    got = {bytes(r.word).decode(): r.lp for r in df.select("word", pieces.of_words(spark)("word").alias("lp")).collect()}
    for word in words[:4]:
        assert got[word] == pytest.approx(math.log(naive("▁" + word, weights) * 0.2))
        sums = kernels.apply(df.where(F.col("word") == F.lit(word.encode())), "ExpectedPieces", "piece int, n double", *pieces.sent()).collect()
        assert sum(r.n * len(pieces.names[r.piece]) for r in sums) == pytest.approx(len(word) + 1)  # pieces cover each character once
    assert got["é"] == pytest.approx(math.log(0.3 * 0.0001**2 * 0.2)) and math.isfinite(got["ab" * 4000])
    assert got["a▁b"] == pytest.approx(math.log((0.3 * 0.2 + 0.4) * 0.0001**3 * 0.3 * 0.2))
    assert got["b🙂"] == pytest.approx(math.log(0.3 * 0.3 * 0.0001**4 * 0.2))


def test_scores_are_those_of_a_plain_model(spark, documents, texts, monkeypatch):
    """All parts put together by other means: counts, weights, both kinds of arcs, sums over words."""
    monkeypatch.setattr(lm, "HOT", 100)
    some = documents.where("doc_id < 60")
    counts = Counter(t for i, x in texts.items() if i < 60 and not held(i) for t in tokens(x))
    ends = counts.pop(None)
    rows = [(w.encode(), c) for w, c in counts.items()] + [(w.encode(), 0) for w in {t for i, x in texts.items() if i < 60 and held(i) for t in tokens(x)[:-1]} - set(counts)]
    table = spark.createDataFrame(rows, "word binary, c long")
    pieces = lm.learn_pieces(table, tokenizer(MODEL))
    apart = {bytes(r.word).decode(): r.lp for r in table.select("word", pieces.of_words(spark)("word").alias("lp")).collect()}
    n, n1, n2 = sum(counts.values()) + ends, sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    lp = lambda w: math.log10(ends / n) if w is None else math.log10(max(0, counts[w] - d) / n * (counts[w] > 0) + d * len(counts) / n * math.exp(apart[w]))
    for r in lm.score(some, tokenizer(MODEL)).collect():
        assert r.score == pytest.approx(sum(map(lp, tokens(texts[r.doc_id]))), rel=1e-9)


def test_the_model_gains_on_held_out_documents(spark):
    """Against counts whose unknown words are spelled by bytes of equal weight, which makes the base a proper model, too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    known = {t for i, x in texts.items() if not held(i) for t in tokens(x)}
    score = base = n = 0
    for r in lm.score(docs, tokenizer(MODEL)).where("held_out").collect():
        spelled = sum((len(t.encode()) + 1) * math.log10(1 / 257) for t in tokens(texts[r.doc_id]) if t not in known)
        score, base, n = score + r.score, base + r.base_score + spelled, n + r.n_tokens
    assert score / n > base / n + 0.05
    print(f"held-out documents, log10 a token: model {score / n:.3f}, proper base {base / n:.3f}")
