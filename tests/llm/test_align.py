import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest

from tidelake.llm import align
from tidelake.llm.queries import tokenizer

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer(LEFT))
    a.encode_special_tokens = True
    # printable bytes stand for themselves, the others follow from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer(RIGHT)), letters


def aligned(text, tools):
    """The groups of a text as lists of (id, start, end), or none."""
    a, b, letters = tools
    if not text:
        return []
    whole = (" " + text).encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return []

    def placed(tokens):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    left, right = placed(left), placed(right)
    both, groups = {e for _, _, e in left} & {e for _, _, e in right}, defaultdict(lambda: ([], []))
    ends = sorted(both)
    for side, tokens in enumerate((left, right)):
        for t in tokens:
            groups[bisect_left(ends, t[2])][side].append(t)
    return [groups[i] for i in range(len(ends))]


def brute(texts, tools):
    groups = [aligned(t, tools) for _, t in texts]
    links = [[(x[0], y[0]) for a, b in g for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for g in groups]
    counts = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (key, _), g, own in zip(texts, groups, links):
        told = ";".join(",".join(str(x[0]) for x in a) + "|" + ",".join(str(y[0]) for y in b) for a, b in g)
        out.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return sorted(map(str, out))


def got(frame, **options):
    found = align.alignment(frame, tokenizer(LEFT), tokenizer(RIGHT), **options)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(str(tuple(r)) for r in found.collect())


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "  two  spaces   three\n\n\ttabs\r\n", " ", "\n", "\x00\x01", "日本語のテキストと漢字", "😀😀 emoji 👩‍👩‍👧 zwj", "don't we'll I'm", "x" * 700 + " " + "é" * 400,
    "aaaaaaaaaaaaaaaa aaaa aaa", "1234567890 12 3.14159", "ﬁ ligature ½ ① ｆｕｌｌ", "� ﻿ bom", "tail ", "Ünïcödé à la carte ÀÉÎ", "العربية עברית हिन्दी ไทย", "a" * 300 + "bc" * 300, "    " * 40, "ﷺ" * 50,
]


@pytest.mark.parametrize("sent", [0, 40])
def test_odd_texts(spark, tools, sent):
    texts = list(enumerate(ODD + ODD[:5]))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert got(frame, sent=sent) == brute(texts, tools)


def test_documents(documents, tools):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(documents, sent=300) == brute(texts, tools)


def test_messy_rows(messy, nothing, tools):
    texts = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert got(messy) == brute(texts, tools)
    assert got(nothing) == []


def test_no_utf8(spark):
    frame = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert got(frame) == [str((1, 0, 0, 0, 0, 0, 0, ""))]


def test_other_files(spark, documents):
    with pytest.raises(ValueError):
        align.alignment(documents, tokenizer("word_bpe_49k.json"), tokenizer(RIGHT))
