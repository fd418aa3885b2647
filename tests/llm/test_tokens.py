import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from tidelake.llm import kernels, token_files, tokens
from tidelake.llm.queries import tokenizer

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  a  b \n\n c <|endoftext|> x<|endoftext|>y  ", "a\u3000 b\x1c c \xa0 d", "I'm  don't \t\t 'll 123 4567!!  ...", "<|endoftext|>", "x" * 40000, "ab " * 20000, "日本語 テスト" * 9000, "hello, world's  best. " * 3000, "ΟΔΟΣ ΣΑΣ é e\u0301 ﬁ"]


def kernel_ids(spark, path, some, **options):
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(some)], "doc_id long, text binary").coalesce(1)
    return {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.encoded(docs, path).collect()}


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(spark, name, texts):
    library = Tokenizer.from_file(tokenizer(name))
    rng = random.Random(4)
    # characters of all kinds, side by side at random
    odd = "'sStTrevmlld  \t\n\x0b\x1c\x85\xa0\u1680\u2003\u3000aZ09éßİſKΣσς½²Ⅷ٣一ガが가각ᄀ\u0301\u0338ﬁ🙂🇩\u200d!?-_\u200b\ufeff\U0001e900"
    mixed = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(600)]
    points = ["".join(chr(c) for c in range(a, a + 0x100)) for a in range(0, 0x3000, 0x100)] + ["a ".join(chr(c) for c in range(a, a + 0x100)) for a in range(0, 0x3000, 0x100)]
    some = [*texts.values(), *ODD, *mixed, *points]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    got = kernel_ids(spark, tokenizer(name), some)
    assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_bad_bytes_and_other_forms(spark, tmp_path):
    """Bytes that are no UTF-8 count as U+FFFD; a file of another form goes to the library."""
    library = Tokenizer.from_file(tokenizer(FILES[0]))
    bad = [b"a\xffb", b"\xc3", b"\xed\xa0\x80 x", b"\xf4\x90\x80\x80"]
    rows = tokens.encoded(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "doc_id long, text binary"), tokenizer(FILES[0])).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: library.encode(b.decode(errors="replace"), add_special_tokens=False).ids for i, b in enumerate(bad)}
    library.normalizer = normalizers.Lowercase()
    library.save(str(tmp_path / "other.json"))
    assert tokens.alphabet(str(tmp_path / "other.json")) is None
    assert kernel_ids(spark, str(tmp_path / "other.json"), ODD) == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(ODD)}


def test_many_words_overflow_the_memory_of_a_task(spark):
    library = Tokenizer.from_file(tokenizer(FILES[1]))
    rng = random.Random(5)
    some = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(4000)) for _ in range(45)]
    got = kernel_ids(spark, tokenizer(FILES[1]), some)
    assert all(got[i] == e.ids for i, e in enumerate(library.encode_batch_fast(some, add_special_tokens=False)))


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk,overlap", [(150, 10), (700, 60)])
def test_spliced_chunks(name, chunk, overlap, texts):
    library, own = Tokenizer.from_file(tokenizer(name)), tokens.Encoder(tokenizer(name))
    for text in [max(texts.values(), key=len), *ODD[:6], "y" * 2000, "one two  three\n\nfour <|endoftext|> five " * 60]:
        assert [i for ids in own.spliced(text, chunk, overlap) for i in ids] == library.encode(text, add_special_tokens=False).ids


def test_token_counts_of_messy_rows(messy, nothing):
    library = Tokenizer.from_file(tokenizer(FILES[0]))
    rows = tokens.token_counts(messy, tokenizer(FILES[0])).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in messy.collect()]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))
    assert tokens.token_counts(nothing, tokenizer(FILES[0])).count() == 0


def blocks_of(spark, docs, most):
    rows = [(i, ids.astype("<u4").tobytes()) for i, ids in enumerate(docs)]
    made = kernels.apply(spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1), "WriteBlocks", BLOCKS, 1, most)
    return spark.createDataFrame(made.collect(), BLOCKS)


BLOCKS = "shard int, block int, code binary, pieces array<struct<doc_id: long, doc: long, at: long, piece: int, n: long>>"


def pieces_of(blocks):
    return kernels.apply(blocks.select("shard", "code", "pieces"), "ReadBlocks", "shard int, doc long, doc_id long, at long, piece int, n long, crc long")


@pytest.mark.parametrize("most", [1, 100, 65536])
def test_blocks_round_trip(spark, most):
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.4, rng.integers(0, 400)) % 65536 for _ in range(40)] + [np.tile(np.arange(9), 60), np.zeros(0, int), np.array([65535, 2**31 - 1, 0, 70000]), rng.integers(0, 2**31, 300), np.full(3000, 7)]
    blocks = blocks_of(spark, docs, most)
    alone = [pieces_of(blocks.where(F.col("block") == r.block)) for r in blocks.select("block").limit(3).collect()]  # blocks stand alone
    rows = sorted(pieces_of(blocks).collect(), key=lambda r: (r.doc, r.piece))
    assert all(set(df.collect()) <= set(rows) for df in alone)
    at = 0
    for i, ids in enumerate(docs):
        ids, own = np.append(ids, 1).astype("<u4"), [r for r in rows if r.doc == i]
        assert [r.crc for r in own] == [zlib.crc32(ids[a : a + r.n].tobytes()) for a, r in zip(np.cumsum([0, *(r.n for r in own)]), own)]
        assert sum(r.n for r in own) == len(ids) and {(r.doc_id, r.at) for r in own} == {(i, at)} and max(r.n for r in own) <= most
        at += len(ids)


def test_what_repeats_costs_little(spark):
    again = np.tile(np.random.default_rng(2).integers(0, 49_000, 500), 40)
    assert sum(len(r.code) for r in blocks_of(spark, [again], 65536).collect()) < 0.12 * 2 * len(again)


def test_damage_is_told(spark):
    blocks = blocks_of(spark, [np.arange(500)], 65536)
    for k in (0, 5, 25):
        bad = [(r.shard, r.block, bytes(r.code[:k]) + bytes([r.code[k] ^ 1]) + bytes(r.code[k + 1 :]), r.pieces) for r in blocks.collect()]
        with pytest.raises(Exception, match="block"):
            pieces_of(spark.createDataFrame(bad, BLOCKS)).collect()


def test_checksums_join():
    rng = random.Random(2)
    for n in (0, 1, 4, 4000):
        a, b = rng.randbytes(100), rng.randbytes(n)
        assert token_files.joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def read_back(spark, docs, path):
    token_files.write(docs, path, tokenizer(FILES[1]), end=1, shards=3)
    return token_files.read(spark, path).collect()


def wanted(rows):
    library, at, out = Tokenizer.from_file(tokenizer(FILES[1])), 0, []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_of_documents(spark, documents, tmp_path):
    rows = read_back(spark, documents, str(tmp_path / "files"))
    assert sorted(map(tuple, rows)) == wanted(documents.orderBy("doc_id").collect())


def test_files_of_messy_rows(spark, messy, nothing, tmp_path):
    rows = sorted(read_back(spark, messy, str(tmp_path / "files")), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in messy.collect()], key=lambda x: -1 if x is None else x)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(i), n, c) for i, _, n, c in wanted(messy.collect()))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert read_back(spark, nothing, str(tmp_path / "none")) == []
