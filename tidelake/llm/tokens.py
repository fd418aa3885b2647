"""Tokens of public tokenizers, for whole texts of any length.

Byte-pair files of the two forms here are applied by a kernel (java/Bpe.java): it splits a text as the file's pattern
does, with the kinds of characters as the library tells them, and remembers the ids of words it has met. The library
itself encodes what the kernel leaves: texts with special strings or with characters that its normal form may change,
texts that are no UTF-8 (bad bytes count as U+FFFD), files of any other form, and huge texts. Those are encoded in
overlapping chunks, with offsets, which are spliced at a boundary that both chunks have, that is stable by the
pattern, and after which their tokens agree: the patterns have no lookbehind, none of their matches goes on over a space
between two marks, and special strings hold no white space.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.common import chunks, text_bytes

#: A text of more characters is encoded in chunks of this many, with an overlap that doubles until a splice is found.
CHUNK, OVERLAP, AGREE = 1 << 16, 1 << 9, 8
# a space between two characters that are no white space
_STABLE = re.compile(r"(?<=[!-~]) (?=[!-~])")

_loaded: dict = {}


class Encoder:
    """A tokenizer, as its library gives the tokens: no truncation, padding or added tokens, special strings by default."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and path."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        """Token ids of a text, in lists, from overlapping chunks.

        The next chunk starts ``overlap`` characters before the end of the last one. They are joined at the first
        place in the overlap that both have as a token boundary, that is stable by the rule above, and after which
        ``AGREE`` tokens (or all that the last chunk still has) are the same. Without one the overlap doubles, and
        where it reaches the chunk's start, so does the chunk: at worst the text is encoded whole.
        """
        at, start = 0, 0  # all before ``start`` is given out; the chunk begins there
        while True:
            end = min(len(text), start + chunk)
            left = self.tokenizer.encode(text[start:end], add_special_tokens=False)
            if end == len(text):
                yield left.ids
                return
            wide, joined = overlap, None
            while joined is None and wide < end - start:
                begin = end - wide
                right = self.tokenizer.encode(text[begin : min(len(text), begin + chunk)], add_special_tokens=False)
                joined = self._splice(text, start, left, begin, right, end)
                wide *= 2
            if joined is None:
                chunk *= 2
                continue
            n, at = joined
            yield left.ids[:n]
            start = at

    @staticmethod
    def _splice(text, start, left, begin, right, end):
        """(number of the left chunk's tokens, place in the text) of the first good boundary, or None."""
        ls = {start + a: i for i, (a, b) in reversed(list(enumerate(left.offsets))) if a < b}
        rs = {begin + a: i for i, (a, b) in reversed(list(enumerate(right.offsets))) if a < b}
        for m in _STABLE.finditer(text, begin + 1, end - 1):
            # a token's offset starts at the space or, trimmed, after it
            i, j = (next((x[p] for p in (m.start(), m.start() + 1) if p in x), None) for x in (ls, rs))
            if i is None or j is None:
                continue
            # the left chunk's last tokens may be cut off by its end
            rest = len(left.ids) - i - 1
            n = min(AGREE, rest)
            if n > 0 and left.ids[i : i + n] == right.ids[j : j + n]:
                return i, m.start()
        return None

    def encode(self, texts: list[bytes | None]) -> list[list[int] | None]:
        """The token ids of each text; of those over CHUNK bytes from spliced chunks. None stays None."""
        out: list[list[int] | None] = [None] * len(texts)
        small = [i for i, t in enumerate(texts) if t is not None and len(t) <= CHUNK]
        for i, ids in zip(small, self.whole([texts[i].decode(errors="replace") for i in small])):
            out[i] = ids
        for i, t in enumerate(texts):
            if t is not None and len(t) > CHUNK:
                out[i] = [x for ids in self.spliced(t.decode(errors="replace")) for x in ids]
        return out


@dataclass(frozen=True)
class Alphabet:
    """What the kernel needs of a tokenizer: the kinds of all code points, lower case, and which of the two forms it has."""

    kinds: str
    lower: str
    words: bool


#: Ranges of code points that neither compose with others nor decompose: normal form C leaves any string of them alone.
#: The others, and those that the library's own normal form or lower case changes in length, are the library's to encode.
_PLAIN = [(0, 0x300), (0x370, 0x483), (0x48A, 0x530), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0), (0x2190, 0x2200), (0x3000, 0x302A), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFF01, 0xFF5F), (0x1F300, 0x1FB00)]


@cache
def alphabet(path: str) -> Alphabet | None:
    """Asks the library which code points are letters, numbers and white space; None for a file of another form."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, normal, split = told["model"], told["normalizer"], told["pre_tokenizer"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and normal is None and not model.get("end_of_word_suffix"):
        words = False
    elif (
        split["type"] == "Sequence"
        and [p["type"] for p in split["pretokenizers"]] == ["Split", "ByteLevel"]
        and split["pretokenizers"][0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and split["pretokenizers"][0]["invert"]
        and not split["pretokenizers"][1]["use_regex"]
        and not split["pretokenizers"][1]["add_prefix_space"]
        and normal
        and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and model.get("end_of_word_suffix") == "</w>"
    ):
        words = True
    else:
        return None
    kinds, lower = [], []
    for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # some thousand code points at a time, without the surrogates
        for a in range(0, 0x110000, 0x1000):
            if not 0xD800 <= a < 0xE000:
                kinds += [(ord(part[0]), ord(part[-1]) + 1, kind) for part, _ in split.pre_tokenize_str("".join(map(chr, range(a, min(a + 0x1000, 0xD800) if a < 0xD800 else a + 0x1000))))]
    if words:
        form, small = normalizers.NFC(), normalizers.Lowercase()
        end = 0
        for a, b in [*_PLAIN, (0x110000, 0x110000)]:
            if end < a:
                kinds.append((end, a, 4))
            end = b
            for c in range(a, b):
                made = small.normalize_str(chr(c))
                if form.normalize_str(chr(c)) != chr(c) or len(made) != 1 or (c > 0xFFFF and made != chr(c)):
                    kinds.append((c, c + 1, 4))
                elif made != chr(c):
                    lower.append((c, ord(made)))
    told_as = lambda rows: ";".join(",".join(map(str, r)) for r in rows)
    return Alphabet(told_as(kinds), told_as(lower), words)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``, in whole texts; null and empty texts have none.

    Repeated rows and null ids stay, an empty table gives no rows, and other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source, known = docs.select("doc_id", text_bytes().alias("text")), alphabet(path)
    if known is None:
        first = source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("n_tokens"), F.col("text").alias("rest"))
    else:
        first = kernels.apply(source, "CountTokens", f"doc_id {kind}, n_bytes long, n_tokens long, rest binary", path, known.kinds, known.lower, known.words, CHUNK)

    def each(batches):
        import pyarrow as pa

        for part in chunks(batches, 3, 2 << 20):
            counts = part.column(2)
            if part.column(3).null_count < part.num_rows:
                encoded = Encoder.of(path).encode(part.column(3).to_pylist())
                counts = pa.array([len(ids) if ids is not None else n for ids, n in zip(encoded, counts.to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    return first.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_tokens long")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of (doc_id, text as bytes), in the same order; ids are little-endian 32-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = alphabet(path)
    if known is None:
        first = docs.select("doc_id", F.lit(None).cast("binary").alias("ids"), F.col("text").alias("rest"))
    else:
        first = kernels.apply(docs.select("doc_id", "text"), "EncodeTokens", f"doc_id {kind}, ids binary, rest binary", path, known.kinds, known.lower, known.words, CHUNK)

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for part in chunks(batches, 2, 2 << 20):
            ids = part.column(1)
            if part.column(2).null_count < part.num_rows:
                made = Encoder.of(path).encode(part.column(2).to_pylist())
                ids = pa.array([x if new is None else np.array(new, "<u4").tobytes() for x, new in zip(ids.to_pylist(), made)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return first.mapInArrow(each, f"doc_id {kind}, ids binary")
