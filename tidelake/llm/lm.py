"""Language-model scores from a lattice of subword units.

The units are the pieces of an existing subword vocabulary and, besides them, the words of the training documents. A
text's lattice has an arc for every unit that fits at a place; all its paths, that is all segmentations, count by the
product of their units' weights, and the score is the logarithm of their sum. Units don't reach over white space, so
the lattice of a text is a chain of its words' lattices and the sum is a product over words, each found by a forward
recursion in log space (java/Lattice.java) and needed once for each distinct word.

The vocabulary's own scores weigh the pieces first. The one at hand comes from byte-pair merges, so its scores are
ranks: a piece of rank r weighs 1 / (r + RANK), as frequencies fall with ranks. All segmentations of the training
documents' distinct words under these weights give each piece an expected count, to which the vocabulary's weights,
worth PRIOR pieces together, are added. A word's own arc weighs (count - discount) / N, its pieces' paths share what the discounts leave,
so a score is a proper log-probability.
"""

from __future__ import annotations

import base64
import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.common import numbered, removed, text_bytes, written

#: Words that all executors hold: the most frequent ones of at most HOT_BYTES bytes.
HOT, HOT_BYTES = 200_000, 64
START = "▁"
#: What is added to a rank, and how many pieces the vocabulary's own weights are worth.
RANK, PRIOR = 3.0, 20_000.0
#: Distinct words that a task adds up before it gives them out.
_FLUSH = 400_000


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a document is held out from learning, by the CRC-32 of its id as text; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word: binary, c: long): every distinct word of ``docs`` (held_out, text: binary) and its count in training texts."""
    return kernels.apply(docs.select("held_out", "text"), "CountWords", "word binary, c long", _FLUSH).groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Pieces:
    """The pieces' names, and the natural logarithms of their weights: those that begin a word share one, the later ones and the stop another."""

    names: list[str]
    logs: list[float]
    stop: float

    def sent(self) -> tuple[str, str]:
        """As the kernel takes them."""
        packed = struct.pack(f"<{len(self.logs) + 1}d", *self.logs, self.stop)
        return "\n".join(self.names), base64.b64encode(packed).decode()

    def of_words(self, spark):
        """A function of a column of words: the logarithm of the sum over all segmentations."""
        return kernels.function(spark, "LatticeLog", "double", *self.sent())


def _weighed(names: list[str], counts: list[float], words: float) -> Pieces:
    """Relative counts; ``words`` is how often a word stopped."""
    first = [n.startswith(START) for n in names]
    a = sum(c for c, f in zip(counts, first) if f)
    b = sum(c for c, f in zip(counts, first) if not f) + words
    return Pieces(names, [math.log(c / (a if f else b)) for c, f in zip(counts, first)], math.log(words / b))


def vocabulary(model: str) -> tuple[list[str], list[float]]:
    """The pieces of a sentencepiece model that words are made of, and their weights by the model's scores, 1 together.

    Scores that are log-probabilities count as such; those of byte-pair models are negative ranks.
    """
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and START not in m.id_to_piece(i)[1:]]
    scores = [m.get_score(i) for i in ids]
    ranked = all(x == int(x) for x in scores)
    # bytes have no rank of their own: they come last
    last = max((-x for x in scores), default=0.0) + 1
    weights = [1 / ((last if m.is_byte(i) else -x) + RANK) for i, x in zip(ids, scores)] if ranked else [math.exp(x) for x in scores]
    return [m.id_to_piece(i) for i in ids], [w / sum(weights) for w in weights]


def learn_pieces(words: DataFrame, model: str, rounds: int = 1) -> Pieces:
    """The pieces' weights: the vocabulary's own, then ``rounds`` times with what they expect of the distinct words with a count.

    The driver gets sums for each piece of the vocabulary, no more, however many words there are.
    """
    names, own = vocabulary(model)
    prior = [PRIOR * w for w in own]
    pieces = _weighed(names, prior, PRIOR / 4)
    types = words.where("c > 0").select("word")
    n = types.count()
    for _ in range(rounds):
        found = kernels.apply(types, "ExpectedPieces", "piece int, n double", *pieces.sent()).groupBy("piece").agg(F.sum("n").alias("n"))
        counts = dict(found.collect())
        pieces = _weighed(names, [counts.get(i, 0.0) + p for i, p in enumerate(prior)], n + PRIOR / 4)
    return pieces


def score(docs: DataFrame, model: str, rounds: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Whole texts, A-Z lower-cased, are words, runs of anything but the six ASCII white spaces, and one end; null and
    empty texts have the end alone. base_score is the text's log10-probability under counts with half a count added,
    score that of the lattice. Rows with a null id are learned from. Repeated rows count and are scored as often as
    they come, an empty table gives no rows, and other columns are ignored.

    Each executor holds the most frequent words, a fixed number. What remains of a document goes, with its counts,
    through a join with the table of all words, on the words themselves; one that isn't held is about as rare as the
    HOT-th most frequent one.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = numbered(docs.select("doc_id", "text")).select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), text_bytes().alias("text"))
    words = written(word_counts(source))
    t = words.agg(F.sum("c").alias("n"), *[F.count_if(x).alias(k) for k, x in (("v", F.col("c") > 0), ("n1", F.col("c") == 1), ("n2", F.col("c") == 2))]).first()
    ends = source.where("not held_out").count()
    n, v = (t.n or 0) + ends, t.v + (ends > 0)
    below = n + 0.5 * (v + 1)
    discount = min(0.9, max(0.1, t.n1 / (t.n1 + 2 * t.n2))) if t.n1 else 0.5
    share, end = (discount * t.v / n, ends / n) if n else (0.5, 0.5)
    share = share or 1e-9
    pieces = learn_pieces(words, model, rounds)
    # a word's log10 weight: its pieces' paths and, if it was seen, its own arc
    apart = F.lit(math.log(share)) + pieces.of_words(spark)("word")
    own = F.log(F.greatest(F.col("c") - discount, F.lit(1e-300)) / (n or 1))
    both = F.greatest("a", own) + F.log1p(F.exp(-F.abs(F.col("a") - own)))
    table = written(words.withColumn("a", apart).select("word", "c", (F.when(F.col("c") > 0, both).otherwise(F.col("a")) / math.log(10)).alias("lp")))
    removed(words)
    # the most frequent words, as many as a histogram of logarithmic counts allows: no task sends more than it must
    level = F.floor(F.log2("c") * 16)
    usual = table.where((F.col("c") > 0) & (F.octet_length("word") <= HOT_BYTES))
    most, room = math.inf, HOT
    for r in sorted(usual.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r.n > room:
            break
        most, room = r.level, room - r.n
    top = usual.where(level >= most).select("word", "c", "lp").collect() if most < math.inf else []
    packed = b"".join([struct.pack("<i", len(top)), *(struct.pack("<h", len(r.word)) + bytes(r.word) + struct.pack("<2d", math.log10((r.c + 0.5) / below), r.lp) for r in top)])
    held = spark.sparkContext._jsc.broadcast(packed)
    del top
    end_base, end_score = math.log10((ends + 0.5) / below), math.log10(end or 0.5)
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<long>"
    parts = written(kernels.apply(source.select("row", "doc_id", "held_out", "text"), "ScoreTexts", schema, held, end_base, end_score, ends > 0))
    tail = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times")
    scored = tail.join(table, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / below)).alias("b"),
        F.sum(F.col("times") * F.col("lp")).alias("s"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias({"base": "base_score"}.get(a, a))
    return parts.join(scored, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "b"), plus("score", "s")
    )
