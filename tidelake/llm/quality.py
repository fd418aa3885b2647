"""A quality classifier by co-training two views of a document.

One view is its text: which words it has and its style (letters, marks, repetition, lengths). The other is its page's
metadata: language and source. Each view has a logistic classifier. Both learn from the labelled sample; then, over some
rounds, each gives its most confident verdicts on all other documents to the other as pseudo-labels. After each fit the
views are calibrated on labelled documents that neither learned from, so that "confident" means the same in both; a
third, small fit joins the two calibrated views and gives the final score to all documents.

The labelled documents are drawn by a hash of their ids, ``labelled`` of them at most: the bound on what the driver holds.
All others, however many, are candidates for pseudo-labels in each round: their features are written once, each task
keeps its best, and only those chosen reach the driver. Texts are read by kernels for the JVM (java/TextView.java).
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.common import free, numbered, removed, text_bytes, written

#: Labelled documents to learn from, at most.
LABELLED = 12_000
#: Word features are kept by their association with the label; a word must be in SEEN documents of the sample.
WORDS, SEEN = 4096, 8
#: Rounds, pseudo-labels of each kind that a view gives in one, and how sure it must be.
ROUNDS, EACH, SURE = 3, 200, 0.95
#: Hashed values of each metadata field, and features of a text's style.
HASHED, STYLE = 1024, 192


@dataclass
class Logistic:
    """A logistic classifier on sets of binary features."""

    weights: np.ndarray
    bias: float = 0.0

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, size: int, weight: np.ndarray | None = None, l2: float = 2e-4, steps: int = 250, rate: float = 0.08) -> Logistic:
        """Adam on the whole sample; classes are weighed alike by ``weight``, one for each row."""
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w, b = np.zeros(size), 0.0
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        k = np.ones(len(rows)) if weight is None else weight
        k = k / max(k.sum(), 1e-9)
        for t in range(1, steps + 1):
            z = np.bincount(row, w[at], minlength=len(rows)) + b
            err = k * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g = np.append(np.bincount(at, err[row], minlength=size) + l2 * w, err.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - d[:-1], b - d[-1]
        return cls(w, float(b))

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() + self.bias for r in rows])


@dataclass
class View:
    """A view's classifier and its calibration: the chance of a good document is the logistic of scale * logit + shift."""

    plain: Logistic
    scale: float
    shift: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.scale * self.plain.logits(rows) + self.shift

    def column(self, spark, features: str | Column) -> Column:
        """The calibrated logit of packed features."""
        weights = np.append(self.plain.weights * self.scale, self.plain.bias * self.scale + self.shift)
        sent = base64.b64encode(weights.astype("<f8").tobytes()).decode()
        return kernels.function(spark, "Weigh", "double", sent)(features)


@dataclass
class Model:
    """The words that have a feature, one a line, both views, and what joins their calibrated logits."""

    words: str
    text: View
    page: View
    joint: tuple[float, float, float]


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A logistic fit drawn to ``start``, by Newton's steps, halved until the loss falls."""
    loss = lambda w: np.logaddexp(0, np.where(y == 1, -(x @ w), x @ w)).sum() + 0.5 * ((w - start) ** 2).sum()
    w = start
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(x.shape[1]), x.T @ (p - y) + w - start)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    return w


def _page_features() -> Column:
    """A page's language, source and both together, hashed, as two bytes each; nulls have features of their own."""
    known = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))
    parts = [known("lang"), known("source"), F.concat(known("lang"), F.lit("\n"), known("source"))]
    packed = []
    for k, part in enumerate(parts):
        f = F.crc32(part.cast("binary")) % HASHED + k * HASHED
        packed += [F.lpad(F.hex(f % 256), 2, "0"), F.lpad(F.hex(F.floor(f / 256)), 2, "0")]
    return F.unhex(F.concat(*packed))


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u2").astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """The model, or None where there are no labelled documents of both kinds."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    own = numbered(docs.select("doc_id", "lang", "source", text_bytes().alias("text")))
    # one row for each id; ids alone are sorted
    drawn = own.select("row", "doc_id").join(marks, "doc_id").groupBy("doc_id").agg(F.min("row").alias("row"), F.min("good").alias("good"))
    some = sorted(((r.o, str(r.doc_id), r.row, r.good) for r in drawn.withColumn("o", F.xxhash64(F.lit(7), "doc_id")).orderBy("o", "doc_id").limit(labelled).collect()), key=lambda r: r[:2])
    good = np.array([int(r[3]) for r in some])
    if len(set(good.tolist())) < 2:
        return None
    sample = F.broadcast(spark.createDataFrame([(r[2], bool(r[3])) for r in some], "row long, good boolean"))
    told = kernels.apply(own.select("row", "text").join(sample, "row").select("good", "text"), "TextWords", "good boolean, words array<binary>")
    n_good, n_bad = int(good.sum()), int(len(good) - good.sum())
    df = told.select("good", F.explode("words").alias("w")).groupBy("w").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).where(F.col("g") + F.col("b") >= SEEN)
    p, q = F.col("g") / n_good, F.col("b") / n_bad
    spread = F.abs(p - q) / F.sqrt((F.col("g") + F.col("b")) * F.lit(1.0) / (n_good * 1.0 * n_bad) + 1e-12)
    words = "\n".join(bytes(r.w).decode("latin-1") for r in df.orderBy(spread.desc(), "w").limit(WORDS).collect())
    features = written(own.select("row", F.xxhash64("doc_id", "lang", "source").alias("tie"), kernels.function(spark, "TextFeatures", "binary", words)("text").alias("text"), _page_features().alias("page")))
    rows = {r.row: (_unpacked(r.text), _unpacked(r.page)) for r in features.join(sample, "row").select("row", "text", "page").collect()}
    text, page = ([rows[r[2]][k] for r in some] for k in (0, 1))
    model = _cotrain(spark, words, text, page, good, features.join(sample, "row", "left_anti"), rounds)
    removed(features)
    return model


def _cotrain(spark, words: str, text: list, page: list, good: np.ndarray, pool: DataFrame, rounds: int) -> Model:
    known = np.arange(len(good))
    aside, learn = known[::4], np.delete(known, np.s_[::4])
    if len(set(good[learn])) < 2 or len(set(good[aside])) < 2:
        aside = learn = known
    sizes = (STYLE + len(words.split("\n")) if words else STYLE, 3 * HASHED)
    seen = (text, page)
    # each view's rows to learn from: features, verdict, weight
    own = [[(rows[i], int(good[i]), 1.0) for i in learn] for rows in seen]
    taken: list[int] = []
    for turn in range(rounds + 1):
        views = []
        for rows, size, marks in zip(seen, sizes, own):
            plain = Logistic.fit([m[0] for m in marks], np.array([m[1] for m in marks]), size, np.array([m[2] for m in marks]))
            z = plain.logits([rows[i] for i in aside])
            scale, shift = _newton(np.stack([z, np.ones(len(aside))], axis=1), good[aside], np.array([1.0, 0.0]))
            views.append(View(plain, float(scale), float(shift)))
        if turn == rounds:
            break
        least = float(np.log(SURE / (1 - SURE)))
        for k, (view, name) in enumerate(zip(views, ("text", "page"))):
            z = pool.withColumn("z", view.column(spark, F.col(name)))
            for kind, order, sure in ((1, F.col("z").desc(), F.col("z") > least), (0, F.col("z").asc(), F.col("z") < -least)):
                # executors settle which rows are best; only these reach the driver, with their features
                best = z.where(sure).orderBy(order, "tie", "row").limit(EACH + len(taken)).select("row", "z", "tie")
                found = pool.select("row", "text", "page").join(F.broadcast(best), "row").collect()
                found.sort(key=lambda r: (-r.z if kind else r.z, r.tie, r.row))  # noqa: B023
                fresh = [r for r in found if r.row not in set(taken)][:EACH]
                taken += [r.row for r in fresh]
                # pseudo-labels weigh half
                own[1 - k] += [(_unpacked(r.page if k == 0 else r.text), kind, 0.5) for r in fresh]
    x = np.stack([*(v.logits([rows[i] for i in aside]) for v, rows in zip(views, seen)), np.ones(len(aside))], axis=1)
    return Model(words, *views, tuple(_newton(x, good[aside], np.array([1.0, 0.0, 0.0]))))


def scored(docs: DataFrame, model: Model | None, into: tuple[str, str, str] = ("__content", "__metadata", "__score")) -> DataFrame:
    """``docs`` with each view's calibrated chance of a good document and theirs joined, in columns named by ``into``."""
    if set(into) & set(docs.columns):
        raise ValueError(f"a column of {into} is there already")
    if model is None:
        return docs.withColumns({n: F.lit(1.0) for n in into})
    spark = docs.sparkSession
    a, b = (free(docs.columns, n) for n in ("text_logit", "page_logit"))
    features = kernels.function(spark, "TextFeatures", "binary", model.words)(text_bytes())
    out = docs.withColumns({a: model.text.column(spark, features), b: model.page.column(spark, _page_features())})
    chance = lambda z: 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    u, v, w = model.joint
    return out.withColumns({into[0]: chance(F.col(a)), into[1]: chance(F.col(b)), into[2]: chance(u * F.col(a) + v * F.col(b) + w)}).drop(a, b)


def classify(docs: DataFrame, labels: DataFrame, into: tuple[str, str, str] = ("__content", "__metadata", "__score"), **bounds) -> DataFrame:
    """``docs`` with three more columns named by ``into``, for every row; see scored(), and train() for the bounds.

    A good document is one labelled of quality 1 and not toxic; a document labelled more than once must be good each
    time. Null and empty texts are documents without words. Where labels of both kinds are missing every document
    scores 1. Repeated rows score alike, an empty table gives none, other columns stay. Names of ``into`` that the
    documents have already are an error.
    """
    return scored(docs, train(docs, labels, **bounds), into)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns, whatever these are called.

    Nulls, empty texts, repeated rows and empty tables are as in classify().
    """
    into = tuple(free(docs.columns, n) for n in ("content", "metadata", "score"))
    return classify(docs, labels, into, **bounds).where(F.col(into[2]) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
