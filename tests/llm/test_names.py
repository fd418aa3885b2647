"""Extra columns whose names the operators use themselves stay as they are."""

import pytest
from pyspark.sql import functions as F

from tidelake.llm import common, decontaminate, mixing, quality, repeats, similar, simhash, token_files, tokens
from tidelake.llm.queries import tokenizer

NAMES = [
    "__score", "__content", "__metadata", "score", "content", "metadata", "text_logit", "page_logit", "__copies", "__h", "__s", "copies", "hash", "source_of", "size", "__kept", "__row", "row", "kept",
    "__runs", "__items", "__n_words", "__longest", "n_words", "runs", "items", "longest", "__file", "__at", "__base", "file", "at", "base", "fp", "label", "tie", "rest", "ids", "keys", "sha", "good", "word", "node", "n",
]


@pytest.fixture(scope="module")
def crowded(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    path = str(tmp_path_factory.mktemp("crowded") / "docs")
    docs.select("*", *[F.lit(f"mine {i}").alias(n) for i, n in enumerate(NAMES)]).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_keep_rows_as_they_are(spark, sf_dir, crowded):
    labels, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    before = {r.doc_id: tuple(r) for r in crowded.collect()}
    made = {
        "quality": quality.accepted(crowded, labels),
        "simhash": simhash.one_of_each(crowded),
        "similar": similar.one_of_each(crowded),
        "decontaminate": decontaminate.decontaminated(crowded, bench),
        "mixing": mixing.mixed(crowded),
    }
    for name, out in made.items():
        assert out.columns == crowded.columns, name
        rows = out.collect()
        assert rows and all(tuple(r) == before[r.doc_id] for r in rows), name


def test_others_ignore_them(spark, crowded, tmp_path):
    plain = crowded.select("doc_id", "text", "lang", "source", "n_chars")
    same = lambda f: sorted(map(str, f(crowded).collect())) == sorted(map(str, f(plain).collect()))
    assert same(lambda d: tokens.token_counts(d, tokenizer("byte_bpe_50k.json")))
    assert same(lambda d: repeats.remove_repeats(d, 400)) and same(simhash.near_duplicates)
    for name, docs in (("a", crowded), ("b", plain)):
        token_files.write(docs, str(tmp_path / name), tokenizer("word_bpe_49k.json"), end=1)
    assert sorted(map(tuple, token_files.read(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, token_files.read(spark, str(tmp_path / "b")).collect()))


def test_names_taken_are_an_error(spark, sf_dir, crowded):
    with pytest.raises(ValueError):
        quality.classify(crowded, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with pytest.raises(ValueError):
        decontaminate.scan(crowded, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def test_free_names():
    assert common.free(["A", "_a", "b"], "a") == "__a" and common.free([], "a") == "a"
