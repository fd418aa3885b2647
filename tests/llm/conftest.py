import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, label string, row int, key string, size int, hash string, copies int, target double, word string, cell int"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and other operators' column names."""
    long = "The quick brown fox jumps over the lazy dog near the river bank today. " * 900
    texts = [None, "", " \t\n", "word", "a b c", "Ünïcödé  tèxt\u00a0wïth odd\u2003spaces <|endoftext|> 12 don't!!", long, long + " end", "x" * 5000, "same text of some words here now", "same text of some words here now"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "a row without an id has words too", None, None, None), (None, None, None, None, None), (3, "another text with an id that comes twice", "en", None, 5)]
    return spark.createDataFrame([(*r, 1, "l", 2, "k", 3, "h", 4, 5.0, "w", 6) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
