import pytest

from tidelake.llm import common, lm, repeats, simhash

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def many_groups(spark, tmp_path):
    """Two files of several row groups, so that they split differently by configuration."""
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(100)), "en") for i in range(600)]
    docs = spark.createDataFrame(rows + rows[:100], "doc_id long, text string, lang string").repartition(2)
    docs.write.option("parquet.block.size", 4096).option("compression", "none").parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


@pytest.fixture
def shifting(spark, monkeypatch):
    """Files split otherwise after each intermediate table, as when an executor is lost or joins."""
    before, sizes = spark.conf.get(SPLIT), [20_000, 80_000, 33_000, 1 << 30] * 20

    def write(df):
        out = common.written(df)
        spark.conf.set(SPLIT, sizes.pop())
        return out

    spark.conf.set(SPLIT, 50_000)
    for module in (simhash, repeats, lm):
        monkeypatch.setattr(module, "written", write)
    yield
    spark.conf.set(SPLIT, before)


def test_one_of_each_keeps_the_right_rows_when_splits_change(many_groups, shifting):
    kept = [r.doc_id for r in simhash.one_of_each(many_groups, words=5, radius=1).collect()]
    assert sorted(kept) == list(range(600))


def test_repeats_join_the_right_rows_when_splits_change(many_groups, shifting):
    rows = repeats.remove_repeats(many_groups).collect()
    # texts that come twice lose all their bytes, the others none
    assert len(rows) == 700 and all((r.kept == b"" if r.doc_id < 100 else not r.spans and r.kept is None) for r in rows)


def test_numbers_hold_over_filters_and_other_plans(spark, many_groups, nothing):
    def numbers(df):
        return sorted((r.n, r.doc_id) for r in common.numbered(df, "n").select("n", "doc_id").collect())

    before = spark.conf.get(SPLIT)
    try:
        for df in (many_groups.where("doc_id % 3 = 0").select("doc_id"), many_groups):
            spark.conf.set(SPLIT, 20_000)
            one = numbers(df)
            spark.conf.set(SPLIT, 1 << 30)
            assert numbers(df) == one and len({n for n, _ in one}) == len(one) == df.count()
        twice = many_groups.union(many_groups)
        assert len({n for n, _ in numbers(twice)}) == 1400
    finally:
        spark.conf.set(SPLIT, before)
    assert numbers(nothing) == []
