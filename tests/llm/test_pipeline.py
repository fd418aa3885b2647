from collections import Counter

import corpus_pipeline
from tidelake.llm import common


def test_stages_and_their_decisions(spark):
    d = "/root/testdata/sf0.01"
    docs = common.table(spark, d, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, d))
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after < before, name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))
    whole = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))


def test_stages_take_messy_rows_and_empty_tables(spark, messy, nothing):
    d = "/root/testdata/sf0.001"
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count(), name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
        assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_the_whole_against_plain_loops(spark):
    """Each stage's decisions told again by other means, from what it was given."""
    from tests.llm.test_decontaminate import naive as hits
    from tests.llm.test_similar import kept_by_all_pairs
    from tests.llm.test_tokens import wanted

    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["near_duplicates"](spark, docs, d).collect()}
    assert kept == set(kept_by_all_pairs(given, 5, 0.8))
    bench = [(r.item_id, r.text) for r in common.table(spark, d, "benchmark").collect()]
    ids = sorted(given)
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, d).collect()}
    assert clean == {i for i, (_, n, _) in zip(ids, hits([given[i] for i in ids], bench, 10)) if not n}
    rows = stages["token_files"](spark, docs, d).collect()
    assert sorted(map(tuple, rows)) == wanted(docs.orderBy("doc_id").collect())
    labels = {r.doc_id: (r.quality, r.toxic) for r in common.table(spark, d, "labels").collect()}
    good = {r.doc_id for r in stages["quality"](spark, docs, d).collect()}
    fine = [i for i, (q, x) in labels.items() if q == 1 and not x and i in given]
    assert sum(i in good for i in fine) > 0.95 * len(fine)
