import numpy as np

from tidelake.llm import quality


def test_held_out_accuracy(spark):
    """Learns from the lower half of the labelled ids and is measured on the upper."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r["__score"] for r in quality.classify(docs, labels.where("doc_id < 5000")).select("doc_id", "__score").collect()}
    assert len(rows) == docs.count()
    rest = labels.where("doc_id >= 5000").collect()
    good = [rows[r.doc_id] for r in rest if r.quality == 1 and r.toxic == 0]
    bad = [rows[r.doc_id] for r in rest if r.quality == 0]
    assert np.mean(np.array(good) >= 0.5) > 0.95 and np.mean(np.array(bad) < 0.5) > 0.8


def test_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(11)] + [(None, 1, 0), (2, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r["__score"] <= 1 for r in rows)
    assert quality.accepted(messy, labels).columns == messy.columns
    assert quality.classify(nothing, labels).count() == 0
    assert {r["__score"] for r in quality.classify(messy, labels.limit(0)).collect()} == {1.0}


def test_runs_agree(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = ({r.doc_id: r["__score"] for r in quality.classify(x, labels).collect()} for x in (documents, documents.repartition(3)))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_views_are_calibrated(spark):
    """Of documents not learned from, about as many are good as each view's chance says."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in quality.classify(docs, labels.where("crc32(string(doc_id)) % 2 = 0")).collect()}
    rest = [r for r in labels.where("crc32(string(doc_id)) % 2 = 1").collect() if r.doc_id in rows]
    for name in ("__content", "__metadata", "__score"):
        said = np.mean([rows[r.doc_id][name] for r in rest])
        found = np.mean([r.quality == 1 and r.toxic == 0 for r in rest])
        assert abs(said - found) < 0.05, name


def test_toxic_documents_go(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in quality.accepted(docs, labels.where("doc_id < 5000")).select("doc_id").collect()}
    rest = [r for r in labels.where("doc_id >= 5000").collect()]
    assert np.mean([r.doc_id in kept for r in rest if r.toxic == 1]) < 0.3  # some 2,000 labels to learn from
    assert np.mean([r.doc_id in kept for r in rest if r.quality == 1 and r.toxic == 0]) > 0.95


def test_a_repeated_id_is_drawn_once_and_rounds_use_all_documents(spark, sf_dir, documents, monkeypatch):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = []
    fit = quality._cotrain
    monkeypatch.setattr(quality, "_cotrain", lambda spark, words, text, page, good, pool, rounds: seen.append((len(good), pool.count())) or fit(spark, words, text, page, good, pool, rounds))
    quality.train(documents.union(documents), labels, labelled=40)
    assert seen == [(40, 2 * documents.count() - 40)]
