import zlib

import numpy as np
from tallyspark.llm import toxicity as X


def test_held_out_accuracy(spark, sf_docs):
    """Learned on four fifths of the labels, judged on the rest."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in X.score(docs, labels).select("doc.doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    unseen = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    clean = [d for d in unseen if not truth[d]]
    assert np.mean([got[d].predicted == truth[d] for d in unseen]) > 0.9
    assert np.mean([got[d].predicted for d in clean]) < 0.05


def test_held_out_labels_are_never_learned(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    take = lambda l: sorted(map(tuple, X.score(sf_docs, l).select("doc.doc_id", "score").collect()))
    assert take(labels) == take(turned)


def test_features_of_a_text():
    text = "YOU are an idi0t!! sooo bad".encode()
    row = dict(zip(X.FEATURES, X.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), {b"idiot": 2.0})[0]))
    assert row["lexicon_density"] == 1 / 6 and row["lexicon_near_you"] == 1 / 6 and row["second_person"] == 1 / 6
    assert row["capitals"] == 3 / 19 and row["exclamations"] == 2 / len(text) and row["disguises"] == 1 / 19
    assert row["letter_runs"] == 1 / 19 and row["lexicon_weight"] == 2 / 6


def test_texts_in_a_slice_do_not_touch():
    texts = [b"aab", b"", b"bb!", b"!!"]
    whole = X.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), {})
    for t, row in zip(texts, whole):
        assert (X.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), {})[0] == row).all()


def test_edge_rows_and_missing_classes(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (5, 0), (6, 7)], "doc_id long, toxic int")
    rows = X.score(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    for some, value in ((labels.limit(0), 0.0), (labels.filter("toxic = 0"), 0.0), (labels.filter("toxic = 1"), 1.0)):
        assert {r.score for r in X.score(edge_docs, some).collect()} == {value}
    assert X.score(no_docs, labels).count() == 0


def test_few_labels_and_odd_columns(spark, sf_docs):
    """From 2 to 20 labels, whichever of them are kept aside."""
    docs = sf_docs.limit(60).withColumnRenamed("lang", "a b-c:d")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5)
    for some in ([(ids[0], 1), (ids[1], 0)], [(ids[2], 1), (ids[3], 0), (ids[4], 0)], [(d, int(i % 6 == 0)) for i, d in enumerate(ids[:20])]):
        rows = X.score(docs, spark.createDataFrame(some, "doc_id long, toxic int")).select("doc.*", "score").collect()
        assert len(rows) == 60 and all(0 <= r.score <= 1 for r in rows) and "a b-c:d" in rows[0].asDict()


def test_repeated_ids_do_not_widen_the_sample(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    take = lambda df: dict(map(tuple, X.score(df, labels).select("doc.doc_id", "score").collect()))
    assert take(sf_docs.unionByName(sf_docs)) == take(sf_docs)
