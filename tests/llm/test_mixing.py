from tallyspark.llm import mixing as M


def test_against_sql(edge_docs, sf_docs, oracle, same):
    for df in (edge_docs, sf_docs):
        want = oracle(M.SQL, df.select("doc_id", "text", "source"))
        same(M.mix(df).select("doc.doc_id", "size", "source_size", "target", "taken"), want)


def test_targets_fill_up_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 3 and got["d"] == 0
    assert abs(got["b"] + got[None] - (1511 - 33)) < 1e-9 and got["b"] / got[None] == 1.0  # weights 2 and 2


def test_copies_and_columns(edge_docs):
    mixed = M.mix(edge_docs)
    out = M.emit_copies(mixed)
    assert out.columns == edge_docs.columns
    assert out.count() == sum(r.copies for r in mixed.collect())
    assert all(r.taken <= 3 * r.size for r in mixed.collect())
    assert sorted(map(repr, M.mix(edge_docs).collect())) == sorted(map(repr, mixed.collect()))


def test_takes_come_near_targets(spark):
    docs = spark.range(20000).selectExpr(
        "id AS doc_id", "repeat('w ', cast(1 + id % 40 as int)) AS text", "concat('s', id % 5) AS source")
    rows = M.mix(docs).groupBy("doc.source").agg({"taken": "sum", "target": "max"}).collect()
    for r in rows:
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05


def test_many_sources_join_by_shuffle(edge_docs, monkeypatch):
    want = sorted(map(repr, M.mix(edge_docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, M.mix(edge_docs).collect())) == want


def test_empty_table(no_docs):
    assert M.mix(no_docs).count() == 0
    assert M.emit_copies(M.mix(no_docs)).columns == no_docs.columns
