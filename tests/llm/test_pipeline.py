import re

import corpus_pipeline as C
import pytest
from tallyspark.llm import mixing, toxicity
from test_packing import check as check_packing
from test_simhash import brute_components, brute_fp
from test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in C.STAGES:
        made = C.cut(f(spark, docs, SF))
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["toxicity", "simhash", "suffix_dedup", "mixing", "packing"]
    for _, docs, made in stages[:-1]:
        assert made.columns == docs.columns and made.schema.simpleString() == docs.schema.simpleString()


def test_toxic_documents_go(spark, stages):
    _, docs, made = stages[0]
    said = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(made) == rows(said.filter("predicted = 0").select("doc.*"))


def test_most_toxic_and_few_clean_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in C.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic, clean = [d for d in truth if truth[d]], [d for d in truth if not truth[d]]
    assert sum(d in kept for d in toxic) < 0.25 * len(toxic) and sum(d in kept for d in clean) > 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    _, docs, made = stages[1]
    prints = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    root = brute_components(set(prints.values()))
    least = {}
    for d, f in prints.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert {r.doc_id for r in made.collect()} == set(least.values()) and made.count() == len(least) < docs.count()


def test_repeated_strings_go(stages):
    _, docs, made = stages[2]
    before, after = sorted(docs.collect()), {r.doc_id: r for r in made.collect()}
    for r, (n, gone, _, _) in zip(before, brute_repeats([r.text for r in before])):
        text = after[r.doc_id].text
        if not gone:
            assert text == r.text
        assert abs(len(text.encode()) - (n - gone)) <= 3 * text.count("�") and after[r.doc_id].n_chars == len(text)


def test_sources_are_mixed(stages, oracle):
    _, docs, made = stages[3]
    sizes = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {r["doc_id"]: r["taken"] for r in oracle(mixing.SQL, docs)}
    got = {}
    for r in made.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + sizes(r.text)
    assert got == {d: t for d, t in taken.items() if t} | {d: 0 for d in got if not got[d]}


def test_windows_hold_all(stages):
    check_packing(stages[3][2])
    assert rows(stages[4][2].select("doc_id", "start", "length", "ids_crc32"))


def test_run_and_edge_rows(spark, edge_docs, no_docs):
    assert C.run(spark, SF).count() > 0
    for docs in (edge_docs, no_docs):
        for name, f in C.STAGES:
            made = C.cut(f(spark, docs, SF))
            if name != "packing":
                assert made.columns == docs.columns
            docs = made


def test_equal_rows_leave_one(edge_docs):
    kept = C.drop_near_duplicates(None, edge_docs, "")
    assert kept.count() == len({repr(r) for r in kept.collect()})
