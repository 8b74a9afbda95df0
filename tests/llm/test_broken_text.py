"""Texts whose bytes are no valid UTF-8, and columns of awkward names and kinds."""
import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from tallyspark.llm import cross_polytope, packing, repetition, simhash, spelling, suffix_dedup, token_counts, toxicity


@pytest.fixture(scope="module")
def broken(spark):
    """Ids 1 and 2 share 300 bytes, of which some are no text."""
    shared = "C3" + "61FF62" * 100
    return spark.sql(f"""SELECT 1L AS doc_id, cast(unhex('{shared}2E') AS string) AS text UNION ALL
                         SELECT 2L, cast(unhex('41{shared}') AS string) UNION ALL SELECT 3L, 'fine' UNION ALL SELECT 4L, null""")


def test_broken_bytes(spark, broken):
    got = {r[0]: r for r in suffix_dedup.remove_repeats(broken).select("rest.doc_id", "kept", "n_bytes", "n_removed").collect()}
    assert bytes(got[1].kept) == b"." and bytes(got[2].kept) == b"A" and got[1].n_bytes == 302 and bytes(got[3].kept) == b"fine"
    counted = {r.doc_id: r for r in token_counts.token_counts(broken).collect()}
    assert counted[1].n_bytes == 302 and counted[1].n_tokens > 100 and counted[4].n_tokens == 0
    pieces = packing.pack(broken).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == counted[1].n_tokens + 1
    assert simhash.near_duplicates(broken).count() == repetition.repetition(broken).count() == 4
    assert spelling.variants(broken).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(broken, labels).count() == 4


def test_awkward_columns(spark, broken):
    """Names that need quotes, names of inner columns, and a map."""
    docs = (broken.withColumn("a b-c:d", F.lit(1)).withColumn("no_text_", F.lit("mine")).withColumn("NO_TEXT_0", F.lit("mine"))
            .withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long")))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(
        {r.component_id for r in simhash.near_duplicates(broken).collect()})
    assert simhash.keep_one(docs.unionByName(docs)).count() == simhash.keep_one(docs).count()
    out = C.drop_repeated_strings(spark, docs, "")
    assert out.columns == docs.columns and {r.no_text_ for r in out.collect()} == {"mine"}
    assert {r.doc_id: r.text for r in out.collect()}[4] is None
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).select("doc.*").columns == docs.columns
    vectors = spark.createDataFrame([(1, [1.0, 0.0], {"k": 1}), (2, [1.0, 0.1], None)], "vec_id long, embedding array<double>, `a b-c:d` map<string,int>")
    assert [r.n_links for r in cross_polytope.near_duplicates(vectors).collect()] == [1, 1]
