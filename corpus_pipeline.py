"""A training-data pipeline: five stages, each calling one operator on all
that its predecessor kept.

Toxic documents go; of each group of SimHash near-duplicates one stays;
strings of 200 bytes that occur again are cut out; sources are mixed to their
target weights, so documents repeat or go; and the rest is packed into token
windows. Every stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, packing, simhash, suffix_dedup, toxicity
from tallyspark.llm.common import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; the model learns from the
    labels of the documents given. Null and empty texts are judged like any
    other; repeated rows share their fate, equal texts too; without labels of
    both classes the share of toxic ones decides for all."""
    return toxicity.score(docs, read(spark, sf_dir, "labels")).filter("predicted = 0").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id (null
    ids last), of rows with one id that with the smallest hash, of equal rows
    one. Null, empty and blank texts are one group."""
    return simhash.keep_one(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that occur again. Where a
    cut falls inside a character, its rest becomes a replacement character;
    ``n_chars`` is counted anew; a null text stays null. Of repeated rows each
    is a document, so all their long texts go."""
    names = {c.lower() for c in docs.columns}
    flag = next(f for f in (f"no_text_{i}" for i in range(len(names) + 1)) if f not in names)
    out = suffix_dedup.remove_repeats(docs.withColumn(flag, F.col("text").isNull()))
    text = F.when(~F.col(f"rest.{flag}"), F.make_valid_utf8(F.col("kept").cast("string")))
    fresh = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("rest.n_chars"))
             .cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[fresh.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say. Null
    sources are one source; null and empty texts have no words and weigh
    nothing in the rates; rows equal in id and text share one draw."""
    return mixing.emit_copies(mixing.mix(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows, with their ids. Null and empty texts are
    one closing id; every row is a document, repeated rows too."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# Learning, tokenising and fingerprinting are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
