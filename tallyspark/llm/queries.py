"""One query per operator, over its whole table; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.llm import cross_polytope, lm_score, mixing, packing, prefix_trie, repetition, sharding, simhash, spelling, suffix_dedup, token_counts, topk, toxicity
from tallyspark.llm.common import read

REGISTRY = {}
SQL = {}


def register(name, sql=None):
    def put(fn):
        REGISTRY[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return put


@register("op1_repetition", repetition.SQL)
def op1(spark, sf_dir):
    return repetition.repetition(read(spark, sf_dir, "documents"))


@register("op2_suffix_dedup", suffix_dedup.SQL)
def op2(spark, sf_dir):
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc.doc_id", "held_out", "score", "predicted")


@register("op4_voronoi_top_k", topk.SQL)
def op4(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@register("op5_token_counts")
def op5(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@register("op6_sharding", sharding.SQL)
def op6(spark, sf_dir):
    placed = sharding.place(read(spark, sf_dir, "documents"))
    return placed.select(F.col("key").alias("doc_id"), F.col("slot").cast("long").alias("slot"), "shard")


@register("op7_simhash")
def op7(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


@register("op8_lm_score")
def op8(spark, sf_dir):
    return lm_score.score(read(spark, sf_dir, "documents"))


@register("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), keep_ids=False)


@register("op10_mixing", mixing.SQL)
def op10(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc.doc_id", "size", "source_size", "target", "taken")


@register("op11_spelling_variants", spelling.SQL)
def op11(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


@register("op12_cross_polytope", cross_polytope.SQL)
def op12(spark, sf_dir):
    return cross_polytope.near_duplicates(read(spark, sf_dir, "embeddings"))


@register("op13_prefix_trie", prefix_trie.SQL)
def op13(spark, sf_dir):
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))
