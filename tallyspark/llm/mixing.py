"""Operator 10: mixing sources to target weights.

Tokens are summed per source, targets follow the weights, and each document
is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with
probability equal to the fraction. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
# At most so many sources are broadcast (a name and three numbers each);
# beyond it the join is a shuffle join with adaptive skew splitting.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column, text: Column) -> Column:
    """A number in [0, 1) from the document alone (52 bits of an MD5)."""
    seeded = F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null")),
                      F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seeded), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) -> the same with ``target``.

    Sources in code-point order, null last, take the weights in turn. Targets
    share the total by weight and stop at ``cap`` times the source's size; the
    excess is shared again by weight. The fixed point is found in one sorted
    pass: sources fill up in order of size / weight. One row per source, so
    the window's single partition holds names and numbers only.
    """
    everything = Window.partitionBy()
    w = sizes.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    w = (w.withColumn("limit", (F.lit(float(cap)) * F.col("source_size")))
          .withColumn("total", F.sum("source_size").over(everything).cast("double")))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    w = (w.withColumn("left", F.col("total") - F.coalesce(
            F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
          .withColumn("n", F.row_number().over(by_fill)))
    fits = F.col("left") * F.col("weight") <= F.col("limit") * F.col("open")
    w = w.withColumn("level", F.min(F.when(fits, F.struct("n", "left", "open"))).over(everything))
    share = F.col("level.left") * F.col("weight") / F.col("level.open")
    return w.select("source", "source_size",
                    F.when(F.col("n") < F.coalesce(F.col("level.n"), F.col("n") + 1), F.col("limit"))
                     .otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with ``size``,
    ``source_size``, ``target``, ``copies`` and ``taken`` (= size x copies).

    Null texts have size 0; null sources form one source; documents of a
    source without words are taken 0 times; rows equal in id and text share
    one draw; an empty table gives an empty result. Other columns may have
    any names: they stay inside ``doc``.
    """
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
                        docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
                        uniform(seed, docs[id_col], docs[text_col]).alias("u"))
    sizes = cut(docs.select(docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
                .groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes, weights, cap)
    if sizes.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return (joined.withColumn("rate", rate).withColumn("copies", copies)
            .select("doc", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each document's columns, ``copies`` times."""
    return (mixed.filter("copies > 0")
            .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc.*"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
        FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((r - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS lim,
             (sum(source_size) OVER ())::DOUBLE AS total FROM src),
f AS (SELECT *, total - coalesce(sum(lim) OVER (ORDER BY lim / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY lim / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
             row_number() OVER (ORDER BY lim / weight, r) AS n FROM w),
lvl AS (SELECT n, rest, open_w FROM f WHERE rest * weight <= lim * open_w ORDER BY n LIMIT 1),
t AS (SELECT f.source, f.source_size,
             CASE WHEN f.n < coalesce(lvl.n, f.n + 1) THEN f.lim ELSE lvl.rest * f.weight / lvl.open_w END AS target
      FROM f LEFT JOIN lvl ON true),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('{SEED}|' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || '|' || coalesce(s.text, '')), 1, 13))::BIGINT
               / 4503599627370496.0::DOUBLE AS u
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
"""
