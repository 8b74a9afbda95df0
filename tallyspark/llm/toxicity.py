"""Operator 3: toxicity by gradient-boosted trees over dense features.

A lexicon is learned from the labelled training rows (words whose share among
toxic documents is surely larger), dense features are measured on every whole
text, Spark's gradient-boosted trees are fitted on them, and an isotonic
regression on rows that the trees haven't seen turns their probability into
the score. Training takes a bounded, hash-chosen sample of the labelled rows;
scoring covers every row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import cut
from tallyspark.llm.repetition import _slices

# At most so many labelled rows are learned from, chosen by a hash of the id.
TRAIN_ROWS = 20_000
# At most so many words are kept in the lexicon.
LEXICON_WORDS = 500
TREES, DEPTH = 30, 3
NEAR = 5  # words between a lexicon word and a second-person word
FOLDS = 5

# Second-person words of the languages served: our own choice, not learned.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch "
    "tú usted ustedes vosotros vuestro".encode().split())

FEATURES = ["lexicon_density", "lexicon_weight", "lexicon_count", "lexicon_near_you", "second_person", "capitals",
            "exclamations", "punctuation", "digits", "disguises", "letter_runs", "words"]

# Lower case, digits and signs that stand for letters, other punctuation as spaces.
_PLAIN = bytearray(range(256))
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 32
_PLAIN[65:91] = bytes(range(97, 123))
for _a, _b in zip(b"013457@$", b"oieastas"):
    _PLAIN[_a] = _b
_PLAIN = bytes(_PLAIN)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_UPPER, _LETTER = _mask(bytes(range(65, 91))), _mask(bytes([*range(65, 91), *range(97, 123)]))
_BANG, _DIGIT = _mask(b"!?"), _mask(b"0123456789")
_PUNCT = _mask(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_DISGUISE = _mask(b"013457@$*")


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from; rows without an id count as seen."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: dict[bytes, float]) -> np.ndarray:
    """One row of ``FEATURES`` for each text data[offsets[i]:offsets[i + 1]]."""
    docs, size = len(offsets) - 1, len(data)
    out = np.zeros((docs, len(FEATURES)))
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    count = lambda mask: np.bincount(owner[mask], minlength=docs)
    letter = _LETTER[data]
    inner = np.zeros(size, bool)
    runs = np.zeros(size, bool)
    if size > 2:
        one = (owner[2:] == owner[:-2])
        inner[1:-1] = one & letter[:-2] & _DISGUISE[data[1:-1]] & letter[2:]
        runs[2:] = one & letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    chars = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(count(letter), 1)
    out[:, 5] = count(_UPPER[data]) / letters
    out[:, 6] = count(_BANG[data]) / chars
    out[:, 7] = count(_PUNCT[data]) / chars
    out[:, 8] = count(_DIGIT[data]) / chars
    out[:, 9] = count(inner) / letters
    out[:, 10] = count(runs) / letters
    raw = data.tobytes()
    for d in range(docs):
        words = raw[offsets[d]:offsets[d + 1]].translate(_PLAIN).split()
        n = max(len(words), 1)
        hits = [i for i, w in enumerate(words) if w in lexicon]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        out[d, 4] = len(you) / n
        out[d, 11] = math.log1p(len(words))
        if hits:
            out[d, 0] = len(hits) / n
            out[d, 1] = sum(lexicon[words[i]] for i in hits) / n
            out[d, 2] = math.log1p(len(hits))
            if you:
                at, you = np.asarray(hits), np.asarray(you)
                to = np.searchsorted(you, at)
                gap = np.minimum(np.abs(you[np.minimum(to, len(you) - 1)] - at), np.abs(you[np.maximum(to - 1, 0)] - at))
                out[d, 3] = (gap <= NEAR).sum() / n
    return out


def _measured(df: DataFrame, lexicon: dict[bytes, float], text_of) -> DataFrame:
    """``features`` beside the columns of ``df``, for the text that ``text_of``
    takes from a batch (so it travels once)."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for data, offsets in _slices(text_of(batch)):
                rows = features(data, offsets, lexicon)
                n = len(rows)
                table = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, n) for c in batch.columns], table], [*kept, "features"])
                at += n
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))]))


def learn_lexicon(sample: DataFrame, limit: int = LEXICON_WORDS) -> dict[bytes, float]:
    """Words of ``sample`` (toxic, text) that toxic documents hold more often,
    with the log of the ratio, lowered by two standard errors. A word must be
    in at least three toxic documents and 0.4 % of them. Counts are combined
    in each batch before they are shuffled; ``limit`` words return."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(set((text or b"").translate(_PLAIN).split()))
            words = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([found[0][w] for w in words], pa.int64()),
                                              pa.array([found[1][w] for w in words], pa.int64())], ["word", "clean", "toxic"])
    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = (sample.select("toxic", F.col("text").cast("binary")).mapInArrow(count, "word binary, clean long, toxic long")
              .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .filter(F.col("toxic") >= max(3, math.ceil(0.004 * total[1]))))
    clean, toxic = F.col("clean") + 0.5, F.col("toxic") + 0.5
    weight = (F.log(toxic / F.lit(total[1] + 1.0)) - F.log(clean / F.lit(total[0] + 1.0))
              - 2 * F.sqrt(1 / toxic + 1 / clean))
    top = counts.select("word", weight.alias("weight")).filter("weight > 0.7").orderBy(F.desc("weight"), "word").limit(limit)
    return {bytes(r["word"]): r["weight"] for r in top.collect()}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with ``held_out``,
    ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    ``labels`` has (doc_id, toxic); null or other labels are left aside, of
    several labels for an id the largest holds, of several texts the smallest.
    Only labelled rows that aren't held out are learned from. A third of them
    calibrates; where this or the rest would lack a class, all rows do both. Null and empty texts are scored like any other.
    Without both classes among those rows, every score is the share of toxic
    ones (0 without any). Equal texts get equal scores.
    """
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .select(F.col("doc_id").alias("labelled"), "toxic"))
    order = F.xxhash64(F.lit("toxicity"), "labelled")
    # A bounded sample: train_rows ids and labels; their texts follow by a join.
    chosen = cut(known.orderBy(order, "labelled").limit(train_rows))
    sample = cut(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
                 .join(chosen, F.col("id") == F.col("labelled"))
                 .groupBy("labelled").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
                 .select("labelled", "toxic", (F.pmod(order, F.lit(3)) == 0).alias("calibrates"), "text"))
    parts = sample.groupBy("toxic", "calibrates").count().collect()
    classes = {t: sum(r["count"] for r in parts if r["toxic"] == t) for t in {r["toxic"] for r in parts}}
    every = docs.select(doc, held_out(docs[id_col]).alias("held_out"))
    if len(classes) < 2:
        raw = every.withColumn("score", F.lit(1.0 if classes.get(1) else 0.0))
    else:
        lexicon = learn_lexicon(sample.select("toxic", "text"))
        vectors = lambda df: df.withColumn("features", array_to_vector("features"))
        learned = cut(_measured(sample, lexicon, lambda batch: batch.column("text")).drop("text").coalesce(4))
        learned = vectors(learned)
        learns, calibrates = learned.filter("not calibrates"), learned.filter("calibrates")
        if len(parts) < 4:  # too few labels to keep some aside
            learns = calibrates = learned
        trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7,
                              cacheNodeIds=False).fit(learns)
        probability = vector_to_array("probability")[1].alias("p")
        curve = IsotonicRegression(labelCol="toxic", featuresCol="p", predictionCol="score").fit(
            trees.transform(calibrates).select("toxic", probability))
        inner = docs.columns.index(text_col)
        found = _measured(every, lexicon, lambda batch: pc.struct_field(batch.column("doc"), [inner]))
        seen = trees.transform(vectors(found)).select("doc", "held_out", probability)
        raw = curve.transform(seen).drop("p")
    return raw.withColumn("score", F.least(F.greatest(F.col("score").cast("double"), F.lit(0.0)), F.lit(1.0))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
