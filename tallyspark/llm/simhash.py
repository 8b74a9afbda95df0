"""Operator 7: near-duplicates by SimHash fingerprints and pigeonhole blocks.

The 64 bits are cut into ``distance + 2`` blocks. Two fingerprints that differ
in at most ``distance`` bits agree on at least two whole blocks, so rows are
joined on every pair of blocks and the Hamming distance is verified. Equal
fingerprints are one node, so exact copies add no work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut
from tallyspark.llm.graph import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
# Fingerprints of one bucket that meet in one task; larger buckets are cut
# into chunks, and every pair of chunks meets in a task of its own.
CHUNK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        s, e = starts[at:min(n, at + 65536)].tolist(), ends[at:min(n, at + 65536)].tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(s, e)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 keep: list[str] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``keep``: the fingerprint as a signed long.
    Bytes that are no valid UTF-8 count as U+FFFD."""
    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: fingerprint(t, shingle)).astype("uint64").astype("int64")
    return docs.select(docs[id_col].alias("doc_id"), *keep, of(F.coalesce(F.make_valid_utf8(docs[text_col]), F.lit(""))).alias("fp"))


def blocks(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + 2`` blocks that cover 64 bits."""
    n = distance + 2
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _links(distance: int):
    """Arrow batches sorted by task -> (a, b): stars that join, within each
    task, the fingerprints at most ``distance`` bits apart."""
    def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.arange(len(fp))
        step = max(1, (1 << 21) // len(fp))
        for at in range(0, len(fp), step):
            near = np.bitwise_count(fp[at:at + step, None] ^ fp[None, :]) <= distance
            i, j = np.nonzero(near)
            i += at
            keep = i < j
            i, j = i[keep], j[keep]
            while len(i):
                a, b = label[i], label[j]
                low = np.minimum(a, b)
                if (a == b).all():
                    break
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                while (label[label] != label).any():
                    label = label[label]
        return fp[label], fp

    def small(task: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
        size = np.diff(edge)
        # Small tasks together, row against the row s places further on.
        owner = np.repeat(np.where(size <= 32, np.arange(len(size)), -1), size)
        for s in range(1, int(size[size <= 32].max(initial=1))):
            x = np.flatnonzero((owner[s:] == owner[:-s]) & (owner[s:] >= 0))
            x = x[np.bitwise_count(fp[x] ^ fp[x + s]) <= distance]
            if len(x):
                yield fp[x], fp[x + s]
        for k in np.flatnonzero(size > 32):
            a, b = forest(fp[edge[k]:edge[k + 1]])
            yield a[a != b], b[a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.uint64))
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = (np.concatenate((held[0], batch.column(0).to_numpy(zero_copy_only=False))),
                        np.concatenate((held[1], batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
                # The last task of a batch may go on in the next one.
                whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            else:
                whole = len(held[0])
            if whole:
                for a, b in small(held[0][:whole], held[1][:whole]):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                held = (held[0][whole:], held[1][whole:])
    return run


def links(fps: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(a, b): pairs at most ``distance`` bits apart that connect all that are
    connected, from a table of distinct fingerprints ``fp``.

    Each task sends a spanning star per connected part, not all pairs."""
    keys = [F.struct(F.lit(n).alias("n"), *[
        F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias(f"k{i}")
        for i, (s, w) in enumerate(pair)])
        for n, pair in enumerate(itertools.combinations(blocks(distance), 2))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", F.xxhash64("key").alias("bucket"))
    # Buckets of more than one fingerprint; how many chunks each needs.
    sizes = cut(dealt.groupBy("bucket").count().filter("count > 1").select(
        F.col("bucket").alias("b"), F.ceil(F.col("count") / F.lit(chunk)).cast("int").alias("chunks")))
    rows = dealt.join(sizes, F.col("bucket") == F.col("b"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = rows.withColumn("mine", mine).select(
        "fp", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tasks = pairs.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(_links(distance), "a long, b long")


def classes(own: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(f, root, component_id) for every distinct ``fp`` of ``own`` (doc_id, fp):
    the smallest fingerprint and the smallest id that it reaches."""
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distance))
    rooted = cut(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("f"), "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(rooted.join(named, "root").select("f", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row.

    Null, empty and blank texts have fingerprint zero and link like any other.
    A text of fewer words than a shingle is one shingle. Repeated rows keep a
    row each. Null ids never name a component unless it has no other id; an
    empty table gives no rows; other columns are ignored.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    return own.join(classes(own, distance), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the row with
    the smallest id stays (null ids last; of rows with one id, the one with
    the smallest hash; of rows equal in every column, one)."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    # Maps have no hash of their own; their text has one.
    plain = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns, docs.dtypes)]
    row, k1, k2 = F.struct(*columns), F.xxhash64(*plain), F.hash(*plain)
    prints = fingerprints(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                                      F.struct(k1.alias("k1"), k2.alias("k2")).alias("key")), shingle=shingle, keep=["key"])
    own = cut(prints)
    best = own.join(classes(own, distance), F.col("fp") == F.col("f")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    stay = cut(best.select(F.col("best.key.k1").alias("s1"), F.col("best.key.k2").alias("s2")))
    rows = docs.select(row.alias("row"), k1.alias("k1"), k2.alias("k2"))
    kept = rows.join(stay, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    return kept.dropDuplicates(["k1", "k2"]).select("row.*")


def hex16(fp):
    """A signed long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
