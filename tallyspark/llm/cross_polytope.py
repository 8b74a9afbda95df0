"""Operator 12: near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the nearest of the 2n signed axes, and a bucket is
``depth`` such hashes. Each vector lies in its own bucket of every table and
looks into the buckets that follow in order of score (multiprobe); of a pair,
the later vector looks for the earlier one. Inside a bucket 256-bit sign
sketches mark the rows that have a likely partner; the vectors of marked rows
only are sent, and every candidate pair is verified by its cosine.

Links are counted where they are verified and never listed: a pair belongs to
the first table that brings it together, and a task returns one number per
vector and a spanning star.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut
from tallyspark.llm.graph import components

COSINE = 0.9
PROBES = 8
# Share of pairs right at the threshold that may be missed, over all tables.
MISS = 0.004
SEED = 12
# Vectors that a bucket should hold; rows that meet in one task. A larger
# bucket is cut into chunks, and every pair of chunks meets in its own task.
BUCKET = 64
CHUNK = 2048
BITS = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthogonal Hadamard matrix; the width is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(rows, n)
        h *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=256)
def _signs(kind: int, table: int, turn: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, kind, table, turn, n]).choice([-1.0, 1.0], size=(3, n))


def _turned(x: np.ndarray, kind: int, table: int, turn: int) -> np.ndarray:
    for s in _signs(kind, table, turn, x.shape[1]):
        x = hadamard(x * s)
    return x


@lru_cache(maxsize=64)
def _choices(depth: int, probes: int, n: int) -> np.ndarray:
    """Ranks per hash that can be among the ``probes`` best combinations: at
    least as many combinations are better as have smaller ranks throughout."""
    top = min(probes, 2 * n)
    return np.array([c for c in itertools.product(range(top), repeat=depth) if math.prod(i + 1 for i in c) <= probes])


def buckets(x: np.ndarray, table: int, depth: int, probes: int) -> np.ndarray:
    """The ``probes`` best buckets of each row of ``x`` (unit vectors, padded)
    in one table, its own first."""
    n = x.shape[1]
    combos = _choices(depth, probes, n)
    axes, loss = [], []
    for k in range(depth):
        y = _turned(x, 0, table, k)
        order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
        value = np.take_along_axis(y, order, 1)
        # Of an axis' two signs the far one comes far behind.
        signed = np.concatenate((order * 2 + (value < 0), order * 2 + (value >= 0)), axis=1)
        size = np.concatenate((np.abs(value), -np.abs(value)), axis=1)
        best = np.argsort(-size, axis=1, kind="stable")[:, :combos[:, k].max() + 1]
        axes.append(np.take_along_axis(signed, best, 1))
        size = np.take_along_axis(size, best, 1)
        loss.append((size[:, :1] - size) ** 2)
    total = sum(loss[k][:, combos[:, k]] for k in range(depth))
    chosen = combos[np.argsort(total, axis=1, kind="stable")[:, :probes]]
    code = np.zeros(chosen.shape[:2], np.int64)
    for k in range(depth):
        code = code * (2 * n) + np.take_along_axis(axes[k], chosen[:, :, k], 1)
    return code


def sketches(x: np.ndarray) -> np.ndarray:
    """256 signs of turned coordinates of each row, as four words."""
    n = x.shape[1]
    bits = np.hstack([_turned(x, 1, 0, t) >= 0 for t in range(-(-BITS // n))])[:, :BITS]
    return np.packbits(bits, axis=1).view(np.uint64)


def sketch_limit(cosine: float) -> int:
    """Differing bits that a linked pair goes beyond less than once in 10^8."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)) + 1)


def plan(rows: int, dims: int, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS) -> tuple[int, int]:
    """(hashes per bucket, tables). The buckets grow in number with the rows;
    the tables follow from the rate at which random pairs right at the
    threshold meet, measured on 2,000 seeded pairs."""
    n = padded(dims)
    depth = max(1, min(round(math.log(max(rows, 1) / BUCKET + 1) / math.log(2 * n)), int(50 / math.log2(2 * n))))
    rng = np.random.default_rng([SEED, 2])
    x, z = rng.normal(size=(2, 2000, n))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
    meet = (buckets(y, 0, depth, probes) == buckets(x, 0, depth, 1)).any(1).mean()
    return depth, max(1, math.ceil(math.log(miss) / math.log(1 - min(max(meet, 0.01), 0.999))))


def padded(dims: int) -> int:
    return 1 << max(5, (dims - 1).bit_length())


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows padded with zeros, scaled by powers of two so that squares
    neither overflow nor vanish (cosines stay as they are)."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = \
        lists.flatten().to_numpy(zero_copy_only=False)
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _dealt(width: int, depth: int, tables: int, probes: int):
    """(node, v) -> a row per table and probe: key, main, node, sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit(_matrix(part.column("v"), width))
                node, words = part.column("node").to_numpy(), sketches(x).view(np.int64)
                for table in range(tables):
                    code = buckets(x, table, depth, probes) * tables + table
                    p = code.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code.ravel()), pa.array(np.tile(np.arange(p) == 0, len(x))), pa.array(np.repeat(node, p)),
                         *[pa.array(np.repeat(words[:, i], p)) for i in range(words.shape[1])]],
                        ["key", "main", "node", "s0", "s1", "s2", "s3"])
    return run


def _tasks(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (key, main, node, ..) dealt to tasks: with ``task``, ``mine``
    (the row's chunk) and ``solo`` (whether the task is one chunk). Buckets
    where nobody can meet are left out."""
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("main").alias("any")).filter("n > 1 AND any").select(
        F.col("key").alias("k"), F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks")))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    met = rows.join(sizes, F.col("key") == F.col("k")).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = met.withColumn("solo", F.col("mine") == F.col("other")).withColumn(
        "task", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).drop("k", "chunks", "other")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "task").sortWithinPartitions("task", "key")


def _each_task(solve: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """Arrow batches sorted by task and key -> ``solve`` of each task's rows;
    two tasks whose hashes are equal are told apart by their key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                edges = []
            else:
                task, key = batch.column("task").to_numpy(), batch.column("key").to_numpy()
                edges = (np.flatnonzero((task[1:] != task[:-1]) | (key[1:] != key[:-1])) + 1).tolist()
                if last is not None and (task[0], key[0]) != last:
                    edges = [0, *edges]
                last = (task[-1], key[-1])
            at = 0
            for edge in [*edges, None]:
                if batch is not None:
                    piece = batch.slice(at, (edge if edge is not None else batch.num_rows) - at)
                    if piece.num_rows:
                        held.append(piece)
                    at = edge
                if held and (edge is not None or batch is None):
                    yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
    return run


def _can_meet(main: np.ndarray, node: np.ndarray, mine: np.ndarray, solo: bool, i: np.ndarray) -> np.ndarray:
    """Rows ``i`` (main, the earlier vector) against all rows."""
    ok = node[i, None] < node[None, :]
    return ok if solo else ok & (mine[i, None] != mine[None, :])


def _marks(limit: int):
    """Rows of a task that have a partner by their sketches: (key, main, node)."""
    def solve(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        main, node, mine, solo = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("main", "node", "mine", "solo"))
        words = [rows.column(f"s{i}").to_numpy().view(np.uint64) for i in range(4)]
        marked = np.zeros(len(node), bool)
        firsts = np.flatnonzero(main)
        step = max(1, (1 << 20) // len(node))
        for at in range(0, len(firsts), step):
            i = firsts[at:at + step]
            apart = sum(np.bitwise_count(w[i, None] ^ w[None, :]).astype(np.int16) for w in words)
            near = (apart <= limit) & _can_meet(main, node, mine, bool(solo[0]), i)
            marked[i] |= near.any(1)
            marked |= near.any(0)
        yield rows.select(["key", "main", "node"]).filter(pa.array(marked))
    return _each_task(solve)


def _links(width: int, depth: int, tables: int, probes: int, cosine: float):
    """Rows of a task -> (node, n, low): the linked vectors that this table is
    the first to bring together, copies counted, and the smallest node that
    the task's links reach."""
    def solve(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        main, node, mine, solo, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("main", "node", "mine", "solo", "copies"))
        table = int(rows.column("key")[0].as_py()) % tables
        x = _matrix(rows.column("v"), width)
        norm = np.sqrt((x * x).sum(1))
        unit = x / norm[:, None]
        earlier = [buckets(unit, t, depth, probes) for t in range(table)]
        n, label = np.zeros(len(node), np.int64), np.arange(len(node))
        firsts = np.flatnonzero(main)
        step = max(1, (1 << 18) // len(node))
        for at in range(0, len(firsts), step):
            i = firsts[at:at + step]
            near = (x[i] @ x.T) / (norm[i, None] * norm[None, :]) >= cosine
            a, b = np.nonzero(near & _can_meet(main, node, mine, bool(solo[0]), i))
            a = i[a]
            new = np.ones(len(a), bool)
            for codes in earlier:
                new &= ~(codes[b] == codes[a, :1]).any(1)
            np.add.at(n, a[new], copies[b[new]])
            np.add.at(n, b[new], copies[a[new]])
            while len(a):
                low = np.minimum(label[a], label[b])
                if (label[a] == label[b]).all():
                    break
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
        found = np.flatnonzero((n > 0) | (label != np.arange(len(node))))
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(n[found]), pa.array(node[label[found]])], ["node", "n", "low"])
    return _each_task(solve)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                    probes: int = PROBES, miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors``.

    Rows with equal vectors are linked to each other and share everything else.
    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; shorter vectors count as padded with zeros. Rows that
    repeat an id stay rows of their own; a null id names a component only if it
    has no other, and is never kept. An empty table gives no rows; other
    columns are ignored. Pairs right at the threshold are missed at a rate of
    at most about ``miss``, closer ones less often; no pair below it is linked.
    """
    x = F.transform(vectors[vec_col], lambda e: e.cast("double") + F.lit(0.0))
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0.0)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("v")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    # 128 bits stand for a vector when rows are brought back to it.
    print_of = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    distinct = cut(rows.filter("ok").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).select(
        F.monotonically_increasing_id().alias("node"), *print_of, "copies", "least", "v"))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = size.dims or 1
    width = padded(dims)
    depth, tables = plan(size.n, dims, cosine, probes, miss)
    dealt = distinct.select("node", "v").mapInArrow(
        _dealt(width, depth, tables, probes), "key long, main boolean, node long, s0 long, s1 long, s2 long, s3 long")
    marked = cut(_tasks(dealt, chunk).mapInArrow(_marks(sketch_limit(cosine)), "key long, main boolean, node long").distinct())
    carried = marked.join(distinct.select(F.col("node").alias("d"), "copies", "v"), F.col("node") == F.col("d")).drop("d")
    links = cut(_tasks(carried, chunk).mapInArrow(_links(width, depth, tables, probes, cosine), "node long, n long, low long"))
    counts = links.groupBy(F.col("node").alias("c")).agg(F.sum("n").alias("n"))
    roots = components(links, "node", "low").withColumnRenamed("node", "r")
    known = cut(distinct.join(counts, F.col("node") == F.col("c"), "left").join(roots, F.col("node") == F.col("r"), "left").select(
        "k1", "k2", "least", F.coalesce("root", "node").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    known = cut(known.join(named, F.col("root") == F.col("r")).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "n_links", "component_id"))
    linked = rows.filter("ok").select("vec_id", *print_of).join(known, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).select(
        "vec_id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS i, vec_id, e, coalesce(len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS ok
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
links AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.i <> b.i AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON b = i GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp ON comp.a = i LEFT JOIN n ON n.a = i
"""
