"""Operator 4: exact top-k search as a Voronoi kNN join.

Vectors become integers, and inner products become distances by one more
coordinate (with R the largest norm, a candidate x is lifted to
(x, sqrt(R^2 - |x|^2)) and a query q to (q, 0); the nearer, the larger the
product). Queries and candidates go to the cell of their nearest pivot; the
pivots are as many as the root of the rows, spread over a sample.

Bounds come in two steps. Each query is first solved within its own cell,
which bounds how far its k-th neighbour can lie (where the cell holds too few,
the cells' summaries bound it). The queries of a cell then lie in one ball, and
cells whose balls overlap are solved as a group. A candidate is sent to the
groups only whose balls it can lie in, solved there, and the best k of a
query's parts are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut

SCALE = 1024
K = 10
# Most pivots (they, and per cell k + 1 distances, reach every task), and rows
# looked at for each.
PIVOTS = 1024
SPREAD = 4
# Queries solved together, and candidates that meet them in one task.
QUERY_BLOCK = 1024
DATA_BLOCK = 16384
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): components as whole doubles; rows with a null id, a null
    vector, or a null or non-finite component are left out."""
    x = F.transform(vectors[vec_col], lambda e: e.cast("double"))
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), x.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    # Not F.floor: it would go through a long, which large components leave.
    floor = lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e)
    return rows.select("id", F.transform("v", lambda e: floor(e * scale)).alias("v"))


def _matrix(lists, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _dealt(ids: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Ids dealt evenly to ``n`` parts, whatever steps they come in."""
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.asarray(np.maximum(n, 1), np.uint64)).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; clipped to the range of a long."""
    bound = np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((x * x).sum(1).max(initial=0))
    if bound < 2.0 ** 52:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(e) for e in r] for r in m], dtype=object).reshape(m.shape)
    out = whole(q) @ whole(x).T
    return np.vectorize(lambda e: max(-LONG - 1, min(LONG, int(e))), otypes=[np.int64])(out)


def _best(q_ids, q, x_ids, x, k: int, q_rows) -> pd.DataFrame:
    """The k best candidates of each query, ties to smaller ids."""
    parts = []
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    for at in range(0, len(q), 128):
        s = _products(q[at:at + 128], x)
        for i, row in enumerate(s):
            keep = np.flatnonzero(x_ids != q_ids[at + i])
            if len(keep) > k:
                least = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                keep = keep[row[keep] >= least]
            keep = keep[np.argsort(-row[keep].astype(object) if (row[keep] == -LONG - 1).any() else -row[keep], kind="stable")][:k]
            parts.append(pd.DataFrame({"row": q_rows[at + i], "query_id": q_ids[at + i], "vec_id": x_ids[keep], "score": row[keep]}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of ``sample``, each the farthest from those before it."""
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _solved(dims: int, k: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        m = _matrix(rows["v"].tolist(), dims)
        ids, row = rows["id"].to_numpy(), rows["row"].to_numpy()
        return _best(ids[asks], m[asks], ids[~asks], m[~asks], k, row[asks])
    return solve


TASKS = "task string, row long, id long, v array<double>, asks boolean"
FOUND = "row long, query_id long, vec_id long, score long"


def _own_cells(data: DataFrame, asked: DataFrame, sizes: dict[int, int], asking: dict[int, int], query_block: int, data_block: int) -> DataFrame:
    """Tasks of the first step: the queries of each cell and its candidates."""
    blocks = {c: -(-n // data_block) for c, n in sizes.items()}
    pieces = {c: -(-n // query_block) for c, n in asking.items()}

    def deal(mine: dict[int, int], others: dict[int, int], asks: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[b["cell"].isin(others)]
                if len(b):
                    cells = b["cell"].to_numpy()
                    part = _dealt(b["row"].to_numpy(), np.array([mine[c] for c in cells]))
                    most = np.array([others[c] for c in cells])
                    for o in range(int(most.max())):
                        at = np.flatnonzero(most > o)
                        names = [f"{c}-{p}-{o}" if asks else f"{c}-{o}-{p}" for c, p in zip(cells[at], part[at])]
                        yield b.iloc[at][["row", "id", "v"]].assign(task=names, asks=asks)[["task", "row", "id", "v", "asks"]]
        return run
    return data.mapInPandas(deal(blocks, pieces, False), TASKS).unionByName(asked.mapInPandas(deal(pieces, blocks, True), TASKS))


def grouped_cells(reach: dict[int, float], count: dict[int, int], apart: np.ndarray, query_block: int) -> list[list[int]]:
    """Cells with queries, in groups: a cell joins the group whose first cell is
    nearest if their balls overlap and the group's queries fit in a block."""
    groups: list[list[int]] = []
    for c in sorted(count, key=lambda c: (apart[0, c], c)):
        near = [g for g in groups if apart[g[0], c] < reach[g[0]] + reach[c] and sum(count[i] for i in g) + count[c] <= query_block]
        if near:
            min(near, key=lambda g: apart[g[0], c]).append(c)
        else:
            groups.append([c])
    return groups


class Join:
    """The join, worked out up to what is sent: ``tasks`` (rows of candidates
    and queries, by task), ``groups``, and the numbers it is judged by."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, scale: int,
                 pivots: int, query_block: int, data_block: int) -> None:
        numbered = lambda df: cut(integers(df, id_col, vec_col, scale).select(F.monotonically_increasing_id().alias("row"), "id", "v"))
        x, q = numbered(vectors), numbered(queries)
        square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
        limits = x.unionByName(q).agg(F.max(square).alias("r2"), F.max(F.size("v")).alias("dims")).first()
        self.n_data = x.count()
        self.tasks, self.groups, self.dims = None, [], max(limits.dims or 1, 1)
        if not self.n_data or q.isEmpty():
            return
        r2, dims = limits.r2, self.dims
        lift = lambda m: np.sqrt(np.maximum(r2 - (m * m).sum(1), 0))[:, None]
        m = min(pivots, max(1, math.isqrt(self.n_data)))
        chosen = x.orderBy(F.xxhash64("row"), "row").limit(SPREAD * m).collect()
        sample = _matrix([r.v for r in chosen], dims)
        pivot = spread_pivots(np.hstack([sample, lift(sample)]), m)
        slack = 1e-6 * (np.sqrt(r2) + 1)  # above what rounding can take from a distance

        def celled(lifted: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for at in range(0, len(b), 4096):
                        part = b.iloc[at:at + 4096]
                        v = _matrix(part["v"].tolist(), dims)
                        d = _distances(np.hstack([v, lift(v) if lifted else np.zeros((len(v), 1))]), pivot)
                        cell = d.argmin(1)
                        yield part.assign(cell=cell, d=d[np.arange(len(v)), cell])
            return run
        schema = "row long, id long, v array<double>, cell int, d double"
        data, asked = cut(x.mapInPandas(celled(True), schema)), cut(q.mapInPandas(celled(False), schema))

        # Summaries: per cell its size and its k + 1 smallest distances, and the
        # radius and number of its queries (pivots x (k + 4) numbers in all).
        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                held = b if held is None else pd.concat([held, b])
                held = held.sort_values("d").groupby("cell").head(k + 1)
            if held is not None:
                yield held
        near = data.select("cell", "d").mapInPandas(nearest, "cell int, d double").withColumn(
            "n", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).filter(F.col("n") <= k + 1).collect()
        sizes = {r.cell: r["count"] for r in data.groupBy("cell").count().collect()}
        asking = {r.cell: r for r in asked.groupBy("cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()}
        count = {c: r.n for c, r in asking.items()}
        apart = _distances(pivot, pivot)

        # First step: a query's k-th best product in its own cell bounds its
        # distance to the k-th neighbour of all.
        own = _own_cells(data, asked, {c: n for c, n in sizes.items() if c in count}, {c: n for c, n in count.items() if c in sizes},
                         query_block, data_block).groupBy("task").applyInPandas(_solved(dims, k), FOUND)
        by_score = Window.partitionBy("row").orderBy(F.desc("score"))
        kth = own.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") == k).select(F.col("row").alias("r"), F.col("score").cast("double"))
        far = F.sqrt(F.greatest(square + F.lit(float(r2)) - 2 * F.col("score"), F.lit(0.0)))
        rows = asked.join(kth, F.col("row") == F.col("r"), "left").groupBy("cell").agg(
            F.max(F.col("d") + far).alias("reach"), F.max(F.col("score").isNull()).alias("open")).collect()
        self.reach = {}
        for r in rows:
            # One more than k, as the query itself may be among them.
            bound = np.sort([asking[r.cell].r + apart[r.cell, o.cell] + o.d for o in near])
            bound = asking[r.cell].r + (bound[k] if len(bound) > k else np.inf)
            self.reach[r.cell] = (bound if r.open else min(bound, r.reach)) + slack
        reach = self.reach
        members = self.groups = grouped_cells(reach, count, apart, query_block)
        group_of = {c: g for g, cells in enumerate(members) for c in cells}
        pieces_of = [-(-sum(count[c] for c in cells) // query_block) for cells in members]
        blocks = max(1, -(-self.n_data // data_block))

        def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cell, d = b["cell"].to_numpy(), b["d"].to_numpy()
                part = _dealt(b["row"].to_numpy(), blocks)
                for g, cells in enumerate(members):
                    need = np.zeros(len(b), bool)
                    for i in cells:
                        # Triangle inequality over both pivots.
                        need |= np.maximum(apart[i, cell] - d, d - apart[i, cell]) <= reach[i]
                    need = np.flatnonzero(need)
                    for piece in range(pieces_of[g] if len(need) else 0):
                        yield b.iloc[need][["row", "id", "v"]].assign(task=[f"{g}-{piece}-{p}" for p in part[need]], asks=False)[
                            ["task", "row", "id", "v", "asks"]]

        def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                group = np.array([group_of[c] for c in b["cell"]], dtype=np.int64)
                piece = _dealt(b["row"].to_numpy(), np.array(pieces_of)[group])
                for part in range(blocks):
                    yield b[["row", "id", "v"]].assign(task=[f"{g}-{p}-{part}" for g, p in zip(group, piece)], asks=True)[
                        ["task", "row", "id", "v", "asks"]]
        self.tasks = data.mapInPandas(sent, TASKS).unionByName(asked.mapInPandas(asks, TASKS))

    def share_sent(self) -> float:
        """Candidates sent, in copies of the whole table per group."""
        return self.tasks.filter("NOT asks").count() / (self.n_data * len(self.groups))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``queries`` among those
    of ``vectors``, whatever their number.

    Score: the inner product of floor(scale * component); rows with a query's
    own id are no candidates of it; all candidates are returned if fewer than
    ``k``. Rows without an id or with null or non-finite components take no
    part; shorter vectors count as padded with zeros. Rows that share an id
    are candidates each; as queries they share one list, the best of both.
    Products beyond a long are clipped to its range. Empty tables give no
    rows; other columns are ignored.
    """
    join = Join(vectors, queries, id_col, vec_col, k, scale, pivots, query_block, data_block)
    if join.tasks is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = join.tasks.groupBy("task").applyInPandas(_solved(join.dims, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
