import math
import random

from tallyspark.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, id string, task string"


def brute(rows, k=10, every=100):
    """Every pair of rows; a query's own id is left out."""
    ints = [(r[0], [math.floor(1024 * e) for e in r[1]]) for r in rows
            if r[0] is not None and r[1] is not None and all(e is not None and math.isfinite(e) for e in r[1])]
    out = []
    for q in {i for i, _ in ints if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for p, v in ints if p == q for i, x in ints if i != q)[:k]
        out += [{"query_id": q, "rank": n, "vec_id": i, "score": -s} for n, (s, i) in enumerate(best, 1)]
    return out


def run(df, **kw):
    return T.top_k(df, df.filter("vec_id % 100 = 0"), **kw)


def test_against_brute_force_and_sql(spark, oracle, same):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute(df.select("vec_id", "embedding").collect())
    same(run(df), want)
    same(run(df), oracle(T.SQL, df, "embeddings"))


def test_edges(spark, same):
    import struct
    rnd = random.Random(5)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    vec = lambda s=1.0: [f32(rnd.gauss(0, s)) for _ in range(6)]
    one = vec()
    rows = [(i * 10, vec(), "x", "y") for i in range(80)] + [(1000 + i, one, "x", "y") for i in range(60)]
    rows += [(3000, None, "x", None), (3100, [1.0, None, 2.0, 0.0, 0.0, 0.0], None, "y"), (3200, [float("nan")] * 6, "x", "y"),
             (3300, [float("inf")] * 6, "x", "y"), (None, vec(), "x", "y"), (3400, [0.0] * 6, "x", "y"), (3500, [1.0], "x", "y"),
             (3600, [], "x", "y"), (0, rows[0][1], "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(run(df), brute(rows))
    same(run(df, pivots=3, query_block=2, data_block=7), brute(rows))
    few = spark.createDataFrame(rows[:4], SCHEMA)
    same(run(few), brute(rows[:4]))
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_beyond_doubles(spark, same):
    rows = [(i * 50, [float(2 ** 20 + i), float(2 ** 21 - i * i), 1.0], "", "") for i in range(12)]
    same(run(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def join(df, **kw):
    kw = {"pivots": T.PIVOTS, "query_block": T.QUERY_BLOCK, "data_block": T.DATA_BLOCK, **kw}
    return T.Join(df, df.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, T.SCALE, **kw)


def test_bounds_prune(spark):
    """Vectors in clusters of one norm: a cluster's candidates are sent to its
    own queries, under a third of all copies, and results stay."""
    import numpy as np
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (8, 16))
    centre *= 20 / np.linalg.norm(centre, axis=1)[:, None]
    # Queries (ids divisible by 100) in every cluster.
    rows = [(int(i), (centre[(i // 7) % 8] + rng.normal(0, .05, 16)).astype("float32").tolist(), "", "") for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, run(df).collect())) == sorted(
        (r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in brute(rows))
    found = join(df)
    assert len(found.groups) > 3 and found.share_sent() < 1 / 3


def test_far_cells_are_never_one_group():
    import numpy as np
    at = np.array([[0.0], [1.0], [10.0], [11.0]])
    apart = np.abs(at - at.T)
    assert T.grouped_cells({0: .6, 1: .6, 2: .6, 3: .3}, {0: 1, 1: 1, 2: 1, 3: 1}, apart, 100) == [[0, 1], [2], [3]]
    assert T.grouped_cells(dict.fromkeys(range(4), 9.0), dict.fromkeys(range(4), 1), apart, 2) == [[0, 1], [2, 3]]


def test_rows_that_share_an_id_are_candidates_each(spark, same, oracle):
    rows = [(100, [1.0, 0.0], "", ""), (101, [0.9, 0.0], "", ""), (101, [0.1, 0.5], "", ""), (102, [0.5, 0.0], "", ""),
            (200, [0.0, 1.0], "", ""), (200, [1.0, 0.2], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(run(df), brute(rows))
    same(run(df), oracle(T.SQL, df, "embeddings"))
    same(run(df, pivots=1, query_block=1, data_block=1), brute(rows))
