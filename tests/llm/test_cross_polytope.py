import math

import numpy as np

from tallyspark.llm import cross_polytope as C

SCHEMA = "vec_id long, embedding array<double>, node string, v string, k1 string"


def brute(rows, cosine=0.9):
    """Every pair by its cosine; components by spreading the smallest row."""
    ok = [v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v) for _, v in rows]
    dims = max([len(v) for (_, v), k in zip(rows, ok) if k], default=1)
    x = np.array([[*v, *[0.0] * (dims - len(v))] if k else [0.0] * dims for (_, v), k in zip(rows, ok)]).reshape(len(rows), dims)
    x = x / np.maximum(np.abs(x).max(1, initial=1e-300), 1e-300)[:, None]
    norm = np.sqrt((x * x).sum(1))
    near = np.zeros((len(rows), len(rows)), bool)
    good = np.flatnonzero(ok)
    if len(good):
        near[np.ix_(good, good)] = (x[good] @ x[good].T) / (norm[good, None] * norm[None, good]) >= cosine
    np.fill_diagonal(near, False)
    low = np.arange(len(rows))
    while True:
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(rows))], dtype=int)
        if (new == low).all():
            break
        low = new
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(low == low[i]) if rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((vec_id, int(near[i].sum()), comp, vec_id is not None and vec_id == comp))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in C.near_duplicates(df, **kw).collect()), key=repr)


def clustered(seed=4, dims=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(60)]
    for c in range(3):
        centre = rng.normal(size=dims)
        rows += [(100 * (c + 1) + i, (centre + rng.normal(size=dims) * rng.choice([.05, .15, .3])).tolist()) for i in range(50)]
    return rows


def test_edges_and_brute_force(spark):
    rows = clustered()
    one = rows[0][1]
    rows += [(900 + i, one) for i in range(12)] + [(930, [3 * e for e in one]), (931, [-e for e in one])]
    rows += [(940, None), (941, []), (942, [0.0] * 24), (943, [1.0, None] + [0.0] * 22), (944, [float("nan")] * 24), (945, [float("inf")] + [1.0] * 23)]
    rows += [(None, one), (None, None), (None, rows[1][1]), (5, one), (5, one), (950, [1.0]), (951, [2.0, 0.0]), (952, [-0.0, 1.0]), (953, [0.0, 2.0])]
    rows += [(960, [1e200] * 24), (961, [1e-200] * 24), (962, [5e-324] * 24)]
    want = brute(rows)
    # Enough probes that nothing can be missed, and chunks far below a bucket.
    assert run(spark, rows, probes=64, chunk=7) == want
    assert run(spark, rows) == want


def test_given_table_and_sql(spark, oracle, same):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    same(C.near_duplicates(df), oracle(C.SQL, df, "embeddings"))
    small = spark.createDataFrame([(*r, "", "", "") for r in clustered()], SCHEMA)
    same(C.near_duplicates(small, probes=64), oracle(C.SQL, small, "embeddings"))


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_right_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.91 in 64 dimensions, several hashes a bucket."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 64))
    z = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(.9 + 1e-9, .91, 1500)[:, None]
    b = c * a + np.sqrt(1 - c * c) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))]
    got = run(spark, rows)
    assert sum(r[1] for r in got) / 3000 >= 0.99
    below = .89 * a[:300] + math.sqrt(1 - .89 ** 2) * z[:300]
    assert sum(r[1] for r in run(spark, [(i, v.tolist()) for i, v in enumerate(np.vstack([a[:300], below]))])) == 0


def test_multiprobe_and_plan():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    h = C.hadamard(np.eye(32))
    assert np.allclose(h @ h.T, np.eye(32))
    for depth in (1, 2, 3):
        codes = C.buckets(x, 1, depth, 8)
        assert all(len(set(r)) == 8 for r in codes.tolist()) and (codes[:, :1] == C.buckets(x, 1, depth, 1)).all()
    assert C.plan(10 ** 9, 64)[0] > C.plan(10 ** 5, 64)[0] > C.plan(100, 64)[0]
