import random

import numpy as np
from tallyspark.llm import lm_score as L


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in L.fresh().items()}
    window, target = rng.integers(0, L.IDS + 1, (30, 4)), rng.integers(0, L.IDS, 30)
    hidden = L._hidden
    L._hidden = lambda p, w: np.tanh(sum(p["embed"][w[:, k]] * p["place"][k] for k in range(4)) + p["bias"])
    try:
        g = L.gradients(p, window, target)
        loss = lambda: -L.log_probs(p, window, target).mean()
        for name in p:
            flat, grad = p[name].reshape(-1), g[name].reshape(-1)
            for i in [int(np.abs(grad).argmax()), *rng.integers(0, flat.size, 3)]:
                old = flat[i]
                flat[i] = old + 1e-5
                up = loss()
                flat[i] = old - 1e-5
                down = loss()
                flat[i] = old
                assert abs((up - down) / 2e-5 - grad[i]) < 1e-5, name
    finally:
        L._hidden = hidden


def test_probabilities_sum_to_one():
    p = L.fresh()
    window = np.tile(np.array([[1, 2, 3, 4]]), (L.IDS, 1))
    assert abs(np.exp(L.log_probs(p, window, np.arange(L.IDS))).sum() - 1) < 1e-4


def test_counts_cover_all_words(spark, edge_docs):
    want = np.zeros(L.BUCKETS, np.int64)
    for r in edge_docs.select("text").collect():
        raw = np.frombuffer((r[0] or "").encode(), np.uint8)
        np.add.at(want, L.word_buckets(raw, np.array([0, len(raw)]))[1], 1)
    got = edge_docs.select("text").mapInArrow(L._counted, "bucket long, n long").groupBy("bucket").sum("n").collect()
    assert {r[0]: r[1] for r in got if r[1]} == {int(b): int(want[b]) for b in np.flatnonzero(want)}


def test_held_out_order_matters(spark):
    """Text with a fixed word order: unseen text in that order scores above
    the same words shuffled."""
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]

    def chain(n):
        out = [rnd.randrange(40)]
        while len(out) < n:
            out.append((out[-1] + rnd.choice([1, 1, 1, 2])) % 40)
        return [words[i] for i in out]
    docs = [(i, " ".join(chain(200))) for i in range(900)]
    fresh = [chain(200) for _ in range(20)]
    docs += [(10000 + i, " ".join(t)) for i, t in enumerate(fresh)]
    docs += [(20000 + i, " ".join(rnd.sample(t, len(t)))) for i, t in enumerate(fresh)]
    got = {r.doc_id: r.mean_log_prob for r in L.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)).collect()}
    assert all(got[10000 + i] > got[20000 + i] + 0.5 for i in range(20))


def test_score_against_single_words(spark, edge_docs, no_docs):
    ids = L.vocabulary(edge_docs)
    p = L.train(edge_docs.coalesce(1), ids)
    for r in edge_docs.coalesce(1).select("doc_id", "text").mapInArrow(
            L._scored(p, ids), "doc_id long, n_words long, log_likelihood double, mean_log_prob double").join(
            edge_docs.filter("doc_id < 12"), "doc_id").collect():
        words = (r.text or "").encode().split()
        found = [int(ids[L.word_buckets(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0]]) for w in words]
        padded = [L.BOUNDARY] * 2 + found + [L.BOUNDARY] * 2
        want = sum(L.log_probs(p, np.array([[padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]]), np.array([w]))[0]
                   for i, w in enumerate(found))
        assert r.n_words == len(words) and abs(r.log_likelihood - want) < 1e-3 * max(1, abs(want))
        assert (r.mean_log_prob is None) == (not words)
    assert L.score(edge_docs).count() == edge_docs.count()
    assert L.score(no_docs).count() == 0


def test_every_word_is_a_target():
    import pyarrow as pa
    texts = ["one two three", "four", "", "five six seven eight nine ten " * 7, None, "eleven"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(L._trained(L.fresh(), np.zeros(L.BUCKETS, np.int16))(iter([batch])))
    assert set(out[0]["weight"].to_pylist()) == {sum(len((t or "").split()) for t in texts)}


def test_words_have_their_share_of_an_id(spark, monkeypatch):
    """Against exact counts: words that share an id differ by their counts."""
    import math
    from collections import Counter
    rnd = random.Random(5)
    words = [f"k{i}" for i in range(3000)]
    docs = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(3000)], k=400))) for i in range(60)]
    docs += [(100, None), (None, "k1 k2999 once"), (None, "k1 k2999 twice twice"), (103, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(L, "NAMED", 50)
    monkeypatch.setattr(L, "CHUNK_BYTES", 20000)
    monkeypatch.setattr(L, "train", lambda *_: L.fresh())
    ids = L.vocabulary(df)
    n = Counter(w for _, t in docs for w in (t or "").split())
    id_of = {w: int(ids[L.word_buckets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0]]) for w in n}
    total = Counter()
    for w in n:
        total[id_of[w]] += n[w]
    assert len(total) < len(n)
    base = {(r.doc_id, r.n_words): r.log_likelihood for r in df.mapInArrow(
        L._scored(L.fresh(), ids), "doc_id long, n_words long, log_likelihood double, mean_log_prob double").collect()}
    got = L.score(df).collect()
    assert len(got) == len(docs)
    text = {(i, len((t or "").split())): t for i, t in docs}
    for r in got:
        own = (text[r.doc_id, r.n_words] or "").split()
        want = base[r.doc_id, r.n_words] + sum(math.log(n[w] / total[id_of[w]]) for w in own)
        assert abs(r.log_likelihood - want) < 1e-6 * max(1, abs(want))
        assert (r.mean_log_prob is None) == (not own)
