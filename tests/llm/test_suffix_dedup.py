import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyspark.llm import suffix_dedup as S


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, **kw):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute([r[1] for r in rows]))), key=repr)
    got = S.remove_repeats(df, **kw).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == want
    return sum(x[2] > 0 for x in want)


def near_copies(seed, n=40):
    """Passages cut and joined at odd places, copies with edits, periodic runs."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(40, 150))) for _ in range(4)]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            p = p[a:a + rnd.randint(1, len(p))]
            if rnd.random() < .5 and len(p) > 9:
                i = rnd.randrange(len(p))
                p = p[:i] + rnd.choice(["", "Z", "zz"]) + p[i + 1:]
            parts.append(rnd.choice([p, p, word() * rnd.randint(1, 90), " ".join(word() for _ in range(30))]))
        docs.append(rnd.choice(["", " ", "|"]).join(parts))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_on_edited_copies(spark, seed):
    texts = near_copies(seed)
    assert check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) > 10


@pytest.mark.parametrize("limit", [1, 3])
def test_hot_anchors_are_split(spark, limit):
    df = spark.createDataFrame(list(enumerate(near_copies(3))), "doc_id long, text string")
    assert check(df, hot_contexts=limit) > 10


def test_parts_cover_every_string_once_and_keep_equal_ones_together():
    rnd = random.Random(4)
    core = bytes(rnd.choice(b"abcd") for _ in range(150))
    raws = [bytes(rnd.choice(b"xy") for _ in range(rnd.randint(93, 136))) + core + bytes(rnd.choice(b"xy") for _ in range(rnd.randint(0, 50)))
            for _ in range(60)]
    raws = [r for r in raws if len(r) >= 200]
    level = [(1, 0, 136, i, r.index(core), 0, r, True) for i, r in enumerate(raws)]
    want = sorted((i, s) for i, r in enumerate(raws) for s in range(len(r) - 199) if 0 <= r.index(core) - s <= 136)
    for _ in range(3):
        names = ["route", "lo", "hi", "key", "place", "first", "raw", "needed"]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*level)], names)
        (out,) = S._parts([batch], 200)
        level = list(zip(*(out.column(c).to_pylist() for c in names)))
        got, home = [], {}
        for route, _, _, key, _, first, raw, _ in level:
            for s in range(len(raw) - 199):
                got.append((key, first + s))
                assert home.setdefault(raw[s:s + 200], route) == route
        assert sorted(got) == want
    assert all(len(raw) == 200 for *_, raw, _ in level)


def test_fifty_thousand_contexts_of_one_anchor(spark):
    """One passage amid ever other surroundings, no context twice;
    a string repeats where two documents share both sides' nearer bytes."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage, left, right = text(150), [text(30) for _ in range(300)], [text(20) for _ in range(300)]
    texts = [rnd.choice(left) + passage + rnd.choice(right) + text(13) for _ in range(50_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 10_000 < check(df) < 40_000


def test_edges_and_driver_rows(edge_docs, sf_docs):
    check(edge_docs)
    assert check(sf_docs) > 5


def test_small_arrays_and_strides(spark, monkeypatch):
    """Contexts over several suffix arrays, texts over several strides."""
    monkeypatch.setattr(S, "ARRAY_BYTES", 500)
    contexts = [t.encode() for t in near_copies(5)]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    whole = S.anchors(data, ends)
    monkeypatch.setattr(S, "STRIDE", 333)
    h, place, first, last = S.anchors(data, ends)
    cover = lambda x: sorted((s, p, g) for g, p, a, b in zip(x[0].tolist(), x[1].tolist(), x[2].tolist(), x[3].tolist()) for s in range(a, b + 1))
    assert cover((h, place, first, last)) == cover(whole)


def test_repeated_starts_against_brute_force():
    rnd = random.Random(8)
    shared = bytes(rnd.choice(b"ab") for _ in range(230))
    contexts, places = [], []
    for _ in range(60):
        a, b = rnd.randint(0, 16), rnd.randint(0, 16)
        left = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 20)))
        core = bytearray(shared[a:230 - b if 230 - b > a else 230])
        contexts.append(left + bytes(core) + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 90))))
        places.append(len(left) + 160 - a)
    seen = Counter()
    for c, place in zip(contexts, places):
        seen.update(((p - place) % 8, c[p:p + 200]) for p in range(len(c) - 199))
    want = [(i, p) for i, (c, place) in enumerate(zip(contexts, places)) for p in range(len(c) - 199)
            if seen[(p - place) % 8, c[p:p + 200]] > 1]
    who, starts = S.repeated_starts(contexts, np.array(places))
    assert sorted(zip(who.tolist(), starts.tolist())) == want and len(want) > 50


def test_other_columns_stay(edge_docs, no_docs):
    out = S.remove_repeats(edge_docs)
    assert out.select("rest.*").columns == [c for c in edge_docs.columns if c != "text"]
    assert S.remove_repeats(no_docs).count() == 0


def test_against_sql(sf_docs, oracle, same):
    got = S.remove_repeats(sf_docs).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    same(got, oracle(S.SQL, sf_docs.select("doc_id", "text")))
