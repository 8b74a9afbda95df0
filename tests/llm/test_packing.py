import random
import zlib
from collections import defaultdict

import numpy as np
from tallyspark.llm import packing as P
from tallyspark.llm import tokens
from tokenizers import Tokenizer


def padding(size, window):
    return 3 if size < window and size.bit_count() == 1 else window - size


def brute_cost(places, fees, window):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min(best[i] + min(padding(int(places[j] - places[i]), window), window - int(places[j] - places[i])) + fees[j]
                      for i in range(j) if places[j] - places[i] <= window)
    return best[-1]


def test_cuts_against_brute_force(monkeypatch):
    monkeypatch.setattr(P, "SHORT", 3)
    rnd = random.Random(4)
    for _ in range(200):
        window = rnd.randint(5, 40)
        places = np.cumsum([0] + [rnd.randint(1, window) for _ in range(rnd.randint(1, 60))])
        fees = np.array([rnd.choice([0, 4, 64]) for _ in places])
        ends = P.cuts(places, fees, window)
        at = [0, *ends]
        assert ends[-1] == len(places) - 1
        sizes = [places[b] - places[a] for a, b in zip(at, ends)]
        assert max(sizes) <= window
        assert sum(min(padding(int(s), window), window - int(s)) for s in sizes) + sum(fees[e] for e in ends) == brute_cost(places, fees, window)


def test_open_end_is_the_cheapest(monkeypatch):
    monkeypatch.setattr(P, "SHORT", 3)
    rnd = random.Random(6)
    for _ in range(100):
        places = np.cumsum([0] + [rnd.randint(1, 20) for _ in range(40)])
        fees = np.array([rnd.choice([0, 4]) for _ in places])
        ends = P.cuts(places, fees, 30, last=False)
        cost = brute_cost(places[:ends[-1] + 1], fees, 30)
        near = [i for i in range(len(places)) if places[i] > places[-1] - 30]
        assert ends[-1] in near and cost == min(brute_cost(places[:i + 1], fees, 30) for i in near)


def check(df, window=2048):
    lib = Tokenizer.from_file(tokens.default_path())
    want = defaultdict(int)
    for d, t in df.select("doc_id", "text").collect():
        want[d, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    rows = P.pack(df, window=window).collect()
    sequences = defaultdict(list)
    found = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append(r)
        found[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    # Exact round trip: pieces in sequence order give back each row's ids.
    got = defaultdict(int)
    for d, pieces in found.items():
        ids = []
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
            assert r.start == len(ids)
            ids += r.ids
            if len(ids) == r.doc_tokens:
                got[d, tuple(ids)] += 1
                ids = []
        assert not ids
    assert got == want
    return sequences


def test_round_trip(edge_docs, sf_docs):
    check(edge_docs)
    check(edge_docs, window=7)
    sequences = check(sf_docs.coalesce(1))
    used = sum(r.length for p in sequences.values() for r in p)
    assert used / (2048 * len(sequences)) > 0.97


def test_blocks_go_on(sf_docs, monkeypatch):
    packer = P._Packer(64, P.sentence_ends(tokens.default_path()), 1)
    rnd = np.random.default_rng(2)
    docs = [rnd.integers(0, 50000, rnd.integers(0, 300), dtype=np.uint32) for _ in range(60)]
    pieces = []
    for i, ids in enumerate(docs):
        packer.add(i, ids)
        if packer.size > 500:
            pieces += packer.pack(False)
    pieces += packer.pack(True)
    for i, ids in enumerate(docs):
        mine = [p for p in pieces if p[0] == i]
        assert np.concatenate([p[3] for p in mine]).tolist() == [*ids.tolist(), 1]
    assert [p[5] for p in pieces] == sorted(p[5] for p in pieces)


def test_empty_table(no_docs):
    assert P.pack(no_docs).count() == 0


def test_no_window_ends_inside_a_sentence_that_a_window_holds(sf_docs):
    ends = P.sentence_ends(tokens.default_path())
    cut_inside = 0
    for r in P.pack(sf_docs, window=256).collect():
        stop = r.start + r.length
        if stop < r.doc_tokens and not ends[r.ids[-1]]:
            cut_inside += 1
            # Such a cut lies in a sentence of over a window of ids.
            doc = sf_docs.filter(f"doc_id = {r.doc_id}").first()
            ids = np.array(tokens.Encoder(tokens.default_path()).ids(doc.text))
            marks = np.concatenate(([0], np.flatnonzero(ends[ids]) + 1, [len(ids) + 1]))
            k = np.searchsorted(marks, stop, side="right")
            assert marks[k] - marks[k - 1] > 256
    assert cut_inside < 40
