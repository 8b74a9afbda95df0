import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import spelling as P

SCHEMA = "doc_id long, text string, word string, n string, form string, key string"


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def brute(rows):
    """Occurrences one by one, and every edit of every word looked up."""
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{r[0]}:{run}".encode())
            if r[0] is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    letters = sorted({c for w in n for c in w})
    near = {w: [v for v in edits(w, letters) if v in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return [{"word": w, "form": form[w], "root": root(w), "n": n[w], "n_near": len(near[w]), "form_n": n[form[w]] if form[w] else None} for w in n]


def edge_rows():
    rnd = random.Random(6)
    alphabet = "aeinrstlo" + "éÀ÷ÿ"
    said = []
    for _ in range(60):
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 9)))
        said += [w] * rnd.choice([5, 30, 200])
        for _ in range(rnd.randint(0, 6)):
            i, c = rnd.randrange(len(w)), rnd.choice(alphabet)
            said += [rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w.upper()])] * rnd.choice([4, 5, 6, 40])
    long = "abcdefghij" * 4
    said += [long] * 50 + [long + "x"] * 6 + ["z" + long] * 5 + [long[:20] + "q" + long[21:]] * 7 + [long[1:] + "a"] * 5
    said += ["m" * 3000] * 30 + ["m" * 3001] * 5 + ["listen"] * 9 + ["silent"] * 9 + ["enlist"] * 9 + ["tinsel"] * 9 + ["inlets"] * 5
    # A chain of forms, and a tie between two that are equally frequent.
    said += ["chaina"] * 1300 + ["chainb"] * 210 + ["chainbb"] * 35 + ["chainbbb"] * 6 + ["tieword"] * 6 + ["tiewora"] * 40 + ["tieworz"] * 40
    rnd.shuffle(said)
    rows = []
    while said:
        k = rnd.randint(1, 60)
        rows.append((len(rows), rnd.choice([" ", "\n", "1", "€", "漢"]).join(said[:k])))
        said = said[k:]
    rows += [(7000, None), (7001, ""), (7002, "漢字 123"), (None, "nullidword " * 9), (None, None), (7003, "x" * 20000), rows[3], rows[3], (-5, "negative " * 600)]
    return [(*r, "clash", "clash", None, "k") for r in rows]


def test_against_brute_force_and_sql(spark, oracle, same):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    roots = {r["word"]: r["root"] for r in want}
    assert roots["chainbbb"] == "chaina" and next(r["form"] for r in want if r["word"] == "tieword") == "tiewora"
    same(P.variants(df), want)
    assert sorted(map(repr, map(sorted, (r.items() for r in oracle(P.SQL, df))))) == sorted(map(repr, map(sorted, (r.items() for r in want))))


def test_small_shards_and_pieces(spark, same):
    """Many levels deal, and whole paths (anagrams) are cut into pieces."""
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    same(P.variants(df, groups=3, shard=4), brute(rows))


def test_given_table(spark, sf_docs, same):
    same(P.variants(sf_docs), brute([(r.doc_id, r.text) for r in sf_docs.collect()]))


def test_empty_and_broken_text(spark, no_docs):
    assert P.variants(no_docs).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex(repeat('62726F6B656EFF776F72647373C3', 6)) AS string) AS text")
    assert sorted((r.word, r.n) for r in P.variants(broken).collect()) in ([("broken", 6), ("wordss", 6)], [("broken", 6)])


def test_one_letter_apart():
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 5))) for _ in range(200)] + [b"a" * 40, b"a" * 41, b"a" * 39 + b"b", b"b" * 32, b"b" * 33]
    for a in words:
        near = {w.encode() for w in edits(a.decode(), "ab")}
        assert all(P.one_apart(a, b) == (b in near) for b in words)
    size, letters = P._letters(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = P._verified(words, size, letters, words, size, letters, i, j)
    assert got.tolist() == [P.one_apart(words[a], words[b]) for a, b in zip(i, j)]


@pytest.mark.parametrize("groups", [1, 5, 14])
def test_counts_within_the_budget(groups):
    """Near words are one surplus and one deficit apart at most."""
    of = np.array([i % groups for i in range(256)])
    word = "garden"
    for other in edits(word, "abcé"):
        a, b = P._counts([word.encode("latin-1"), other.encode("latin-1")], of, groups)
        assert np.maximum(b - a, 0).sum() <= 1 and np.maximum(a - b, 0).sum() <= 1
