import re

from tallyspark.llm import repetition as R

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    seen, dup_lines, dup_chars, lines = set(), 0, 0, 0
    chars = lambda b: sum(len(w.decode()) for w in WORD.findall(b))
    for line in raw.split(b"\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_chars += chars(line)
            seen.add(line)

    def covered(n, first):
        places, met = {}, set()
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        for i, g in enumerate(grams):
            places.setdefault(g, []).append(i)
        for g, at in places.items():
            for i in at if first and len(at) > 1 else at[1:]:
                met.update(range(i, i + n))
        return met
    total = max(chars(raw), 1)
    out = {"n_words": len(words), "word_chars": chars(raw), "n_symbols": len(re.findall(rb"[#*$%&|<>]", raw)),
           "n_dup_lines": dup_lines, "n_repeat_words": len(covered(3, True)),
           "share_lines": dup_lines / max(lines, 1), "share_line_chars": dup_chars / total}
    limits = {5: 0.15, 7: 0.13, 10: 0.10}
    for n in limits:
        out[f"share_{n}"] = sum(len(words[i].decode()) for i in covered(n, False)) / total
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = not out["base_failed"] and out["share_lines"] <= .3 and out["share_line_chars"] <= .2 and all(
        out[f"share_{n}"] <= m for n, m in limits.items())
    return out


def test_against_brute_force(edge_docs, sf_docs, same):
    for df in (edge_docs, sf_docs):
        rows = df.select("doc_id", "text").collect()
        same(R.repetition(df), [{"doc_id": r[0], **brute(r[1])} for r in rows])


def test_slices_do_not_change_results(edge_docs, monkeypatch):
    import numpy as np
    texts = [(r[0] or "").encode() for r in edge_docs.select("text").collect()]
    whole = R.measure(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    alone = [R.measure(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    for c in R.COLUMNS + R.SHARES:
        assert [x[c][0] for x in alone] == list(whole[c]), c


def test_repeats_survives_key_collisions():
    import numpy as np
    key = np.array([5, 5 + 2 ** 3, 5, 6, 2 ** 3 + 5, 7], np.uint64)
    any_, later = R._repeats(key)
    assert any_.tolist() == [True, True, True, False, True, False]
    assert later.tolist() == [False, False, True, False, True, False]


def test_empty_table(no_docs):
    assert R.repetition(no_docs).count() == 0


def test_against_sql(sf_docs, oracle, same):
    same(R.repetition(sf_docs), oracle(R.SQL, sf_docs.select("doc_id", "text")))


def test_the_rules_reject_beyond_the_base_rule(spark):
    """A passage of a quarter of the words said twice passes the base rule."""
    unique = [f"word{i}" for i in range(400)]
    text = " ".join(unique[:100] + unique[100:180] + unique[180:300] + unique[100:180])
    df = spark.createDataFrame([(1, text), (2, " ".join(unique))], "doc_id long, text string")
    got = {r.doc_id: r for r in R.repetition(df).collect()}
    assert not got[1].base_failed and not got[1].kept and got[2].kept
