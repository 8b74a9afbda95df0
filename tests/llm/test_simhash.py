import random
from collections import Counter

import xxhash
from tallyspark.llm import simhash as S
from tallyspark.llm.graph import components


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    bits = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        bits.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


def brute_components(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


def check(df):
    rows = df.select("doc_id", "text").collect()
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    root = brute_components({f for _, f in fps})
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in fps), key=repr)
    got = S.near_duplicates(df).select("doc_id", S.hex16("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_against_brute_force(edge_docs, sf_docs):
    check(edge_docs)
    check(sf_docs)


def test_empty_table(no_docs):
    assert S.near_duplicates(no_docs).count() == 0


def test_clusters_over_chunks(spark):
    """A bucket far larger than a chunk, and chains of links."""
    rnd = random.Random(1)
    fps = {rnd.getrandbits(64) for _ in range(100)}
    for centre in list(fps)[:3]:
        for _ in range(150):
            f = centre
            for _ in range(rnd.randint(1, 6)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = S.links(spark.createDataFrame(signed, "fp long"), chunk=16)
    root = brute_components(fps)
    found = {r[0] % 2 ** 64: r[1] % 2 ** 64 for r in components(edges).collect()}
    classes = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    assert classes({f: found.get(f, f) for f in fps}) == classes(root)


def test_blocks_cover_all_bits():
    for d in range(1, 7):
        assert sorted(i for s, w in S.blocks(d) for i in range(s, s + w)) == list(range(64))
