import hashlib
import random
import re
import zlib

import pytest

from tallyspark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, a string, pos string, hi string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes by dictionaries of whole prefixes and a walk over ancestors."""
    own = {}
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            pair = (role or "", text or "")
            tie = hashlib.sha256(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), tie, pair))
    own = {c: [pair for _, _, pair in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, ends = {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(who) - 1) * words
    return [dict(zip(COLUMNS, (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                               hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())))
            for p, m in members.items()]


def edge_rows():
    rnd = random.Random(8)
    say = lambda: " ".join(rnd.choice(["a", "bb", "Ünï", "c\td", ""]) for _ in range(rnd.randint(0, 4)))
    rows = []
    for c in range(0, 90):
        rows += [(c, t, rnd.choice(["user", None]), rnd.choice([say(), "hello there", None])) for t in range(rnd.randint(1, 4))]
    # Long ones that part late, at and around the ends of blocks, and copies.
    long = [("user", f"turn {i % 7}") for i in range(70)]
    for c, n in ((200, 70), (220, 70), (221, 40), (240, 41), (260, 16), (280, 17), (300, 8), (320, 7)):
        rows += [(c, t, *long[t]) for t in range(n)] + ([(c, 99, "user", "other")] if c % 3 else [])
    rows += [(c, t, "user", "same") for c in range(400, 460) for t in range(3)]
    # Fewer turns than are lent; no base; ties, null turns, repeated rows; no id.
    rows += [(501, 0, "x", "alone"), (502, 0, "x", "alone"), (503, 0, "x", "alone"), (504, 0, "x", "y"), (504, 1, "x", "y")]
    rows += [(520, 3, "u", "b"), (520, 3, "u", "a"), (520, None, "u", "z"), (520, None, "u", "c"), (520, 3, "u", "a"), (520, -1, "u", "m")]
    rows += [(None, 0, "u", "lost"), (None, None, None, None), (1 << 62, 5, "u", "far")]
    return [(*r, "clash", "clash", None) for r in rows]


def test_against_brute_force_and_sql(spark, oracle, same):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert sum(r["n_convs"] > 1 and r["depth"] > 32 for r in want) > 5
    same(P.trie(df), want)
    same(P.trie(df, run=2).select(*COLUMNS), want)
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in oracle(P.SQL, df, "conversations")))) == sorted(
        repr(tuple(r[c] for c in COLUMNS)) for r in want)


def test_one_conversation_over_many_ranges(spark, same):
    """A conversation of most rows is numbered across partitions."""
    rnd = random.Random(2)
    rows = [(7, t, "u", str(rnd.random()), *[""] * 3) for t in range(250)] + [(c, 0, "u", "hi", *[""] * 3) for c in range(20, 120)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    placed = P.positions(P.turn_ids(df), 8).filter("conv_id = 7")
    assert sorted(r.pos for r in placed.collect()) == list(range(250))
    got = {(r.depth, r.conv_id): r for r in P.trie(df, run=4).collect()}
    want = brute(rows)
    assert len(got) == len({(r["depth"], r["conv_id"]) for r in want}) == len(want)
    for r in want:
        assert got[r["depth"], r["conv_id"]].asDict() == r


def test_empty(spark):
    assert P.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "")], SCHEMA)).count() == 0


def test_key_list_of_a_crowded_node_is_pieced(spark, monkeypatch):
    rows = [(c * 20, 0, "u", "same", *[""] * 3) for c in range(2000)]
    monkeypatch.setattr(P, "PIECE", 7)
    got = {r.depth: r for r in P.trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    joined = ",".join(str(r[0]) for r in rows)
    assert got[1].ends_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[0].ends_sha256 == P.EMPTY


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_table(spark, same, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    same(P.trie(df), brute([tuple(r) for r in df.collect()]))
