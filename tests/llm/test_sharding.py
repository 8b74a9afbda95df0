import pytest
from tallyspark.llm import sharding as S


def brute_table(shards, m):
    import hashlib
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    orders = [[(h("offset:" + s) % m + j * (h("skip:" + s) % (m - 1) + 1)) % m for j in range(m)] for s in shards]
    at, table, filled = [0] * len(shards), [None] * m, 0
    while True:
        for i, s in enumerate(shards):
            while table[orders[i][at[i]]] is not None:
                at[i] += 1
            table[orders[i][at[i]]] = s
            filled += 1
            if filled == m:
                return table


@pytest.mark.parametrize("m,n", [(11, 3), (101, 7)])
def test_table_against_brute_force(spark, m, n):
    shards = [f"n{i}" for i in range(n)]
    got = {r.slot: r.shard for r in S.lookup_table(spark, shards, m).collect()}
    assert [got[i] for i in range(m)] == brute_table(shards, m)


def test_production_table_and_rows(spark, edge_docs):
    table = brute_table(list(S.SHARDS), S.TABLE_SIZE)
    rows = S.place(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(table[r.slot] == r.shard for r in rows)


def test_few_slots_move_when_a_shard_goes(spark):
    a = {r.slot: r.shard for r in S.lookup_table(spark, ["a", "b", "c", "d"], 499).collect()}
    b = {r.slot: r.shard for r in S.lookup_table(spark, ["a", "b", "c"], 499).collect()}
    moved = sum(a[i] != b[i] for i in a if a[i] != "d")
    assert moved < 0.15 * 499


def test_bad_tables_are_refused(spark, no_docs):
    for shards, m in ((["a", "a"], 11), (["a", "b"], 10), ([], 11)):
        with pytest.raises(ValueError):
            S.lookup_table(spark, shards, m)
    assert S.place(no_docs).count() == 0
