"""Operator 6 (native): placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table
(offset + j * skip); shards take turns claiming their first free slot until
the table is full. A row's key hashes to a slot and a broadcast of the table
(``table_size`` rows, a fixed bound) gives its shard. Adding or removing a
shard moves few slots. Only SQL functions are used, for the fill as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def hash60(text: Column) -> Column:
    """60 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards=SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard): ``table_size`` rows, filled by turns.

    ``table_size`` must be a prime above the number of shards; the fill folds
    over the slots in one row, so keep it under some ten thousand.
    """
    shards = list(shards)
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be distinct and not empty")
    if table_size <= len(shards) or any(table_size % p == 0 for p in range(2, int(table_size ** 0.5) + 1)):
        raise ValueError("table_size must be a prime above the number of shards")
    m, n = F.lit(table_size).cast("long"), len(shards)

    def order(name):
        offset = hash60(F.concat(F.lit("offset:"), name)) % m
        skip = hash60(F.concat(F.lit("skip:"), name)) % (m - 1) + 1
        return F.transform(F.sequence(F.lit(0).cast("long"), m - 1),
                           lambda j: ((offset + j * skip) % m).cast("int"))

    one = (spark.range(1).select(F.array(*[F.lit(s) for s in shards]).alias("names"))
           # Through explode, so that the orders are a value and not worked out anew in each turn.
           .select("names", F.explode(F.array(F.transform("names", order))).alias("prefs")))

    def claim(table, turn):
        shard = (turn % n).cast("int")
        free = F.filter(F.get(F.col("prefs"), shard), lambda s: F.get(table, s) < 0)
        # Bound once through a one-element array: the slot is not searched again per cell.
        return F.get(F.transform(F.array(F.get(free, F.lit(0))),
                                 lambda slot: F.transform(table, lambda v, i: F.when(i == slot, shard).otherwise(v))), F.lit(0))

    table = F.aggregate(F.sequence(F.lit(0), F.lit(table_size - 1)),
                        F.array_repeat(F.lit(-1), table_size), claim)
    return (one.select("names", table.alias("t"))
            .select("names", F.posexplode("t").alias("slot", "i"))
            .select("slot", F.get(F.col("names"), F.col("i")).alias("shard")))


def place(rows: DataFrame, key_col: str = "doc_id", shards=SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(key, slot, shard) per row. A null key is placed as the text 'null';
    equal keys go to one shard; an empty table gives no rows."""
    keyed = rows.select(rows[key_col].alias("key"))
    slot = (hash60(F.coalesce(F.col("key").cast("string"), F.lit("null"))) % table_size).cast("int")
    table = F.broadcast(lookup_table(rows.sparkSession, shards, table_size))  # table_size rows
    return keyed.withColumn("slot", slot).join(table, "slot").select("key", "slot", "shard")


SQL = f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS s FROM range({len(SHARDS)}) t(i)),
par AS (SELECT i, s, ('0x' || substr(md5('offset:' || s), 1, 15))::BIGINT % {TABLE_SIZE} AS o,
               ('0x' || substr(md5('skip:' || s), 1, 15))::BIGINT % {TABLE_SIZE - 1} + 1 AS k FROM names),
prefs AS (SELECT i, list((o + j * k) % {TABLE_SIZE} ORDER BY j) AS p FROM par, range({TABLE_SIZE}) r(j) GROUP BY i),
fill(t, slots, tab) AS (
  SELECT 0, -1::BIGINT, list_transform(range({TABLE_SIZE}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT t + 1, slot, tab[1:slot] || [i] || tab[slot + 2:]
  FROM (SELECT f.t, f.tab, prefs.i, list_filter(prefs.p, lambda x: f.tab[x + 1] < 0)[1] AS slot
        FROM fill f JOIN prefs ON prefs.i = f.t % {len(SHARDS)} WHERE f.t < {TABLE_SIZE})),
done AS (SELECT unnest(tab) AS i, generate_subscripts(tab, 1) - 1 AS slot FROM fill WHERE t = {TABLE_SIZE})
SELECT d.doc_id, CAST(d.slot AS BIGINT) AS slot, names.s AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
      FROM documents) d
JOIN done USING (slot) JOIN names ON names.i = done.i
"""
