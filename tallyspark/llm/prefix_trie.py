"""Operator 13: the prefix trie of conversations, by ROLLUP over turn-id columns.

A conversation's turns are laid out in rows of ``WIDTH`` positional turn-id
columns. GROUP BY the prior block's node and ROLLUP over the columns gives
every prefix of a row at once, and ``grouping_id`` tells its depth; a longer
conversation goes on in further rows, keyed by the node that its turns so far
lead to, so all blocks of all conversations are rolled up together.

A node's key is the XOR of 128-bit hashes of (position, turn id) along its
path: prefixes of a conversation of any length combine without being gathered.
Sums over subtrees need no walk either. Each node is owned by its smallest
member, which then owns every node below on its own path; so a subtree's sum
over nodes is a sum over the conversations that start with its top, which a
second ROLLUP gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut
from tallyspark.llm.mixing import word_count

# Fixed by the contract: turns taken from another conversation, and which one.
BASES = 20
HEADS = 4
# Turn-id columns in a row; rows whose prefix is found by one window.
WIDTH = 8
RUN = 1024
# Ids joined in one piece of a node's list before the piece is shuffled.
PIECE = 512
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, w): 120 bits of the SHA-256 of role and text, and
    the text's words. Rows without a conversation are left out."""
    role, text = F.coalesce(rows["role"], F.lit("")), F.coalesce(rows["text"], F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return rows.filter(rows["conv_id"].isNotNull()).select(
        rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].alias("turn"),
        digest.alias("digest"), word_count(text).alias("w")).select(
        "conv_id", "turn", part(1).alias("a"), part(16).alias("b"), "w")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, with their partition and their place among
    its rows of the conversation."""
    here, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        size = np.diff(np.append(edge, len(conv)))
        seq = np.arange(len(conv)) - np.repeat(edge, size)
        if conv[0] == last:
            seq[:size[0]] += n
        last, n = conv[-1], int(seq[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv_id", "a", "b", "w")], pa.array(np.full(len(conv), here, np.int32)), pa.array(seq)],
            ["conv_id", "a", "b", "w", "part", "seq"])


def positions(ids: DataFrame, parts: int) -> DataFrame:
    """(conv_id, pos, a, b, w): each turn's place in its conversation.

    Rows are dealt in ranges, so a conversation of any length is spread; what
    of it lies in earlier ranges is added from one row per range."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b"]
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "a", "b", "w")
    placed = cut(dealt.mapInArrow(_numbered, "conv_id long, a long, b long, w long, part int, seq long"))
    ranges = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"),
                                        F.max_by("seq", F.struct("conv_id", "seq")).alias("seq"))
    goes_on, carried, before = [], None, 0
    for r in sorted(ranges.collect(), key=lambda r: r.part):  # one row per partition
        if r.first == carried:
            goes_on.append((r.part, r.first, before))
        before = r.seq + 1 + (before if r.first == r.last == carried else 0)
        carried = r.last
    added = ids.sparkSession.createDataFrame(goes_on, "p int, c long, before long")
    return placed.join(F.broadcast(added), (F.col("part") == F.col("p")) & (F.col("conv_id") == F.col("c")), "left").select(
        "conv_id", (F.col("seq") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "w")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, w, len): the first h turns of conversation
    c - c % 20, then c's own turns after its first h (h = crc32(c) % 4). A
    conversation left without turns is one row with a null id."""
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{k}")
    convs = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n"), *[at(k, c) for k in range(HEADS - 1) for c in "abw"]))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.array(*[
        F.struct(F.lit(k).cast("long").alias("pos"), *[F.col(f"{c}{k}").alias(c) for c in "abw"]) for k in range(HEADS - 1)]).alias("head"))
    own = convs.select("conv_id", "n", h.alias("h")).withColumn("b", F.col("conv_id") - F.col("conv_id") % BASES)
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).cast("long")
    plan = cut(own.join(base, F.col("b") == F.col("base"), "left").withColumn("taken", taken).select(
        F.col("conv_id").alias("c"), "h", "taken", "head",
        (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    lent = plan.select(F.col("c").alias("conv_id"), "len", F.explode(F.slice("head", 1, F.col("taken").cast("int"))).alias("t")).select(
        "conv_id", "t.*", "len")
    kept = turns.join(plan.select("c", "h", "taken", "len"), F.col("conv_id") == F.col("c")).filter(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "w", "len")
    none = F.lit(None).cast("long")
    bare = plan.filter("len = 0").select(F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("pos"),
                                         none.alias("a"), none.alias("b"), none.alias("w"), "len")
    return lent.unionByName(kept).unionByName(bare)


def _step(seed: int, slot: int) -> str:
    """What a turn adds to the key of its path; 0 where there is none."""
    return f"if(t{slot} IS NULL, 0L, xxhash64({seed}, block * {WIDTH} + {slot}, t{slot}.a, t{slot}.b))"


def _path(seed: int, *start: str) -> str:
    """``start`` and all turns of a row."""
    return " ^ ".join([*start, *[_step(seed, j) for j in range(WIDTH)]])


def blocks(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(conv_id, block, len, hi, lo, pre, words, t0..): one row of turn-id
    columns per block, the key of the node before it, the words up to there and
    the words in it. Prefixes are taken within runs of ``run`` blocks and over
    the runs, so no window holds a whole long conversation."""
    slot = F.col("pos") % WIDTH
    wide = rows.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).alias("block")).agg(
        F.max("len").alias("len"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"),
        *[F.max(F.when(slot == j, F.col(c))).alias(f"{c}{j}") for j in range(WIDTH) for c in "abw"])
    turn = lambda j: F.when(F.col(f"a{j}").isNotNull(), F.struct(*[F.col(f"{c}{j}").alias(c) for c in "abw"]))
    wide = wide.select("conv_id", "block", "len", "words", F.floor(F.col("block") / run).alias("run"),
                       *[turn(j).alias(f"t{j}") for j in range(WIDTH)])
    wide = cut(wide.select("*", F.expr(_path(1)).alias("x"), F.expr(_path(2)).alias("y")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inside = before(Window.partitionBy("conv_id", "run").orderBy("block"))
    sums = lambda w, x, y, n: (F.coalesce(F.bit_xor(x).over(w), zero), F.coalesce(F.bit_xor(y).over(w), zero),
                               F.coalesce(F.sum(n).over(w), zero))
    hi, lo, pre = sums(inside, "x", "y", "words")
    near = wide.withColumns({"hi": hi, "lo": lo, "pre": pre})
    over = before(Window.partitionBy("conv_id").orderBy("run"))
    far = wide.groupBy("conv_id", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("words").alias("words"))
    far_hi, far_lo, far_pre = sums(over, "x", "y", "words")
    far = far.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), far_hi.alias("fx"), far_lo.alias("fy"),
                     far_pre.alias("fw")).filter("r > 0")
    return cut(near.join(far, (F.col("conv_id") == F.col("c")) & (F.col("run") == F.col("r")), "left").select(
        "conv_id", "block", "len", F.col("hi").bitwiseXOR(F.coalesce("fx", zero)).alias("hi"),
        F.col("lo").bitwiseXOR(F.coalesce("fy", zero)).alias("lo"), (F.col("pre") + F.coalesce("fw", zero)).alias("pre"),
        "words", *[f"t{j}" for j in range(WIDTH)]))


def rolled(rows: DataFrame, *aggregates: str) -> DataFrame:
    """All prefixes of all rows of ``blocks`` in one ROLLUP: key (hi, lo), key
    of the parent (phi, plo), depth, words of the last turn (w), words before
    it (pre) and the aggregates, which are SQL."""
    turns = [f"t{j}" for j in range(WIDTH)]
    # A prefix ends at a turn that is there; a block's own start is a node of
    # the block before, but for the root.
    there = " ".join(f"WHEN {j + 1} THEN t{j} IS NOT NULL" for j in range(WIDTH))
    nodes = rows.sparkSession.sql(
        f"""SELECT * FROM (
              SELECT block, hi, lo, pre, {", ".join(turns)}, {WIDTH} - bit_count(grouping_id()) AS d, {", ".join(aggregates)}
              FROM {{rows}} GROUP BY block, hi, lo, pre, ROLLUP({", ".join(turns)}))
            WHERE CASE d WHEN 0 THEN block = 0 {there} END""", rows=rows)
    # Columns that are rolled up are null and add nothing to the key.
    last = lambda f: f"CASE d {' '.join(f'WHEN {j + 1} THEN {f(j)}' for j in range(WIDTH))} ELSE 0L END"
    own, words = last(lambda j: f"t{j}.w"), " + ".join(f"coalesce(t{j}.w, 0L)" for j in range(WIDTH))
    hi, lo = _path(1, "hi"), _path(2, "lo")
    return nodes.selectExpr(
        f"{hi} AS hi", f"{lo} AS lo", f"{hi} ^ {last(lambda j: _step(1, j))} AS phi", f"{lo} ^ {last(lambda j: _step(2, j))} AS plo",
        f"block * {WIDTH} + d AS depth", f"{own} AS w", f"pre + {words} - {own} AS pre", *[a.rsplit(" ", 1)[1] for a in aggregates])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id -> (hi, lo, first id, ids joined by commas)."""
    for batch in batches:
        hi, lo, ids = (batch.column(i).to_numpy() for i in range(3))
        if not len(ids):
            continue
        new = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
        starts = [s for a, b in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(ids)]) for s in range(a, b, PIECE)]
        text = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in zip(starts, [*starts[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([pa.array(hi[starts]), pa.array(lo[starts]), pa.array(ids[starts]), pa.array(text, pa.binary())],
                                         ["hi", "lo", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id -> the SHA-256 of each node's list.
    Pieces stream through the hash; no list is held."""
    key, state = None, None
    out = pa.schema([("ehi", pa.int64()), ("elo", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        done = []
        for hi, lo, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (hi, lo) == key:
                state.update(b"," + ids)
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (hi, lo), hashlib.sha256(ids)
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in done], out)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*key, state.hexdigest())))], out)


def end_digests(rows: DataFrame, parts: int) -> DataFrame:
    """(ehi, elo, digest) of the nodes where conversations end. Ids are sorted
    in ranges and joined there, so a node where very many end is one task's
    work only as a stream of text (a SHA-256 has no other order)."""
    end = F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / WIDTH)
    ends = rows.filter(F.col("block") == end).selectExpr(f"{_path(1, 'hi')} AS hi", f"{_path(2, 'lo')} AS lo", "conv_id")
    pieces = ends.repartitionByRange(parts, "hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(
        _pieces, "hi long, lo long, first long, ids binary")
    return pieces.repartition(parts, "hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(
        _digests, "ehi long, elo long, digest string")


def trie(conversations: DataFrame, run: int = RUN) -> DataFrame:
    """One row per node (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256) of the trie of rebuilt conversations.

    Turns are ordered by ``turn``, null first; turns of one number by the
    SHA-256 of length of role, colon, role and text. Repeated rows are turns of
    their own. Null roles and texts are empty; rows without a conv_id belong
    to no conversation; a conversation left without turns is a member of the
    root. An empty table has no node. Other columns are ignored.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks(rebuilt(positions(turn_ids(conversations), parts)), run)
    found = cut(rolled(rows, "count(*) AS n_convs", "min(conv_id) AS conv_id"))
    kids = found.filter("depth > 0").groupBy(F.col("phi").alias("khi"), F.col("plo").alias("klo")).agg(F.count("*").alias("n_children"))
    same = lambda hi, lo: (F.col("hi") == F.col(hi)) & (F.col("lo") == F.col(lo))
    nodes = cut(found.join(kids, same("khi", "klo"), "left").drop("khi", "klo").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # What each conversation owns: the nodes whose smallest member it is.
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(
        F.sum("w").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    words = rows.groupBy("conv_id").agg(F.sum("words").alias("words"))
    each = cut(words.join(owned, F.col("conv_id") == F.col("c"), "left").select(
        F.col("conv_id").alias("c"), (F.col("words") - F.coalesce("own", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    sums = rolled(rows.join(each, F.col("conv_id") == F.col("c")), "sum(shared) AS shared", "sum(leaf) AS n_leaves").select(
        F.col("hi").alias("shi"), F.col("lo").alias("slo"), "shared", "n_leaves")
    full = nodes.join(sums, same("shi", "slo")).join(end_digests(rows, parts), same("ehi", "elo"), "left")
    mine = each.select("c", F.col("shared").alias("mine"))
    full = full.join(mine, F.col("conv_id") == F.col("c"))
    # The root's children take its conversation from here; keys that match
    # nothing are spread.
    root = nodes.filter("depth = 0").select("conv_id").first()
    deep = F.col("depth") > 1
    parents = nodes.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("conv_id").alias("above"))
    full = full.withColumns({"uphi": F.when(deep, F.col("phi")), "uplo": F.when(deep, F.col("plo")).otherwise(F.col("lo"))})
    full = full.join(parents, (F.col("uphi") == F.col("ahi")) & (F.col("uplo") == F.col("alo")), "left")
    parent = F.when(deep, F.col("above")).when(F.col("depth") == 1, F.lit(root and root.conv_id).cast("long"))
    return full.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("shared") - F.col("mine") - (F.col("n_convs") - 1) * F.col("pre")).cast("long").alias("saved_tokens"),
        F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"))


SQL = """
WITH RECURSIVE
bits AS (SELECT list(t ORDER BY b) AS tab FROM (
  SELECT b, list_reduce(list_concat([b], range(8)), lambda a, k:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS t FROM range(256) r(b))),
turns AS (SELECT conv_id, row_number() OVER w AS pos, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
          FROM conversations WHERE conv_id IS NOT NULL
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))),
hs AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
         lambda a, c: xor(tab[(xor(a, c) & 255) + 1], a // 256)), 4294967295) % 4 AS h
       FROM (SELECT DISTINCT conv_id FROM turns), bits),
own AS (SELECT conv_id, list({'t': t, 'n': words} ORDER BY pos) AS l FROM turns GROUP BY 1),
built AS (SELECT hs.conv_id, list_concat(coalesce(b.l[1:h], []), own.l[h + 1:]) AS p
          FROM hs JOIN own USING (conv_id) LEFT JOIN own b ON b.conv_id = hs.conv_id - hs.conv_id % 20),
pre AS (SELECT conv_id, d, len(p) AS n, p[1:d] AS k, CASE WHEN d > 0 THEN p[d].n ELSE 0 END AS w
        FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM built)),
nodes AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
          FROM pre GROUP BY k, d),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
below AS (SELECT k[1:a] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * w) AS saved
          FROM (SELECT *, unnest(range(depth + 1)) AS a FROM whole) GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs,
       CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below USING (k) LEFT JOIN nodes u ON w.depth > 0 AND u.k = w.k[1:w.depth - 1]
"""
