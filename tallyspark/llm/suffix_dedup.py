"""Operator 2: removal of byte strings that occur more than once.

1. Every string of ``length`` bytes is assigned to its anchor: the least-hashed
   64-byte gram in it, leftmost on ties. Equal strings have equal anchors at
   equal places, wherever they lie. One row per anchor is shuffled by its hash.
2. Strings of an anchor whose whole surroundings (all strings it owns, as one
   context) occur again are repeated. Of anchors with several contexts, each
   distinct context is fetched once, cut into 8-byte blocks counted from the
   anchor, and a suffix array over the blocks of many contexts is built in
   linear time by grouping. Suffixes that share ``length // 8 - 1`` blocks are
   neighbours in it; with the up to 7 bytes before and the rest behind, which
   are compared as one number, they show exactly which strings repeat.
3. The repeated strings' bytes are removed from each document.

Copies and contexts are counted by aggregates that combine in each task, and
anchors that hold a large share of all rows learn their counts by broadcast, so
no anchor is gathered before its size is known. The contexts of one with more
than ``HOT_CONTEXTS`` of them are split by what their strings must share:
strings at neighbouring places around the anchor all cover the bytes between,
so a few places at a time, contexts that agree on those bytes are an anchor of
their own. Each goes through step 2 again, until it is small enough for a
suffix array or a single place is left, where all its strings are one.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import cut
from tallyspark.llm.repetition import _scramble, _slices
from tallyspark.llm.suffix_array import suffix_array

LENGTH = 200
GRAM = 64
BLOCK = 8
# Distinct contexts of an anchor that are gathered in one task.
HOT_CONTEXTS = 1024
# Ranges of places that a hot anchor is split into.
FAN = 6
# An anchor with a larger share of the rows than 1/SHARE meets its count by
# broadcast: fewer than SHARE such anchors can exist.
SHARE = 4096
# Bytes of contexts whose suffix array is built together.
ARRAY_BYTES = 1 << 20
# Anchors of a task that are combined before they are shuffled.
ROUND = 1 << 18
# Places hashed at a time; they take the low 24 bits beside 40 bits of a hash.
STRIDE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(21).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes, by doubling."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, span = np.uint64(0x9E3779B97F4A7C15), 1
        part, out, done = _BYTE[data], None, 0
        while True:
            if width & span:
                if out is None:
                    out, done = part, span
                else:
                    m = n - done - span + 1
                    out, done = out[:m] * power + part[done:done + m], done + span
            if done == width:
                return _scramble(out)
            m = n - 2 * span + 1
            part = part[:m] * power + part[span:span + m]
            power, span = power * power, 2 * span


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last) of each anchor of the texts that end at
    ``ends`` in ``data``: its gram's hash and place, and the first and last
    start of the strings that it owns. Strings never cross an end."""
    found = []
    for at in range(0, max(len(data) - length + 1, 0), STRIDE):
        piece = data[at:at + STRIDE + length - 1]
        h = gram_hashes(piece, gram)
        width = length - gram + 1
        n, m = len(h) - width + 1, len(h)
        key = np.full(-(-m // width) * width, ~np.uint64(0))
        key[:m] = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
        rows = key.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
        start = np.arange(at, at + n)
        owner = np.searchsorted(ends, start, side="right")
        whole = start + length <= ends[owner]
        turn = np.flatnonzero(whole & np.concatenate(([True], (least[1:] != least[:-1]) | ~whole[:-1])))
        stop = np.flatnonzero(whole & np.concatenate(((least[1:] != least[:-1]) | ~whole[1:], [True])))
        place = (least[turn] & _LOW).astype(np.int64)
        found.append((h[place], place + at, turn + at, stop + at))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (
        np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [begin, end)."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _anchor_rows(length: int):
    """(key, text) -> (route, context, key, place, first, span, n): contexts
    that a task meets more than once in a round travel once, with their number; the
    ranges of the other holders travel merged, with n = 0."""
    import xxhash
    names = ["route", "context", "key", "place", "first", "span", "n"]

    def settle(parts: list[tuple]) -> pa.RecordBatch:
        h, context, key, place, first, span = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((context, h))
        h, context, key, place, first, span = (x[order] for x in (h, context, key, place, first, span))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (context[1:] != context[:-1])))
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(h)))
        # The rest are known to be repeated: merged ranges per document.
        rest = np.flatnonzero(~new)
        rest = rest[np.lexsort((first[rest], key[rest]))]
        k, b, e = key[rest], first[rest], first[rest] + span[rest]
        if len(rest):
            joined = (k[1:] == k[:-1]) & (b[1:] <= e[:-1] + 1)
            lead = np.flatnonzero(np.concatenate(([True], ~joined)))
            k, b, e = k[lead], b[lead], np.maximum.reduceat(e, lead)
        route = _scramble(k.astype(np.int64).view(np.uint64) + b.astype(np.uint64))
        zero = np.zeros(len(k), np.int64)
        cols = [np.concatenate((h[heads], route)).view(np.int64), np.concatenate((context[heads], route)).view(np.int64),
                np.concatenate((key[heads], k)), np.concatenate((place[heads], zero)).astype(np.int32),
                np.concatenate((first[heads], b)), np.concatenate((span[heads], e - b)), np.concatenate((n, zero))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            keys, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for data, offsets in _slices(batch.column(1)):
                h, place, first, last = anchors(data, offsets[1:], length)
                if len(h):
                    owner = np.searchsorted(offsets[1:], first, side="right")
                    view = data.tobytes()
                    context = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64)
                    parts.append((h, context, keys[at + owner], place - first, first - offsets[owner], last - first))
                    held += len(h)
                at += len(offsets) - 1
                if held >= ROUND:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)
    return run


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, text, wants) -> one row per wanted context, with its bytes."""
    for batch in batches:
        out = []
        for key, text, wants in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw = text.as_py() or b""
            for w in wants.as_py():
                out.append((w["route"], w["hot"], key, w["place"], w["first"], raw[w["first"]:w["first"] + w["span"] + length], w["needed"]))
        if out:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["route", "hot", "key", "place", "first", "raw", "needed"])


def _by_route(rows: DataFrame, stats: DataFrame, count: str) -> DataFrame:
    """``rows`` with the columns of ``stats``, which has a row per route and is
    read from files; routes without one go. A route with a large share of the
    rows meets its row by broadcast and isn't shuffled into one task."""
    total = stats.agg(F.sum(count)).first()[0] or 0
    heavy = F.broadcast(stats.filter(F.col(count) * SHARE > total))
    others = rows.join(heavy.select("route"), "route", "left_anti").join(stats, "route")
    return rows.join(heavy, "route").unionByName(others)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows (route, context, key, first, n, ...) with ``same``, the number of
    times that their context occurs, ``variants``, their route's number of
    contexts, and ``holder``, true for one row of each context."""
    mark = F.xxhash64("key", "first")
    kinds = cut(rows.groupBy("route", "context").agg(F.sum("n").alias("same"), F.min(mark).alias("least")))
    kinds = _by_route(kinds, cut(kinds.groupBy("route").agg(F.count(F.lit(1)).alias("variants"))), "variants")
    return cut(rows.join(kinds, ["route", "context"]).withColumn("holder", mark == F.col("least")).drop("least"))


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts whose anchor lies ``lo`` to ``hi`` bytes into their strings ->
    up to ``FAN`` narrower ones, routed by the bytes that all strings of the
    narrower range cover."""
    import xxhash
    names = ["route", "lo", "hi", "key", "place", "first", "raw", "needed"]
    kinds = [pa.uint64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.uint64(), pa.int64()]
    for batch in batches:
        out = []
        for route, lo, hi, key, place, first, raw, needed in zip(*(batch.column(c).to_pylist() for c in names)):
            step = -(-(hi - lo + 1) // FAN)
            for a in range(lo, hi + 1, step):
                b = min(a + step - 1, hi)
                begin, last = max(place - b, 0), min(place - a, len(raw) - length)
                if begin > last:
                    continue
                piece = raw[begin:last + length]
                shared = xxhash.xxh3_64_intdigest(raw[place - a:place + length - b], (route + a) % 2 ** 64)
                out.append((shared, a, b, key, place - begin, first + begin, piece, needed, xxhash.xxh3_64_intdigest(piece), 1))
        if out:
            cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in cols], [*names, "context", "n"])


def _cooled(hot: DataFrame, length: int, hot_contexts: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of hot anchors, split until none is hot: (ranges of strings
    known to be repeated, contexts for a suffix array)."""
    sure, cold = [], []
    hot = hot.select("*", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))
    columns = ["route", "key", "place", "first", "raw", "needed"]
    while not hot.isEmpty():
        pieces = cut(hot.mapInArrow(functools.partial(_parts, length=length), "route long, lo int, hi int, key long, place int, first long, "
                                    "raw binary, needed boolean, context long, n long"))
        marked = _marked(pieces)
        sure.append(marked.filter("needed AND same > 1").select("key", F.col("first").alias("begin"), (F.col("first") + F.length("raw")).alias("end")))
        wanted = marked.filter("holder AND variants > 1").withColumn("needed", F.expr("needed AND same = 1"))
        cold.append(wanted.filter(F.col("variants") <= hot_contexts).select(columns))
        hot = wanted.filter(F.col("variants") > hot_contexts).select(*columns, "lo", "hi")
    return sure, cold


def repeated_starts(contexts: list[bytes], places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of every string of ``length`` bytes that starts in one
    of the contexts and again in another. Equal strings must lie equally to
    their contexts' ``places`` (modulo the block size)."""
    full = length // BLOCK - 1
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lead = places % BLOCK
    blocks = np.maximum(sizes - lead, 0) // BLOCK
    # One symbol per block, and one that ends each context.
    first = np.cumsum(blocks + 1) - (blocks + 1)
    inner = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    origin = np.repeat(base + lead, blocks) + inner * BLOCK
    value = np.zeros(len(origin), np.uint64)
    for t in range(BLOCK):
        value = (value << np.uint64(8)) | data[origin + t]
    symbols = np.ones(int((blocks + 1).sum()) + 1, np.int64)
    symbols[np.repeat(first, blocks) + inner] = np.unique(value, return_inverse=True)[1] + 2
    symbols[-1] = 0
    order = suffix_array(symbols.tolist())
    # Neighbours that share the first ``full`` symbols are in one interval.
    padded = np.concatenate((symbols, np.zeros(full, np.int64)))
    same = np.arange(1, len(order))
    for t in range(full):
        same = same[padded[order[same] + t] == padded[order[same - 1] + t]]
    new = np.ones(len(order), bool)
    new[same] = False
    interval = np.empty(len(order), np.int64)
    interval[order] = np.cumsum(new)
    # Every start, as the block start at or after it and the bytes before that.
    starts = np.maximum(sizes - length + 1, 0)
    who = np.repeat(np.arange(len(contexts)), starts)
    p = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    before = (lead[who] - p) % BLOCK
    block = (p + before - lead[who]) // BLOCK
    ends = np.zeros(len(p), np.uint64)
    at = base[who] + p
    for t in range(BLOCK):
        ahead = t < before
        ends = (ends << np.uint64(8)) | data[np.where(ahead, at + t, at + full * BLOCK + t)]
    group = interval[first[who] + block] * BLOCK + before
    order = np.lexsort((ends, group))
    twin = (group[order[1:]] == group[order[:-1]]) & (ends[order[1:]] == ends[order[:-1]])
    hit = np.zeros(len(p), bool)
    hit[order[1:][twin]] = True
    hit[order[:-1][twin]] = True
    return who[hit], p[hit]


def _ranges(keys, firsts, who, starts, length) -> pa.RecordBatch:
    """(key, begin, end) of the starts' strings, merged per context."""
    step = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(who) else np.empty(0, np.int64)
    last = np.append(step[1:] - 1, len(who) - 1) if len(step) else step
    k, f = keys[who[step]], firsts[who[step]]
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(f + starts[step]), pa.array(f + starts[last] + length)], ["key", "begin", "end"])


def _solve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by route -> ranges of the needed ones' repeated strings."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        contexts = table.column("raw").to_pylist()
        who, starts = repeated_starts(contexts, table.column("place").to_numpy().astype(np.int64), length)
        needed = table.column("needed").to_numpy()[who]
        yield _ranges(table.column("key").to_numpy(), table.column("first").to_numpy(), who[needed], starts[needed], length)

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.nbytes
            if size < ARRAY_BYTES:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        route = table.column("route").to_numpy()
        # Whole routes only; the last one may go on.
        whole = len(table) if batch is None else int(np.flatnonzero(route != route[-1])[-1] + 1) if (route != route[-1]).any() else 0
        sizes = np.cumsum(np.fromiter((len(c) for c in table.column("raw").to_pylist()), np.int64, len(table)))
        at = 0
        while at < whole:
            to = min(whole, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ARRAY_BYTES))))
            while to < whole and route[to] == route[to - 1]:
                to += 1
            yield from settle(table.slice(at, to - at).combine_chunks())
            at = to
        held = table.slice(whole).to_batches() if whole < len(table) else []
        size = 0 if whole else -size  # a route beyond the size: gather on, twice as much


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rest, text, ranges) -> (rest, kept, n_bytes, n_removed, n_spans)."""
    for batch in batches:
        kept, counts = [], []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            raw = text.as_py() or b""
            begin = end = np.empty(0, np.int64)
            if ranges.is_valid:
                flat = ranges.values.flatten()
                begin, end = merged(flat[0].to_numpy(zero_copy_only=False), flat[1].to_numpy(zero_copy_only=False))
            pieces, at = [], 0
            for b, e in zip(begin.tolist(), end.tolist()):
                pieces.append(raw[at:b])
                at = e
            pieces.append(raw[at:])
            kept.append(b"".join(pieces))
            counts.append((len(raw), len(raw) - len(kept[-1]), len(begin)))
        cols = list(zip(*counts)) if counts else [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in cols]],
                                         ["rest", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(rest, kept, n_bytes, n_removed, n_spans) per row: ``rest`` is a struct
    of all columns but the text, ``kept`` the remaining bytes.

    Every byte of a string of ``length`` bytes that starts anywhere else too,
    in the same text or another, is removed; strings are judged on the input.
    Texts are bytes, whether valid UTF-8 or not.
    Null and empty texts stay empty; of repeated rows each one is a document,
    so all their long texts go. An empty table gives no rows.
    """
    if length % BLOCK or length < GRAM + BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK}, above {GRAM}")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    others = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    keyed = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("key"),
                        F.struct(*others).alias("rest"), text.alias("text"))
    rows = cut(keyed.select("key", "text").mapInArrow(
        _anchor_rows(length), "route long, context long, key long, place int, first long, span long, n long"))
    as_range = ["key", F.col("first").alias("begin"), (F.col("first") + F.col("span") + length).alias("end")]
    single = rows.filter("n > 0")
    totals = cut(single.groupBy("route").agg(F.sum("n").alias("total")).filter("total > 1"))
    marked = _marked(cut(_by_route(single, totals, "total").drop("total")))
    wanted = marked.filter("holder AND variants > 1").select("key", F.struct(
        "route", (F.col("variants") > hot_contexts).alias("hot"), "place", "first", "span", (F.col("same") == 1).alias("needed")).alias("want"))
    lists = wanted.groupBy("key").agg(F.collect_list("want").alias("wants"))  # by document: bounded by its length
    contexts = cut(keyed.join(lists.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "text", "wants").mapInArrow(
        functools.partial(_fetch, length=length),
        "route long, hot boolean, key long, place int, first long, raw binary, needed boolean"))
    known, cold = _cooled(contexts.filter("hot").drop("hot"), length, hot_contexts)
    gathered = functools.reduce(DataFrame.unionByName, cold, contexts.filter("NOT hot").drop("hot"))
    found = gathered.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(
        functools.partial(_solve, length=length), "key long, begin long, end long")
    sure = functools.reduce(DataFrame.union, known, rows.filter("n = 0").select(as_range).union(marked.filter("same > 1").select(as_range)))
    ranges = sure.union(found).groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = keyed.join(ranges, F.col("key") == F.col("k"), "left").select("rest", "text", "ranges")
    kinds = (("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()))
    return joined.mapInArrow(_removed, T.StructType([joined.schema["rest"], *[T.StructField(*k) for k in kinds]]))


# The same in SQL over hexadecimal text, for tables whose doc_id is unique.
SQL = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT doc_id, n, k, substr(h, CAST(1024 * k + 1 AS BIGINT), {1024 + 2 * LENGTH - 2}) AS g
         FROM (SELECT *, unnest(range(0, (n + 511) // 512)) AS k FROM d WHERE n >= {LENGTH})),
p AS (SELECT doc_id, 512 * k + j AS i, md5(substr(g, CAST(2 * j + 1 AS BIGINT), {2 * LENGTH})) AS m
      FROM part, range(0, 512) o(j) WHERE 512 * k + j + {LENGTH} <= n),
s AS (SELECT doc_id, i FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)),
t AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM s),
u AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
r AS (SELECT doc_id, run, min(i) AS b, max(i) + {LENGTH} AS e FROM u GROUP BY doc_id, run),
k AS (SELECT doc_id, run, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a FROM r),
j AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY run) AS before,
             max(e) AS e, sum(e - b) AS gone, count(*) AS runs FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(before, '') || substr(h, CAST(2 * coalesce(e, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""
