"""Operator 8: document scores by masked pseudo-likelihood.

A small network predicts every word from the words on both sides: embeddings
of the window's words, weighted by place, go through tanh to a softmax over
classes and one over the ids of the class. A document's score is the sum of
its words' conditional log-probabilities.

The network knows ``IDS`` ids, whatever the corpus: words are hashed into
``BUCKETS``, the ``IDS - RARE`` most frequent buckets have an id of their own,
the rest share ``RARE`` ids. Within its id a word has its exact share of the
id's occurrences, from a table with the count of every word of the corpus. That
table grows with the corpus and stays distributed: each chunk of documents
sends the list of its distinct words to it once. Only the counts of words that
make up 1/``NAMED`` of the corpus or more, so at most ``NAMED``, go to the tasks
beforehand. Training
is data-parallel: in each round every partition trains a copy on its own
documents of that round, and the copies' weighted mean is the next start; over
all rounds every word of every document is a target once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyspark.llm.common import cut
from tallyspark.llm.repetition import _SPACE, _run_hashes, _slices

BUCKETS = 1 << 16
CLASSES = 32
IDS = CLASSES * CLASSES
RARE = 128
NAMED = 1 << 16
CHUNK_BYTES = 1 << 23
BOUNDARY = IDS  # the place beyond either end of a text
SIDE = 2  # words on each side
WIDTH = 24
ROUNDS = 2
BATCH = 2048
RATE = 0.1
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of every word of the texts data[offsets[i]:offsets[i + 1]]."""
    size = len(data)
    begins = np.zeros(size + 1, bool)
    begins[offsets] = True
    solid = ~_SPACE[data]
    start = np.flatnonzero(solid & (begins[:-1] | np.concatenate(([True], ~solid[:-1]))[:size]))
    return start, np.flatnonzero(solid & (begins[1:] | np.concatenate((~solid[1:], [True]))[:size])) + 1


def _bucket(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (_run_hashes(data, start, end) >> np.uint64(48)).astype(np.int64) % BUCKETS


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word of the texts data[offsets[i]:offsets[i + 1]]."""
    start, end = _words(data, offsets)
    return np.searchsorted(offsets, start, side="right") - 1, _bucket(data, start, end)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The numbers of words of the texts of some slices, the place of every word
    in the list of distinct words, and the list."""
    n, solid, length = [], [], []
    for data, offsets in parts:
        start, end = _words(data, offsets)
        solid.append(data[~_SPACE[data]])
        length.append(end - start)
        n.append(np.diff(np.searchsorted(start, offsets)))
    length = np.concatenate(length)
    where = np.concatenate(([0], np.cumsum(length)))
    words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(where), pa.py_buffer(np.concatenate(solid))])
    listed = words.dictionary_encode()
    return np.concatenate(n), listed.indices.to_numpy().astype(np.int32), listed.dictionary.cast(pa.binary())


def _word_bucket(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.int64)
    where = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return _bucket(np.frombuffer(words.buffers()[2], np.uint8), where[:-1], where[1:])


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list]]:
    """Consecutive slices of about ``CHUNK_BYTES`` together, and their rows."""
    parts, rows, size = [], [], 0
    for batch in batches:
        at = 0
        for data, offsets in _slices(batch.column(column)):
            n = len(offsets) - 1
            parts.append((data, offsets))
            rows.append(batch.slice(at, n))
            at += n
            size += len(data)
            if size >= CHUNK_BYTES:
                yield parts, rows
                parts, rows, size = [], [], 0
    if parts:
        yield parts, rows


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts, _ in _chunks(batches, 0):
        _, place, words = _distinct(parts)
        if len(words):
            yield pa.RecordBatch.from_arrays([words, pa.array(_word_bucket(words).astype(np.int32)), pa.array(np.bincount(place, minlength=len(words)))],
                                             ["word", "bucket", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, bucket, n): how often each word occurs in all texts."""
    parts = docs.select(docs[text_col]).mapInArrow(_listed, "word binary, bucket int, n long")
    return cut(parts.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data, offsets in _slices(batch.column(0)):
            total += np.bincount(word_buckets(data, offsets)[1], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def vocabulary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The id of each bucket, from the exact counts of all words. At most
    ``BUCKETS`` counts come to the driver."""
    counts = docs.select(docs[text_col]).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return _ids(_totals(counts))


def _totals(counts: DataFrame) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():
        total[r.bucket] = r.n
    return total


def _ids(total: np.ndarray) -> np.ndarray:
    own = IDS - RARE
    ids = own + np.arange(BUCKETS) % RARE
    ids[np.argsort(-total, kind="stable")[:own]] = np.arange(own)
    return ids.astype(np.int16)


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {"embed": small(IDS + 1, WIDTH), "place": np.ones((len(OFFSETS), WIDTH), np.float32), "bias": np.zeros(WIDTH, np.float32),
            "to_class": small(WIDTH, CLASSES), "class_bias": np.zeros(CLASSES, np.float32),
            "to_word": small(CLASSES, WIDTH, CLASSES), "word_bias": np.zeros((CLASSES, CLASSES), np.float32)}


def _windows(owner: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids on both sides of the words ``at``, within their texts."""
    n = len(ids)
    out = np.full((len(at), len(OFFSETS)), BOUNDARY, np.int64)
    for k, o in enumerate(OFFSETS):
        to = at + o
        inside = (to >= 0) & (to < n)
        inside[inside] = owner[to[inside]] == owner[at[inside]]
        out[inside, k] = ids[to[inside]]
    return out


def _safe(x: np.ndarray) -> np.ndarray:
    """``x``, shifted by row where its exponentials could leave the range."""
    return x - x.max(axis=1, keepdims=True) if len(x) and max(x.max(), -x.min()) > 60 else x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = _safe(x)
    return x[np.arange(len(x)), at] - np.log(np.exp(x).sum(axis=1))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(_safe(x))
    x /= x.sum(axis=1, keepdims=True)
    return x


def _hidden(p: dict, window: np.ndarray) -> np.ndarray:
    x = np.zeros((len(window), WIDTH), np.float32)
    for k in range(len(OFFSETS)):
        x += np.take(p["embed"] * p["place"][k], window[:, k], axis=0)
    return np.tanh(x + p["bias"])


def log_probs(p: dict, window: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each target given its window."""
    order = np.argsort(target // CLASSES, kind="stable")
    which, inner = np.divmod(target[order], CLASSES)
    edge = np.searchsorted(which, np.arange(CLASSES + 1))
    h = _hidden(p, window[order])
    x = p["word_bias"][which]
    for c in range(CLASSES):
        if edge[c] < edge[c + 1]:
            x[edge[c]:edge[c + 1]] += h[edge[c]:edge[c + 1]] @ p["to_word"][c]
    out = np.empty(len(target))
    out[order] = _log_softmax_at(h @ p["to_class"] + p["class_bias"], which).astype(np.float64) + _log_softmax_at(x, inner)
    return out


def gradients(p: dict, window: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability."""
    n = len(target)
    order = np.argsort(target // CLASSES, kind="stable")  # a class's targets lie together
    window, target = window[order], target[order]
    which, inner = np.divmod(target, CLASSES)
    edge = np.searchsorted(which, np.arange(CLASSES + 1))
    full = [(c, slice(edge[c], edge[c + 1])) for c in range(CLASSES) if edge[c] < edge[c + 1]]
    h = _hidden(p, window)
    err = _softmax(h @ p["to_class"] + p["class_bias"])
    err[np.arange(n), which] -= 1
    g = {"to_class": h.T @ err, "class_bias": err.sum(0), "to_word": np.zeros_like(p["to_word"]), "word_bias": np.zeros_like(p["word_bias"])}
    back = err @ p["to_class"].T
    err = p["word_bias"][which]
    for c, mine in full:
        err[mine] += h[mine] @ p["to_word"][c]
    err = _softmax(err)
    err[np.arange(n), inner] -= 1
    for c, mine in full:
        g["to_word"][c] = h[mine].T @ err[mine]
        back[mine] += err[mine] @ p["to_word"][c].T
    g["word_bias"][[c for c, _ in full]] = np.add.reduceat(err, [mine.start for _, mine in full])
    back *= 1 - h * h
    g["bias"] = back.sum(0)
    # Sums of ``back`` by place and id give both remaining gradients.
    ids, sides = len(p["embed"]), len(OFFSETS)
    flat = (window + np.arange(sides) * ids).T.ravel()
    rows = np.tile(back.T.astype(np.float64), sides)
    sums = np.stack([np.bincount(flat, r, sides * ids).astype(back.dtype) for r in rows]).reshape(WIDTH, sides, ids)
    embed = np.ascontiguousarray(p["embed"].T)
    g["place"] = np.matmul(sums, embed[:, :, None])[:, :, 0].T
    g["embed"] = np.matmul(p["place"].T[:, None], sums)[:, 0].T
    return {k: (v / n).astype(np.float32) for k, v in g.items()}


def _trained(start: dict, ids: np.ndarray):
    """Train a copy of ``start`` on a partition's texts; return its numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in start.items()}
        square = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        seen, held = 0, [np.empty((0, len(OFFSETS)), np.int64), np.empty(0, np.int64)]

        def step(window, target):
            for k, g in gradients(p, window, target).items():
                square[k] += g * g
                p[k] -= RATE * g / np.sqrt(square[k])
        for batch in batches:
            for part in _slices(batch.column(0)):
                n, place, listed = _distinct([part])
                owner, words = np.repeat(np.arange(len(n)), n), ids[_word_bucket(listed)].astype(np.int64)[place]
                held = [np.concatenate((held[0], _windows(owner, words, np.arange(len(words))))), np.concatenate((held[1], words))]
                seen += len(words)
                whole = len(held[1]) // BATCH * BATCH
                for i in range(0, whole, BATCH):
                    step(held[0][i:i + BATCH], held[1][i:i + BATCH])
                held = [x[whole:] for x in held]
        if len(held[1]):
            step(*held)
        if seen:
            values = np.concatenate([p[k].ravel() for k in sorted(p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.float64) * seen),
                                              pa.array(np.full(len(values), seen))], ["place", "value", "weight"])
    return run


def train(docs: DataFrame, ids: np.ndarray, text_col: str = "text", rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after ``rounds`` of training. One fixed-size set of
    parameters per partition is summed in Spark; one comes to the driver."""
    p = fresh()
    turn = F.pmod(F.xxhash64(docs[text_col]), F.lit(rounds))
    for k in range(rounds):
        copies = docs.filter(turn == k).select(docs[text_col]).mapInArrow(_trained(p, ids), "place int, value double, weight long")
        mean = copies.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
        if not len(mean):
            continue
        values, at = mean.sort_values("place")["value"].to_numpy(np.float32), 0
        for name in sorted(p):
            size = p[name].size
            p[name] = values[at:at + size].reshape(p[name].shape)
            at += size
    return p


def _network(p: dict, owner: np.ndarray, words: np.ndarray, docs: int) -> np.ndarray:
    """The log-probabilities of the texts' ids."""
    total = np.zeros(docs)
    for i in range(0, len(words), 1 << 12):
        part = np.arange(i, min(len(words), i + (1 << 12)))
        total += np.bincount(owner[part], log_probs(p, _windows(owner, words, part), words[part]), docs)
    return total


def _scored(p: dict, ids: np.ndarray):
    """The network's part alone: every word as one of its id's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for data, offsets in _slices(batch.column(1)):
                owner, bucket = word_buckets(data, offsets)
                n = np.bincount(owner, minlength=len(offsets) - 1)
                total = _network(p, owner, ids[bucket].astype(np.int64), len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(n.astype(np.int64)), pa.array(total),
                     pa.array(total / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_words", "log_likelihood", "mean_log_prob"])
                at += len(n)
    return run


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _begun(p: dict, ids: np.ndarray, log_total: np.ndarray, named: pa.Array, log_named: np.ndarray):
    """A row per chunk: its documents, scored but for the counts of the words
    that aren't ``named``; a list of these words, and the places in that list
    of the occurrences, one document after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for parts, rows in _chunks(batches, 1):
            n, place, words = _distinct(parts)
            owner = np.repeat(np.arange(len(n)), n)
            id_ = ids[_word_bucket(words)].astype(np.int64)[place]
            total = _network(p, owner, id_, len(n))
            which = pc.index_in(words, value_set=named)
            is_named = which.is_valid().to_numpy(zero_copy_only=False)
            known = np.zeros(len(words))
            known[is_named] = log_named[which.drop_null().to_numpy()]
            total += np.bincount(owner, known[place] - log_total[id_], len(n))
            new = np.cumsum(~is_named) - 1
            rest = ~is_named[place]
            doc_ids = pa.chunked_array([x.column(0) for x in rows]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), _list(doc_ids), _list(pa.array(n.astype(np.int64))), _list(pa.array(total)),
                 _list(pa.array(np.bincount(owner[rest], minlength=len(n)).astype(np.int32))),
                 pa.array([new[place[rest]].astype(np.int32).tobytes()]), _list(words.filter(pa.array(~is_named)))],
                ["chunk", "doc_ids", "n_words", "total", "n_rest", "places", "words"])
            chunk += 1
    return run


def _finished(kind: pa.DataType):
    def run(begun: pa.Table, counts: pa.Table) -> pa.Table:
        log_n = np.zeros(counts.num_rows)
        log_n[counts["at"].to_numpy()] = np.log(counts["n"].to_numpy())
        row = {c: begun[c].combine_chunks() for c in begun.column_names}
        n, n_rest = row["n_words"].flatten().to_numpy(), row["n_rest"].flatten().to_numpy()
        places = np.frombuffer(row["places"][0].as_buffer(), np.int32)
        total = row["total"].flatten().to_numpy() + np.bincount(np.repeat(np.arange(len(n)), n_rest), log_n[places], len(n))
        return pa.Table.from_arrays([row["doc_ids"].flatten().cast(kind), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)],
                                    ["doc_id", "n_words", "log_likelihood", "mean_log_prob"])
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_prob) per row, by a network
    trained on all texts of ``docs`` and the counts of all their words.

    Null, empty and blank texts have no words, likelihood 0 and a null mean;
    equal texts score equally up to rounding; an empty table gives no rows;
    other columns are ignored. Read ``docs`` from files: training visits texts
    in partition order.
    """
    counts = word_counts(docs, text_col)
    of_bucket = _totals(counts.groupBy("bucket").agg(F.sum("n").alias("n")))
    ids = _ids(of_bucket)
    p = train(docs, ids, text_col)
    log_total = np.log(np.maximum(np.bincount(ids, of_bucket, IDS), 1))
    top = counts.filter(F.col("n") * NAMED >= F.lit(int(of_bucket.sum()))).collect()
    begin = _begun(p, ids, log_total, pa.array([bytes(r.word) for r in top], pa.binary()), np.log(np.array([r.n for r in top], float)))
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = chosen.schema[0].dataType
    begun = cut(chosen.mapInArrow(begin, f"chunk long, doc_ids array<{kind.simpleString()}>, n_words array<long>, total array<double>, "
                                  "n_rest array<int>, places binary, words array<binary>"))
    asked = begun.select("chunk", F.posexplode("words").alias("at", "word"))
    found = asked.join(counts, "word").select(F.col("chunk").alias("of"), "at", "n")
    return begun.drop("words").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(
        _finished(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_words long, log_likelihood double, mean_log_prob double")
