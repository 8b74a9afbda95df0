"""Operator 9: order-preserving packing of documents into token windows.

Every task tokenises the documents of its partition in order and cuts the
stream of ids into windows of at most ``window`` ids by dynamic programming:
cuts fall at document or sentence ends (and, inside a sentence longer than a
window, every ``HARD_GAP`` ids), and the sum of padding and cut penalties is
least. The best earlier cut of each place is the minimum of a sliding window,
kept by a monotone queue; a window whose length is a power of two needs no
padding, so the few places that far back are looked at too. No text is
shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import tokens

WINDOW = 2048
END_ID = 1
# Penalties in ids of padding: a cut after a sentence, one inside a sentence
# that no window holds, and a window that is short but a power of two.
SENTENCE_CUT, HARD_CUT, SHORT = 2, 12, 600
HARD_GAP = 32
# Ids gathered before the cuts are worked out; what follows the last cut goes on
# with the next ids, so memory is bounded by this and one document.
BLOCK = 1 << 17
# Windows of one task are numbered from its partition number times this.
PER_TASK = 1 << 32


def cuts(places: np.ndarray, penalties: np.ndarray, window: int, last: bool = True) -> list[int]:
    """Indices into ``places`` (ascending, first 0, gaps at most ``window``)
    where windows end, of least padding plus penalties (``SHORT`` in the place of
    padding for a power of two). The last place ends a
    window if ``last``; else the cheapest of the places less than a window
    before it ends the last one, and the rest stays open."""
    place, fee = places.tolist(), penalties.tolist()
    exact: dict[int, list[int]] = {}
    for size in (1 << k for k in range(window.bit_length()) if 1 << k < window):
        i = np.searchsorted(places, places - size)
        for j in np.flatnonzero(places[i] == places - size).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    cost, origin = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + place, place, index: rising
    for j in range(1, len(place)):
        at = place[j]
        while queue[0][1] < at - window:
            queue.popleft()
        best = queue[0]
        cost[j] = best[0] + window - at + fee[j]
        origin[j] = best[2]
        for i in exact.get(j, ()):
            if cost[i] + SHORT + fee[j] < cost[j]:
                cost[j], origin[j] = cost[i] + SHORT + fee[j], i
        total = cost[j] + at
        while queue and queue[-1][0] >= total:
            queue.pop()
        queue.append((total, at, j))
    ends, j = [], len(place) - 1
    if not last:
        j = min((i for i in range(len(place)) if place[i] > place[-1] - window), key=lambda i: (cost[i], -i))
    while j:
        ends.append(j)
        j = origin[j]
    return ends[::-1]


def sentence_ends(path: str) -> np.ndarray:
    """Mask over the ids: the token ends a sentence or a line."""
    library = tokens._engines(path)[0]
    n = library.get_vocab_size(with_added_tokens=True)
    newline = next(k for k, v in tokens._byte_alphabet().items() if v == 10)
    mask = np.zeros(n, bool)
    for token, i in library.get_vocab().items():
        mask[i] = token.endswith((".", "!", "?", newline))
    return mask


class _Packer:
    """The open part of one task's stream."""

    def __init__(self, window: int, ends: np.ndarray, end_id: int):
        self.window, self.ends, self.end_id = window, ends, end_id
        self.docs: list[list] = []  # [doc_id, ids, first place not yet packed]
        self.size = self.sequence = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, np.append(ids, np.uint32(self.end_id)).astype("<u4"), 0])
        self.size += len(self.docs[-1][1])

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        places, fees, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, start in self.docs:
            rest = ids[start:]
            inner = np.flatnonzero(self.ends[rest[:-1]]) + 1 if len(rest) > 1 else np.empty(0, np.int64)
            inner = inner[inner < len(rest)]
            known = np.concatenate(([0], inner, [len(rest)]))
            fee = np.concatenate(([0], np.full(len(inner), SENTENCE_CUT), [0]))
            gap = np.diff(known)
            wide = np.flatnonzero(gap > self.window)
            if len(wide):
                step = min(HARD_GAP, self.window)
                hard = np.concatenate([np.arange(known[i] + step, known[i + 1], step) for i in wide])
                known = np.concatenate((known, hard))
                fee = np.concatenate((fee, np.full(len(hard), HARD_CUT)))
                order = np.argsort(known, kind="stable")
                known, fee = known[order], fee[order]
            places.append(known[1:] + at)
            fees.append(fee[1:])
            at += len(rest)
        return np.concatenate(places), np.concatenate(fees)

    def pack(self, last: bool) -> Iterator[tuple]:
        """The pieces of the windows that are settled."""
        if not self.docs:
            return
        places, fees = self._candidates()
        done = places[cuts(places, fees, self.window, last)]
        at, d, packed = 0, 0, 0
        for end in done.tolist():
            offset = 0
            while at < end:
                doc_id, ids, start = self.docs[d]
                n = min(end - at, len(ids) - start)
                yield doc_id, start, n, ids[start:start + n], len(ids), self.sequence, offset
                at, offset = at + n, offset + n
                if start + n == len(ids):
                    d += 1
                else:
                    self.docs[d][2] = start + n
            self.sequence += 1
            packed = end
        self.docs = self.docs[d:]
        self.size -= packed


def _run(path: str, window: int, end_id: int, keep_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = tokens.Encoder(path), _Packer(window, sentence_ends(path), end_id), 0

        def table(pieces):
            rows = list(pieces)
            if not rows:
                return
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                      pa.array([zlib.crc32(x.tobytes()) for x in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()),
                      pa.array([base + s for s in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[3]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        for batch in batches:
            if len(batch):
                base = batch.column(2)[0].as_py() * PER_TASK
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encoder.ids(text.as_py() or ""))
                if packer.size >= BLOCK:
                    yield from table(packer.pack(False))
        yield from table(packer.pack(True))
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the piece's ``ids`` if ``keep_ids``.

    A document is its token ids and ``end_id``; a null or empty text is
    ``end_id`` alone; bytes that are no valid UTF-8 are encoded as U+FFFD. Pieces of a document lie in order, in one or several
    consecutive windows of its task; only the last window of a task may be
    filled little. Every row is a document, repeated rows too. An empty table
    gives no rows; other columns are ignored. ``docs`` should be read from
    files: a task that runs again then packs the same rows again.
    """
    path = tokenizer or tokens.default_path()
    chosen = docs.select(docs[id_col].alias("doc_id"), F.make_valid_utf8(docs[text_col]).alias("text"),
                         F.spark_partition_id().cast("long").alias("part"))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = chosen.schema[0].dataType
    schema = (f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long") + (", ids array<int>" if keep_ids else "")
    return chosen.mapInArrow(_run(path, window, end_id, keep_ids, to_arrow_type(kind)), schema)
