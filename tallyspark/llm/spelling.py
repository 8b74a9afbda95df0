"""Operator 11: spelling variants by a trie over letter-group counts.

Letters are dealt to groups of like weight, and a word is its counts of the
groups, one after another: a path of the trie. One inserted, deleted or
replaced letter raises one count by one at most and lowers one by one at most,
so a search goes down the trie with a budget of one surplus and one deficit,
and the words at the leaves it reaches are verified letter by letter.

The trie's upper levels deal the work out: a shard is all words with the same
counts of the first groups, and a word is sent as a query to the shards within
its budget with what is left of it. How many levels deal is taken from the
words, so that shards stay below a bound.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut

# Fixed by the contract.
LETTERS = 6
OCCURRENCES = 5
TIMES = 5
EVERY = 199
# Maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, once A-Z is lowered.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
GROUPS = 14
# Words of a shard; words counted in a task before counts are sent on; paths
# followed at once; letters of a word that are compared in numpy.
SHARD = 20_000
HELD = 500_000
PATHS = 200_000
WIDE = 32


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text as bytes) -> (word, n), summed within the task."""
    found: Counter = Counter()
    size = 0

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()),
                                          pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return out
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = None if doc is None else zlib.crc32(doc.encode() + b":")
            for run, n in Counter(RUN.findall(text.as_py().lower())).items():
                letters = len(run) - run.count(b"\xc3")
                if letters < LETTERS:
                    continue
                if start is not None and (h := zlib.crc32(run, start)) % EVERY == 0:
                    if letters == LETTERS:
                        continue
                    word, at = run.decode(), h % letters
                    run = (word[:at] + word[at + 1:]).encode()
                found[run] += n
                size += len(run)
                if len(found) >= HELD or size > 1 << 27:
                    yield send()
                    size = 0
    yield send()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all texts."""
    rows = docs.filter(docs[text_col].isNotNull()).select(docs[id_col].cast("string"), docs[text_col].cast("binary"))
    return rows.mapInArrow(_runs, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[int]:
    """The group of each Latin-1 code: letters by falling frequency, each to
    the lightest group so far. At most 90 counts reach the driver."""
    seen = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().filter("c <> ''").collect()
    weight, of = [0] * groups, [0] * 256
    for r in sorted(seen, key=lambda r: (-r["count"], r.c)):
        g = weight.index(min(weight))
        weight[g] += r["count"]
        of[ord(r.c)] = g
    return of


def _counts(words: list[bytes], of: np.ndarray, groups: int) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    group = of[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(np.repeat(np.arange(len(words)), size) * groups + group, minlength=len(words) * groups).reshape(-1, groups)


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _steps(levels: int) -> list[tuple[int | None, int | None]]:
    """(group with one more, group with one less) within the budget."""
    some = [None, *range(levels)]
    return [(i, j) for i in some for j in some if i is None or i != j]


def _sent(of: list[int], groups: int, levels: int, pieces: int):
    """(word, n) -> the word in its shard, and as a query to every shard that
    its budget reaches."""
    table = np.array(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                latin = _latin(part.column(0))
                if not latin:
                    continue
                counts = _counts(latin, table, groups)[:, :levels]

                def out(which: np.ndarray, key: np.ndarray, query: bool, up: bool, down: bool, piece: np.ndarray) -> pa.RecordBatch:
                    names = [",".join(map(str, k)) + f"/{p}" for k, p in zip(key.tolist(), piece.tolist())]
                    flag = lambda x: pa.array(np.full(len(which), x))
                    rows = part.take(pa.array(which))
                    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), flag(query), rows.column(0), rows.column(1), flag(up), flag(down)],
                                                      ["key", "query", "word", "n", "up", "down"])
                every = np.arange(len(latin))
                yield out(every, counts, False, False, False, np.array([zlib.crc32(w) % pieces for w in latin]))
                for i, j in _steps(levels):
                    which = every if j is None else np.flatnonzero(counts[:, j] > 0)
                    key = counts[which]
                    if i is not None:
                        key[:, i] += 1
                    if j is not None:
                        key[:, j] -= 1
                    for p in range(pieces):
                        if len(which):
                            yield out(which, key, True, i is not None, j is not None, np.full(len(which), p))
    return run


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether two words differ by one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)):] == b[same + (len(b) >= len(a)):]


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words' lengths and their first letters, padded with zeros."""
    return np.fromiter(map(len, words), np.int64, len(words)), \
        np.array([w[:WIDE] for w in words], dtype=f"S{WIDE}").view(np.uint8).reshape(len(words), WIDE)


def _verified(a: list[bytes], la: np.ndarray, ma: np.ndarray, b: list[bytes], lb: np.ndarray, mb: np.ndarray,
              i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) are one letter apart."""
    x, y, d = ma[i], mb[j], la[i] - lb[j]
    short, long = np.where((d <= 0)[:, None], x, y), np.where((d <= 0)[:, None], y, x)
    differ = short != long
    later = np.arange(WIDE - 1)[None, :] >= differ.argmax(1)[:, None]
    shifted = ((short[:, :-1] != long[:, 1:]) & later).any(1)
    out = np.where(d == 0, differ.sum(1) == 1, (np.abs(d) == 1) & ~shifted)
    for k in np.flatnonzero((np.maximum(la[i], lb[j]) > WIDE) & (np.abs(d) <= 1)):
        out[k] = one_apart(a[i[k]], b[j[k]])
    return out


class _Trie:
    """The words of a shard by their counts of the groups from ``first`` on."""

    def __init__(self, words: list[bytes], n: list[int], of: np.ndarray, groups: int, first: int) -> None:
        counts = _counts(words, of, groups)[:, first:]
        # By path; the words of a leaf by letters.
        rank = np.array(sorted(range(len(words)), key=words.__getitem__))
        order = rank[np.lexsort(counts[rank].T[::-1])] if counts.shape[1] else rank
        self.words, self.n, counts = [words[k] for k in order], np.array(n, np.int64)[order], counts[order]
        self.by_letters = np.empty(len(words), np.int64)
        self.by_letters[np.array(sorted(range(len(words)), key=self.words.__getitem__))] = np.arange(len(words))
        self.size, self.letters = _letters(self.words)
        self.base = int(counts.max(initial=0)) + 3
        # A level's edges: parent node * base + count, sorted; an edge's place
        # is its child node.
        self.levels, node = [], np.zeros(len(words), np.int64)
        for level in range(counts.shape[1]):
            edges, node = np.unique(node * self.base + counts[:, level], return_inverse=True)
            self.levels.append(edges)
        self.leaf = np.searchsorted(node, np.arange(int(node.max(initial=-1)) + 2))

    def pairs(self, counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) places at the leaves that queries with these counts
        reach; ``up`` and ``down`` say what is spent. Depth first, many paths
        at a time."""
        every = np.arange(len(counts))
        stack = [(0, every[k:k + PATHS], np.zeros(len(every[k:k + PATHS]), np.int64), up[k:k + PATHS], down[k:k + PATHS])
                 for k in range(0, len(every), PATHS)]
        while stack:
            level, q, node, u, d = stack.pop()
            if level == len(self.levels):
                size = self.leaf[node + 1] - self.leaf[node]
                ends = np.cumsum(size)
                for at in range(0, int(ends[-1]) if len(ends) else 0, PATHS):
                    k = np.arange(at, min(at + PATHS, int(ends[-1])))
                    owner = np.searchsorted(ends, k, side="right")
                    yield q[owner], self.leaf[node[owner]] + k - (ends[owner] - size[owner])
                continue
            edges, nexts = self.levels[level], []
            for step in (0, 1, -1):
                able = np.flatnonzero(~u if step > 0 else ~d) if step else np.arange(len(q))
                count = counts[q[able], level] + step
                able, count = able[(count >= 0) & (count < self.base)], count[(count >= 0) & (count < self.base)]
                wanted = node[able] * self.base + count
                child = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
                hit = edges[child] == wanted
                able, child = able[hit], child[hit]
                if len(able):
                    nexts.append((q[able], child, u[able] | (step > 0), d[able] | (step < 0)))
            if nexts:
                whole = [np.concatenate(x) for x in zip(*nexts)]
                stack += [(level + 1, *[x[k:k + PATHS] for x in whole]) for k in range(0, len(whole[0]), PATHS)]


def _searched(of: list[int], groups: int, levels: int):
    """Rows sorted by shard, its words before its queries -> per query (word,
    n, n_near, and its best word in the shard: best, best_n)."""
    table = np.array(of)
    out = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def ask(trie: _Trie, rows: pa.RecordBatch) -> pa.RecordBatch:
        words = _latin(rows.column("word"))
        size, letters = _letters(words)
        flag = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for q, w in trie.pairs(_counts(words, table, groups)[:, levels:], flag("up"), flag("down")):
            ok = _verified(words, size, letters, trie.words, trie.size, trie.letters, q, w)
            q, w = q[ok], w[ok]
            np.add.at(near, q, 1)
            old = np.flatnonzero(best >= 0)
            q, w = np.concatenate((q, old)), np.concatenate((w, best[old]))
            order = np.lexsort((trie.by_letters[w], -trie.n[w], q))
            q, w = q[order], w[order]
            head = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
            best[q[head]] = w[head]
        has = best >= 0
        return pa.RecordBatch.from_arrays([
            rows.column("word"), rows.column("n"), pa.array(near), pa.array(trie.n[best], mask=~has),
            pa.array([trie.words[b].decode("latin-1") if h else None for b, h in zip(best, has)], pa.string())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, n, trie = None, [], [], None
        for batch in batches:
            keys, query = batch.column("key").to_pylist(), batch.column("query").to_numpy(zero_copy_only=False)
            edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or query[k] != query[k - 1]], len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if keys[a] != key:
                    key, words, n, trie = keys[a], [], [], None
                if not query[a]:
                    words += _latin(part.column("word"))
                    n += part.column("n").to_pylist()
                elif words:
                    trie = trie or _Trie(words, n, table, groups, levels)
                    yield ask(trie, part)
    return run


def _dealing(words: DataFrame, of: list[int], groups: int, shard: int) -> tuple[int, int]:
    """(levels that deal, pieces per shard): the fewest levels whose largest
    shard is within the bound; if even whole paths hold more words, these are
    cut into pieces by a hash."""
    table = np.array(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = _counts(_latin(batch.column(0)), table, groups)
                yield pa.RecordBatch.from_arrays([pa.array(counts[:, g].astype(np.int64)) for g in range(groups)], [f"c{g}" for g in range(groups)])
    names = [f"c{g}" for g in range(groups)]
    paths = cut(words.select("word").mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy(*names).count())
    sums = paths.rollup(*names).agg(F.sum("count").alias("n"), F.grouping_id().alias("g")).groupBy("g").agg(F.max("n").alias("n")).collect()
    largest = {groups - r.g.bit_count(): r.n for r in sums}
    levels = next((k for k in range(1, groups + 1) if largest.get(k, 0) <= shard), groups)
    return levels, max(1, -(-largest.get(levels, 0) // shard))


def near_words(words: DataFrame, groups: int = GROUPS, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, best_n, best) for every word of ``words`` (word, n)."""
    of = letter_groups(words, groups)
    levels, pieces = _dealing(words, of, groups, shard)
    sent = words.select("word", "n").mapInArrow(_sent(of, groups, levels, pieces), "key string, query boolean, word string, n long, up boolean, down boolean")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.repartition(parts, "key").sortWithinPartitions("key", "query").mapInArrow(
        _searched(of, groups, levels), "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where following forms ends.
    Forms are at least ``TIMES`` as frequent, so chains are short; each round
    doubles what is followed."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("w"), F.col("root").alias("r"))
        state = cut(state.join(onward, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", occurrences: int = OCCURRENCES,
             times: int = TIMES, groups: int = GROUPS, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word.

    Null and empty texts hold no words. In a row with a null id no letter is
    deleted. Repeated rows count as often as they occur. Runs of any length
    are words. Bytes that are no valid UTF-8 end a run. Of near words of one
    frequency the smallest by code points is the form. An empty table gives no
    rows; other columns are ignored.
    """
    words = cut(vocabulary(docs, id_col, text_col, occurrences))
    found = cut(near_words(words, groups, shard))
    fits = F.col("best_n") >= times * F.col("n")
    formed = found.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    ends = roots(formed.filter("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    return formed.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE
bits AS (SELECT list(t ORDER BY b) AS tab FROM (
  SELECT b, list_reduce(list_concat([b], range(8)), lambda a, k:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS t FROM range(256) r(b))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{6,}')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
             lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))),
             lambda a, c: xor(tab[(xor(a, c) & 255) + 1], a // 256)), 4294967295) AS h FROM runs, bits),
said AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
plain AS (SELECT word, n, translate(word, (SELECT string_agg(chr((192 + i)::INT), '' ORDER BY i) FROM range(64) r(i)),
                                    (SELECT string_agg(chr((32 + i)::INT), '' ORDER BY i) FROM range(64) r(i))) AS p FROM words),
less AS (SELECT word, n, p, p AS k FROM plain UNION SELECT word, n, p, substr(p, 1, i) || substr(p, i + 2)
         FROM (SELECT *, unnest(range(length(p))) AS i FROM plain)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.k = b.k AND a.word <> b.word
         WHERE levenshtein(a.p, b.p) = 1),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word, n),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form,
                  CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
up AS (SELECT word, word AS root, 0 AS d FROM formed UNION ALL SELECT up.word, f.form, d + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, d) AS root FROM up GROUP BY word) r ON r.word = f.word
"""
