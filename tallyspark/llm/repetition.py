"""Operator 1: quality rules on repetition within a text.

Words become 64-bit hashes (a multilinear hash over their bytes). One running
hash over all words gives the hash of an n-gram of any length as a difference
of two places, rolled on from word to word, and one sort per length
finds the repeats of every document of a batch at once. The rules measure the
characters of words inside repeated n-grams (the first occurrence apart) and
of repeated lines.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Limits on the shares of a text's word characters, by n-gram length, and of
# its lines and their characters: the published rules for web text (Rae et al.
# 2021, table A1).
NGRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHARS_LIMIT = 0.20
MIN_WORDS = 50
# Documents are worked together in slices of about so many bytes.
SLICE_BYTES = 1 << 19

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
SHARES = [f"share_{n}" for n in NGRAM_LIMITS] + ["share_lines", "share_line_chars"]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80
_BYTE = np.random.default_rng(11).integers(1, 2 ** 63, 256, dtype=np.uint64)


# An odd number and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _place(size: int) -> np.ndarray:
    return np.random.default_rng(12).integers(1, 2 ** 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run data[start:end]; runs ascend and don't overlap."""
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    size = 1 << max(10, int(length.max()).bit_length())
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    value = _BYTE[data[at + np.repeat(start, length)]] * _place(size)[at]
    return _scramble(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over ``key``: the value occurs twice or more; it occurred before."""
    n = len(key)
    if n < 2:
        return np.zeros(n, bool), np.zeros(n, bool)
    # The place is kept in the low bits, so that a plain sort gives the order.
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    packed = np.sort((key >> bits << bits) | np.arange(n, dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    if (same != ((packed[1:] >> bits) == (packed[:-1] >> bits))).any():  # the cut keys collide
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
    later, any_ = np.zeros(n, bool), np.zeros(n, bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def _covered(hits: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the places covered by windows of ``width`` that begin at ``hits``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + width, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of the texts data[offsets[i]:offsets[i + 1]] (UTF-8)."""
    docs = len(offsets) - 1
    size = len(data)
    out = {}
    per_doc = lambda owner, weight=None: np.bincount(owner, weight, docs).astype(np.int64)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    begins = np.zeros(size + 1, bool)
    begins[offsets] = True
    solid = ~_SPACE[data]
    start = np.flatnonzero(solid & (begins[:-1] | np.concatenate(([True], ~solid[:-1]))[:size]))
    end = np.flatnonzero(solid & (begins[1:] | np.concatenate((~solid[1:], [True]))[:size])) + 1
    word_owner = owner[start]
    chars = np.concatenate(([0], np.cumsum(solid & _CHAR[data])))
    word_chars = chars[end] - chars[start]
    out["n_words"] = per_doc(word_owner)
    out["word_chars"] = per_doc(word_owner, word_chars)
    out["n_symbols"] = per_doc(owner[_SYMBOL[data]])

    # Lines with a word.
    first = np.flatnonzero((begins[:-1] | np.concatenate(([False], data[:-1] == 10))[:size]))
    last = np.concatenate((first[1:], [size])) if len(first) else first
    last = last - (data[last - 1] == 10) if len(first) else last
    words_before = np.concatenate(([0], np.cumsum(solid)))
    full = words_before[last] > words_before[first]
    first, last = first[full], last[full]
    line_owner = owner[first]
    salt = _scramble(np.arange(1, docs + 1, dtype=np.uint64))
    _, later = _repeats(_scramble(_run_hashes(data, first, last) ^ salt[line_owner]))
    line_chars = chars[last] - chars[first]
    out["n_dup_lines"] = per_doc(line_owner[later])
    n_lines = per_doc(line_owner)
    dup_chars = per_doc(line_owner[later], line_chars[later])

    word = _run_hashes(data, start, end)
    n_words = len(word)
    # running[i] is the sum of word[j] * BASE^j over j < i; what lies between two
    # places, divided by BASE^i, is the words' own polynomial.
    power = np.cumprod(np.full(n_words, _BASE)) * _INVERSE if n_words else word
    back = np.cumprod(np.full(n_words, _INVERSE)) * _BASE if n_words else word
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * power, dtype=np.uint64)))
    total = np.maximum(out["word_chars"], 1)
    for n in (3, *NGRAM_LIMITS):
        count = max(0, n_words - n + 1)
        gram = (running[n:] - running[:count]) * back[:count] if count else np.empty(0, np.uint64)
        inside = np.flatnonzero(word_owner[:count] == word_owner[n - 1:]) if count else np.empty(0, np.int64)
        any_, later = _repeats(_scramble(gram[inside] ^ salt[word_owner[inside]]))
        if n == 3:
            out["n_repeat_words"] = per_doc(word_owner[_covered(inside[any_], n, n_words)])
        if n in NGRAM_LIMITS:
            inside = _covered(inside[later], n, n_words)
            out[f"share_{n}"] = per_doc(word_owner[inside], word_chars[inside]) / total
    out["share_lines"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    out["share_line_chars"] = dup_chars / total
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    good = ~out["base_failed"] & (out["share_lines"] <= LINE_LIMIT) & (out["share_line_chars"] <= LINE_CHARS_LIMIT)
    for n, limit in NGRAM_LIMITS.items():
        good &= out[f"share_{n}"] <= limit
    out["kept"] = good
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and offsets of consecutive texts, about ``SLICE_BYTES`` at a time."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES)))
        to = min(to, len(texts))
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for data, offsets in _slices(batch.column(1)):
            found = measure(data, offsets)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *[pa.array(found[c]) for c in COLUMNS + SHARES]],
                                             ["doc_id", *COLUMNS, *SHARES])
            at += n


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, shares and the verdict ``kept`` per row.

    Null, empty and blank texts have no words, so they fail the base rule
    (fewer than 50 words). Each row is judged alone: repeated rows get equal
    results, an empty table gives none, other columns are ignored.
    """
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * len(SHARES)
    schema = f"doc_id {chosen.schema[0].dataType.simpleString()}, " + ", ".join(
        f"{c} {k}" for c, k in zip(COLUMNS + SHARES, kinds))
    return chosen.mapInArrow(_run, schema)


def _sql() -> str:
    lead = lambda n: ", ".join(["w", *[f"lead(w, {j}) OVER d" for j in range(1, n)]])
    lengths = (3, *NGRAM_LIMITS)
    grams = ",\n  ".join(f"CASE WHEN i + {n - 1} <= nw THEN concat_ws(' ', {lead(n)}) END AS g{n}" for n in lengths)
    seen = ",\n  ".join(
        f"CASE WHEN g{n} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, g{n}) END AS c{n}, "
        f"CASE WHEN g{n} IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) END AS r{n}" for n in lengths)
    inside = ",\n  ".join(
        f"max(CASE WHEN {'c3' if n == 3 else f'r{n}'} > 1 THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS x{n}" for n in lengths)
    shares = ", ".join(f"sum(len(w) * x{n}) AS y{n}" for n in NGRAM_LIMITS)
    out = ",\n  ".join(f"coalesce(y{n}, 0) / greatest(word_chars, 1) AS share_{n}" for n in NGRAM_LIMITS)
    within = " AND ".join(f"share_{n} <= {m}" for n, m in NGRAM_LIMITS.items())
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS nw FROM d),
g AS (SELECT doc_id, w, i,
  {grams}
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *,
  {seen} FROM g),
x AS (SELECT doc_id, w,
  {inside} FROM c),
per AS (SELECT doc_id, CAST(sum(x3) AS BIGINT) AS n_repeat_words, {shares} FROM x GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l1 AS (SELECT doc_id, len(regexp_replace(line, '{space}', '', 'g')) AS chars,
              row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
       FROM l0 WHERE regexp_matches(line, '{word}')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS dup, sum(chars) FILTER (again) AS dup_chars FROM l1 GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
                CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words,
  {out},
  coalesce(dup, 0) / greatest(coalesce(n_lines, 0), 1) AS share_lines,
  coalesce(dup_chars, 0) / greatest(word_chars, 1) AS share_line_chars
  FROM base LEFT JOIN per USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND share_lines <= {LINE_LIMIT} AND share_line_chars <= {LINE_CHARS_LIMIT} AND {within} AS kept FROM f
"""


# The same in SQL, for tables whose doc_id is unique.
SQL = _sql()
