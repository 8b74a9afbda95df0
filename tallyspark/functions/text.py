"""Text predicates and string helpers with the application's semantics.

Text comparison in the source database is case- and accent-insensitive, and
user input to ``LIKE`` is not escaped, so ``%``, ``_`` and ``\\`` typed by a
user keep their ``LIKE`` meaning. ``search_filter`` folds both sides the same
way whatever the term holds: lower case, letters without diacritics (a table
built by rule from Unicode decompositions), combining marks removed.
Names are sorted by the same fold, ties by the text as stored.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters PHP's trim() strips by default.
PHP_TRIM_CHARS = " \t\n\r\0\x0b"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def php_trim(col: str | Column) -> Column:
    """trim() with PHP's character set (space, tab, LF, CR, NUL, VT)."""
    return F.btrim(_c(col), F.lit(PHP_TRIM_CHARS))


def php_trim_text(value: str | None) -> str | None:
    return None if value is None else value.strip(PHP_TRIM_CHARS)


def is_blank_php(value) -> bool:
    """PHP ``empty()`` on a request parameter: None, '' and '0' are all empty."""
    return value is None or value == "" or value == "0"


def text_present(col: str | Column) -> Column:
    """SQL test used by the dashboard ranking: not NULL and not ''."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


def php_empty(col: str | Column) -> Column:
    """PHP ``empty()`` of a string: NULL, '' and '0'."""
    c = _c(col)
    return c.isNull() | (c == F.lit("")) | (c == F.lit("0"))


def _accent_table() -> tuple[str, str]:
    """Letters of any script with diacritics -> their base letter, built by rule
    from Unicode canonical decomposition, and one form of sigma; combining marks
    have no counterpart (``translate`` drops them). Hangul syllables, made of
    several letters, stay."""
    src, dst = ["Σ", "ς"], ["σ", "σ"]
    marks = set(map(chr, range(0x300, 0x370)))
    for ch in map(chr, range(0xC0, sys.maxunicode + 1)):
        base, *rest = unicodedata.normalize("NFD", ch)
        kinds = {unicodedata.category(c) for c in rest}
        if base != ch and unicodedata.category(ch)[0] == unicodedata.category(base)[0] == "L" and kinds <= {"Mn"}:
            src.append(ch)
            dst.append(base)
            marks.update(rest)
    return "".join(src) + "".join(sorted(marks)), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold_accents(col: str | Column) -> Column:
    """Lower-case and strip diacritics (é -> e), with built-in functions."""
    return F.lower(F.translate(_c(col), _ACCENTED, _PLAIN))


def _fold_text(text: str) -> str:
    folded = {ord(c): None for c in _ACCENTED[len(_PLAIN):]} | dict(zip(map(ord, _ACCENTED), _PLAIN))
    return text.translate(folded).lower()


def by_name(col: str) -> list[Column]:
    """Sort keys of a name: as the source database compares text, then as stored."""
    return [fold_accents(col).asc_nulls_first(), F.col(col).asc_nulls_first()]


def like_pattern(term: str) -> str:
    """``%term%`` as the database reads it, for Spark's ``like``.

    A backslash makes the next character literal, also the closing ``%`` after
    a trailing one. Spark accepts a backslash only before ``%``, ``_`` and
    itself, so the pattern is written anew with just those.
    """
    out, rest = [], iter("%" + term + "%")
    for ch in rest:
        if ch == "\\":
            ch = next(rest)
            out.append("\\" + ch if ch in "%_\\" else ch)
        else:
            out.append(ch)
    return "".join(out)


def search_filter(col: str | Column, term: str | None, trim: bool = True) -> Column | None:
    """Substring search predicate, or None when the term means "no filter".

    ``trim`` follows the page: product and ingredient searches are trimmed,
    the sales search is not. A term that is empty in PHP's sense after
    trimming (None, '' or '0') applies no filter.
    """
    if term is None:
        return None
    if trim:
        term = php_trim_text(term)
    if is_blank_php(term):
        return None
    return fold_accents(col).like(like_pattern(_fold_text(term)))


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()


def ascii_lower(col: str | Column) -> Column:
    """PHP 8 ``strtolower``: only A-Z change (Spark's ``lower`` is Unicode-aware)."""
    return F.translate(_c(col), _UPPER, _LOWER)


def ucfirst(col: str | Column) -> Column:
    """PHP 8 ``ucfirst``: upper-case the first character if it is a-z; the
    rest is unchanged (not ``initcap``, which changes every word)."""
    c = _c(col)
    return F.concat(F.translate(F.substring(c, 1, 1), _LOWER, _UPPER), F.substring(c, 2, 1 << 30))
