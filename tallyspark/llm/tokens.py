"""Exact token ids of the byte-level BPE vocabulary.

A cut before a space that a non-space character follows never changes the
result: the pre-tokeniser looks only ahead, a single space always joins what
follows, and the special string holds no space. Long texts are split there.

Two public libraries give the same ids for one vocabulary. ``tiktoken`` is
about three times as fast, so it encodes plain text; whatever holds
a character outside ``PLAIN`` (where the two libraries' Unicode tables could
differ) or the special string goes to ``tokenizers``, the defining library.
``tests/llm/test_token_counts.py`` compares the two.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Latin letters, digits, ASCII and general punctuation, euro sign.
PLAIN = r"\x00-ɏ‐-‧€"
_CUT = re.compile(r" (?=\S)")
# The library is given batches of about so many bytes, and long texts in parts
# of at least so many characters.
BATCH_BYTES = 1 << 18
PART_CHARS = 1 << 16


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def balanced(items: Iterable[str], limit: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Consecutive batches of about ``limit`` bytes of UTF-8; longer items stand alone."""
    batch, n = [], 0
    for x in items:
        size = len(x.encode())
        if batch and n + size > limit:
            yield batch
            batch, n = [], 0
        batch.append(x)
        n += size
    if batch:
        yield batch


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """A long text in parts that end at safe cuts, none shorter than ``size``
    but the last; text without a safe cut stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at:m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _engines(path: str):
    """The defining library, and the fast one (None if merges aren't in id order)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = re.compile(f"[{PLAIN}]*")
    specials = [t["content"] for t in spec.get("added_tokens", ())]
    alphabet = _byte_alphabet()
    special = set(specials)
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    fast = None
    if all(vocab[m] == 256 + i for i, m in enumerate(merged)) and len(vocab) == 256 + len(merged):
        ranks = {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}
        fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return library, fast, plain, specials


class Encoder:
    """Ids of whole texts, as ``numpy`` arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.library, self.fast, self.plain, self.specials = _engines(path)

    def _is_plain(self, text: str) -> bool:
        return bool(self.fast and self.plain.fullmatch(text)) and not any(s in text for s in self.specials)

    def _part(self, text: str) -> np.ndarray:
        if self._is_plain(text):
            return self.fast.encode_to_numpy(text)
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str) -> np.ndarray:
        found = [self._part(x) for x in parts(text)]
        return (found[0] if len(found) == 1 else np.concatenate(found)).astype("<u4", copy=False)

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts only; parts go to the libraries in batches of about ``BATCH_BYTES``."""
        owner, pieces = [], []
        for i, text in enumerate(texts):
            for x in parts(text):
                owner.append(i)
                pieces.append(x)
        counts, at = np.zeros(len(texts), np.int64), 0
        for batch in balanced(pieces):
            plain = np.array([self._is_plain(x) for x in batch], bool)
            found = np.zeros(len(batch), np.int64)
            if plain.any():
                found[plain] = [len(x) for x in self.fast.encode_ordinary_batch([x for x, p in zip(batch, plain) if p], num_threads=1)]
            if not plain.all():
                rest = [x for x, p in zip(batch, plain) if not p]
                found[~plain] = [len(x.ids) for x in self.library.encode_batch(rest, add_special_tokens=False)]
            np.add.at(counts, owner[at:at + len(batch)], found)
            at += len(batch)
        return counts.tolist()
