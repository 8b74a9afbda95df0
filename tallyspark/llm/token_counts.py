"""Operator 5: token counts of whole texts.

An Arrow function encodes each batch and returns lengths only: long texts are
split at safe boundaries, and the parts are worked in batches balanced by size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import tokens

LIMIT = 1024


def _lengths(path: str):
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tokens.Encoder(path)
        for texts in batches:
            yield pd.Series(encoder.lengths(texts.tolist()), dtype="int64")
    return F.pandas_udf(lengths, "long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row.

    A null text counts as empty (0 bytes, 0 tokens); bytes that are no valid
    UTF-8 are counted as they are and encoded as U+FFFD. Special strings inside a
    text become one token, the library's default. Repeated rows are counted
    each; other columns are ignored.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    counted = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                          _lengths(tokenizer or tokens.default_path())(F.make_valid_utf8(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
