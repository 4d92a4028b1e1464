"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A size in tokens of a text column; null texts count nothing.
Sizer = Callable[[Column], Column]


def byte_tokens(text: Column) -> Column:
    """Byte-level tokenizer without special tokens: one token per UTF-8 byte."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def vocabulary_tokens(path: str) -> Sizer:
    """Sizes by a ``tokenizers`` JSON file at ``path``, which every executor can read. Whole texts are encoded."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return count
