"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("TIDEWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def with_tokens(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Adds ``tokens`` to rows with ``text``; null and empty texts have none. Texts are encoded whole."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            sizes: list[int] = []
            values = b.fillna("").tolist()
            for i in range(0, len(values), 256):
                sizes += [len(e.ids) for e in tok.encode_batch(values[i : i + 256], add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int32")

    return texts.withColumn("tokens", F.pandas_udf(count, "int")("text"))
