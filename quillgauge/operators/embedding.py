"""Embeddings from a caller's encoder, for users who bring no vector column."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_embedding(
    df: DataFrame, text: str, encode: Callable[[Sequence[str]], Sequence[Sequence[float]]], name: str = "embedding"
) -> DataFrame:
    """Add ``encode(texts)`` batch by batch; null text is encoded as empty."""

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([list(map(float, v)) for v in encode(part.fillna("").tolist())])

    embed = F.pandas_udf(batches, T.ArrayType(T.FloatType()))
    return df.withColumn(name, embed(F.col(text)))
