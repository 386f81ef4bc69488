"""Longest-common-subsequence UDFs: the one text measure Spark has no expression for.

Both run on pairs Spark has already joined. A row of the dynamic program is one Python
integer, so a step handles a whole row of characters or words at machine-word speed.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyro 2004)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, item in enumerate(a):
        masks[item] = masks.get(item, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for item in b:
        hit = row & masks.get(item, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _text_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[(x, y)] = lcs_length(x, y)
        out.append(seen[(x, y)])
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.LongType())
def _token_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b)],
        dtype="Int64",
    )


def text_lcs(a: Column, b: Column) -> Column:
    """LCS length of two strings by character; equal texts never reach Python."""
    differ = a != b
    return F.coalesce(_text_lcs(F.when(differ, a), F.when(differ, b)), F.length(a).cast("long"))


def token_lcs(a: Column, b: Column) -> Column:
    """LCS length of two token arrays; equal arrays never reach Python."""
    differ = a != b
    return F.coalesce(_token_lcs(F.when(differ, a), F.when(differ, b)), F.size(a).cast("long"))
