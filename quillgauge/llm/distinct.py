"""One row of each key without shuffling the rows of keys that occur once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.session import materialize

#: Rows of a table that is broadcast only after it was counted.
BROADCAST_ROWS = 100_000
#: Bytes of the strings of such a table, beside which the rest of a row is small.
BROADCAST_BYTES = 16 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a stored table may be broadcast, by its counted rows and the counted bytes of its strings."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"]
    size = sum(texts, F.lit(0)).cast("long")
    rows, held = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def if_small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast where it is counted to be small."""
    return F.broadcast(table) if is_small(table) else table


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each combination of ``keys``, which are not null.

    Only rows of repeated keys are shuffled; those of one key combine before.
    """
    again = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = F.broadcast(again) if few else again
    once = rows.join(again, keys, "left_anti").select(*rows.columns)
    return once.union(rows.join(again, keys, "left_semi").select(*rows.columns).dropDuplicates(keys))
