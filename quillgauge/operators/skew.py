"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(
    many: DataFrame, one: DataFrame, keys: list[str], spread: Column, salts: int = 8, how: str = "inner"
) -> DataFrame:
    """Join a large side with a side that is unique on ``keys``.

    The large side's rows of one key are spread over ``salts`` partitions by the hash of
    ``spread``; the unique side is repeated once per salt. When the unique side is small
    enough Spark broadcasts it and the salts cost nothing but a column. Null keys are equal.
    """
    salted = many.withColumns({"_join_key": F.struct(*keys), "_salt": F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")})
    repeated = one.withColumn("_join_key", F.struct(*keys)).drop(*keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, ["_join_key", "_salt"], how).drop("_join_key", "_salt")


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null, as grouping has it; the keys appear once."""
    packed = right.withColumn("_join_key", F.struct(*keys)).drop(*keys)
    return left.withColumn("_join_key", F.struct(*keys)).join(packed, "_join_key", how).drop("_join_key")


def even_join(
    many: DataFrame, one: DataFrame, keys: list[str], spread: Column, limit: int | None = 1_000_000, how: str = "inner",
    source: DataFrame | None = None,
) -> DataFrame:
    """Join with a side unique on ``keys``, salting just the keys above ``limit`` rows.

    The rows per key are counted as part of the join, from the key columns of ``source`` (the
    frame ``many`` was derived from). The hot keys number at most rows / limit; each gets one
    salt per ``limit`` rows, on both sides. Nothing runs until the result is used; ``limit=None``
    is a plain join, for streams.
    """
    if limit is None:
        return many.join(one, keys, how)
    counted = many if source is None else source
    hot = (
        counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    repeated = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
