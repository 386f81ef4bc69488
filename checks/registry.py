"""Registry of checked queries: a Spark callable and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgauge.functions.text import WHITESPACE, WORD, WS
from quillgauge.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; the decorated function receives (spark, sf_dir)."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    local = spark.sparkContext.master.startswith("local[")  # the small test files have one row group
    return df.repartition(slots) if local and df.rdd.getNumPartitions() < slots else df


# --- SQL text helpers -------------------------------------------------------------------

SPACE_CHARS = WHITESPACE.replace("'", "''")


def sql_strip(x: str) -> str:
    return f"trim({x}, '{SPACE_CHARS}')"


def sql_np_round(x: str, digits: int) -> str:
    m = f"{10**digits}.0::double"
    return f"(round_even(({x})::double * {m}, 0) / {m} + 0.0::double)"


def sql_py_round(x: str, digits: int) -> str:
    """Python's round: the split product finds out whether a tie is a real one."""
    m = f"{10**digits}.0::double"
    c = "134217729.0::double"
    high = f"(v * {c} - (v * {c} - v))"
    error = f"(({high} * {m} - v * {m}) + (v - {high}) * {m})"
    body = (
        f"case when v * {m} - floor(v * {m}) = 0.5 and {error} > 0 then ceil(v * {m}) "
        f"when v * {m} - floor(v * {m}) = 0.5 and {error} < 0 then floor(v * {m}) "
        f"else round_even(v * {m}, 0) end / {m} + 0.0::double"
    )
    return f"list_transform([({x})::double], lambda v: {body})[1]"


RX_WS = f"[{WS}]"
RX_WORD = f"[{WORD}]"
RX_NOT_WORD = f"[^{WORD}]"


def with_(*ctes: tuple[str, str], select: str) -> str:
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in ctes) + "\n" + select
