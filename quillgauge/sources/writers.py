"""Report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_range(name: str, start: int | None = None, end: int | None = None) -> str:
    """``name_range_<start>_<end>`` when a row range was asked for; the extension stays."""
    if start is None and end is None:
        return name
    root, dot, extension = name.rpartition(".")
    if not dot or "/" in extension:
        root, dot, extension = name, "", ""
    low = "" if start is None else start
    high = "" if end is None else end
    return f"{root}_range_{low}_{high}{dot}{extension}"


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested types: arrays and structs are written as JSON."""
    nested = [n for n, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    return df.withColumns({n: F.to_json(n) for n in nested}) if nested else df


def write_report(df: DataFrame, path: str, fmt: str = "csv", start: int | None = None, end: int | None = None) -> str:
    """Write one report table and return where it went."""
    target = with_range(path, start, end)
    writer = df.write if fmt != "csv" else _flat(df).write.option("header", True).option("escape", '"')
    writer.mode("overwrite").format(fmt).save(target)
    return target


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """A report of several tables: one folder per table below ``root``."""
    return {name: write_report(df, f"{root.rstrip('/')}/{name}", fmt) for name, df in tables.items()}
