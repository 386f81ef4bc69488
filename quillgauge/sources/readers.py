"""Table readers, column selection and reshaping to the long form."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.operators.positions import row_index
from quillgauge.operators.prompts import raw_prompt
from quillgauge.sources.csv_records import read_records

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, read as it lies; ``spark.sql.files.maxPartitionBytes`` and
    ``spark.sql.files.minPartitionNum`` say how finely it is split."""
    return spark.read.parquet(path)


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """Story CSV (header, quoted fields over several lines, optional BOM) -> (row_number, line parts, prompt).

    Rows are numbered from 1 by file name and place in the file. Large files are split, see
    ``csv_records``; the fields are taken apart by Spark's CSV parser.
    """
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}
    names = [c.lstrip("\ufeff") for c in spark.read.options(**options).csv(path).columns]  # reads the first record
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = read_records(spark, path).withColumn("fields", F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    # a file's first record is its header
    place = F.struct("file", "block", "n").alias("_at")
    rows = parsed.filter((F.col("block") > 0) | (F.col("n") > 0)).select(place, *[F.col(f"fields.c{i}").alias(c) for i, c in enumerate(names)])
    prompts = rows.withColumn("prompt", raw_prompt(rows.drop("_at")))
    return row_index(prompts, ["_at"], "row_number").drop("_at").select("row_number", *[F.col(f"`{c}`") for c in names], "prompt")


def to_long(wide: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """Wide variant table -> (ids, variant, model_group, code).

    Without ``columns`` every string column but the ids and ``prompt`` is a variant.
    """
    if columns is None:
        columns = [n for n, kind in wide.dtypes if kind == "string" and n not in (*ids, "prompt")]
    long = wide.unpivot(ids, columns, "variant", "code")
    return long.withColumn("model_group", F.upper(F.substring("variant", 1, 3)))


def to_wide(long: DataFrame, ids: list[str], variants: list[str], metrics: list[str]) -> DataFrame:
    """Report form: one ``<variant>_<metric>`` column for each named variant and metric."""
    pivoted = long.groupBy(*ids).pivot("variant", variants).agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])
    if len(metrics) == 1:  # Spark leaves the metric out of the name when there is only one
        pivoted = pivoted.select(*ids, *[F.col(f"`{v}`").alias(f"{v}_{metrics[0]}") for v in variants])
    return pivoted


def select_requested(df: DataFrame, requested: list[str]) -> DataFrame:
    """The requested columns that exist, as text with nulls empty; the others are logged."""
    missing = [c for c in requested if c not in df.columns]
    if missing:
        log.warning("missing columns: %s", missing)
    present = [c for c in requested if c in df.columns]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in present])


def select_suffixes(df: DataFrame, suffixes: list[str]) -> list[str]:
    """Columns that end with one of the suffixes, in suffix order."""
    found = [c for s in suffixes for c in df.columns if c.endswith(s)]
    if not found:
        log.warning("no column ends with %s", suffixes)
    return found


def features_by_rules(spark: SparkSession, report_dir: str, rules: dict) -> dict[str, DataFrame]:
    """Apply ``{"statistics": [{"file", "columns": {"include": [suffix]}}]}`` to a report folder.

    Returns (feature, value) rows per file; a missing file or no matching column is skipped. Any
    other trouble with a file is raised.
    """
    result = {}
    for entry in rules.get("statistics", []):
        path = f"{report_dir.rstrip('/')}/{entry['file']}"
        try:
            df = spark.read.option("header", True).csv(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("skipping %s: %s", path, str(error)[:200])
            continue
        columns = select_suffixes(df, entry.get("columns", {}).get("include", []))
        if columns:
            result[entry["file"]] = to_features(df, columns)
    return result


def to_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns -> (feature, value); text that is no number becomes null."""
    numbers = df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    return numbers.unpivot([], columns, "feature", "value")


def slice_rows(df: DataFrame, order: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows ``[start, end)`` by a unique order key, clamped; an empty range returns all rows."""
    if start is None and end is None:
        return df
    numbered = row_index(df, order, "_row")
    low = F.lit(max(0, int(start or 0)))
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    high = total if end is None else F.least(F.lit(int(end)), total)
    inside = (F.col("_row") > low) & (F.col("_row") <= high)
    return numbered.filter((low >= high) | inside).drop("_row")


def column_groups(columns: list[str], minimum: int = 2) -> dict[str, list[str]]:
    """Column names by their upper-cased first three characters, groups of ``minimum`` and more."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        if len(c) >= 3:
            groups.setdefault(c[:3].upper(), []).append(c)
    return {prefix: names for prefix, names in groups.items() if len(names) >= minimum}


def grouped_variants(variants: DataFrame, minimum: int = 2) -> DataFrame:
    """Rows whose variant belongs to a group of at least ``minimum`` distinct variants.

    Distinct variants are few (they are column names), so the group list is small.
    """
    prefix = F.upper(F.substring("variant", 1, 3))
    named = variants.filter(F.length("variant") >= 3).withColumn("model_group", prefix)
    groups = (
        named.select("model_group", "variant").distinct()
        .groupBy("model_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
        .agg(F.collect_list("model_group").alias("_groups")).scalar()
    )
    return named.filter(F.array_contains(groups, F.col("model_group")))
