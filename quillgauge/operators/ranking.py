"""Quality score, ranking, interpretation, merging and the summary of statistics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.functions.numbers import py_round
from quillgauge.operators.stats import group_statistics


def quality_score(df: DataFrame) -> DataFrame:
    """0 to 5 points; a null earns nothing."""

    def point(test: Column, worth: int = 1) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), worth).otherwise(0)

    shape = (F.abs("skewness") < 1) & (F.abs("kurtosis") < 3)
    score = (
        point(F.col("std_mean") < 0.5)
        + point(F.col("shapiro_p") >= 0.05)
        + point(F.col("missing") < 0.05, 2)
        + point(shape)
    )
    return df.withColumn("score", score.cast("int"))


def add_ranking(df: DataFrame, name: str) -> DataFrame:
    """Rank 1..n by score, then Shapiro p (nulls last), then name.

    The rows are statistics of report columns, already aggregated: one global window is fine.
    """
    order = Window.orderBy(F.desc("score"), F.desc_nulls_last("shapiro_p"), F.col(name))
    return quality_score(df).withColumn("ranking", F.row_number().over(order))


def top_features(ranked: DataFrame, count: int = 10) -> DataFrame:
    """The best ranked features with their summary line."""
    line = F.concat(
        F.format_string("%d. %s (Mean=%s, Std=%s, ", "ranking", "feature", _fixed("mean", 2), _fixed("std_dev", 2)),
        F.format_string("Shapiro p=%s, Score=%d)", _fixed("shapiro_p", 3), "score"),
    )
    return ranked.orderBy("ranking").limit(count).select("ranking", "feature", line.alias("line"))


def _fixed(column: str | Column, digits: int) -> Column:
    """Fixed decimals; a missing number prints as nan."""
    c = F.col(column) if isinstance(column, str) else column
    rounded = py_round(c, digits)
    sign = F.when((c < 0) & (rounded == 0), "-").otherwise("")  # a small negative prints as -0.00
    return F.when(c.isNull() | F.isnan(c), "nan").when(c == float("inf"), "inf").otherwise(
        F.concat(sign, F.format_string(f"%.{digits}f", rounded))
    )


def interpretation(df: DataFrame) -> Column:
    """Verbal labels of variance, normality, missingness and shape. The texts."""
    c = F.col
    shape_known = c("skewness").isNotNull() & c("kurtosis").isNotNull()
    return F.concat_ws(
        "; ",
        F.when(c("std_mean") < 0.5, "Stable variance").otherwise("High variance"),
        F.when(c("shapiro_p") >= 0.05, "Likely normal distribution").otherwise("Non-normal distribution"),
        F.when(c("missing") < 0.05, "Low missingness").when(c("missing") < 0.2, "Moderate missingness")
        .when(c("missing").isNotNull(), "High missingness"),
        F.when(shape_known & (F.abs("skewness") < 1) & (F.abs("kurtosis") < 3), "Moderate shape")
        .when(shape_known, "Irregular shape"),
    )


def group_lines(ranked: DataFrame, group: str = "grp") -> DataFrame:
    """One line per group of a single report."""
    line = F.concat(
        F.lit("Group "), F.col(group), F.lit(" → Mean="), _fixed("mean", 2), F.lit(", Std="), _fixed("std_dev", 2),
        F.lit(", Skew="), _fixed("skewness", 2), F.lit(", Kurt="), _fixed("kurtosis", 2),
        F.lit(", Missing%="), _fixed(F.col("missing") * 100.0, 2), F.lit(", Rank="), F.col("ranking"),
    )
    return ranked.select("ranking", group, line.alias("line"))


def summary_lines(ranked: DataFrame, group: str = "grp") -> DataFrame:
    """The summary text, one line per group in rank order."""
    line = F.concat(
        F.format_string("Rank %d (Score=%d) → Group %s: ", "ranking", "score", group),
        F.lit("Mean="), _fixed("mean", 2), F.lit(", Std="), _fixed("std_dev", 2),
        F.lit(", Std/Mean="), _fixed("std_mean", 2), F.lit(", Shapiro-Wilk p="), _fixed("shapiro_p", 3),
        F.lit(", Skew="), _fixed("skewness", 2), F.lit(", Kurt="), _fixed("kurtosis", 2),
        F.lit(", Missing%="), _fixed(F.col("missing") * 100.0, 2), F.lit(" → "), interpretation(ranked),
    )
    return ranked.select("ranking", group, line.alias("line"))


def merge_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Union of the group statistics of several reports with their source label."""
    merged = None
    for source, df in reports.items():
        labelled = df.withColumn("source", F.lit(source))
        merged = labelled if merged is None else merged.unionByName(labelled, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no report to merge")
    return merged


def cross_report_summary(merged: DataFrame, group: str = "grp") -> DataFrame:
    """Mean of the group statistics over all reports."""
    return group_statistics(merged, group)
