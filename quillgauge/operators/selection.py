"""Strata by score order, a stratified sample, its summary and its representativeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.operators.positions import row_index


def strata(df: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """Low, Medium and High by exact position in score order: the first quarter, half, quarter.

    Missing scores come last. Ties straddle a border, so the position is counted over (score, id);
    it is found range by range, never in one sorted task.
    """
    known = df.withColumn("_missing", F.col(score).isNull() | F.isnan(F.col(score).cast("double")))
    ranked = row_index(known, ["_missing", score, key], "_position").drop("_missing")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    low, high = F.floor(total * 0.25), F.floor(total * 0.75)
    stratum = F.when(F.col("_position") <= low, "Low").when(F.col("_position") <= high, "Medium").otherwise("High")
    return ranked.withColumn("stratum", stratum).drop("_position")


def _quotas(total: Column, samples: int) -> dict[str, Column]:
    """Rows wanted per stratum: 2 / 4 / 3, the shortfall to Medium, then to High."""
    low_size = F.floor(total * 0.25)
    medium_size = F.floor(total * 0.75) - low_size
    high_size = total - F.floor(total * 0.75)
    low = F.least(F.lit(2), low_size)
    medium = F.least(F.lit(4), medium_size)
    high = F.least(F.lit(3), high_size)
    medium = medium + F.least(F.greatest(F.lit(samples) - low - medium - high, F.lit(0)), medium_size - medium)
    high = high + F.least(F.greatest(F.lit(samples) - low - medium - high, F.lit(0)), high_size - high)
    return {"Low": low, "Medium": medium, "High": high}


def stratified_sample(df: DataFrame, score: str = "score", key: str = "id", samples: int = 9, seed: int = 42) -> DataFrame:
    """Sample without replacement in each stratum, in the order of a seeded hash of the id.

    The literal bound on the row number lets every task keep only its own first rows.
    """
    marked = strata(df, score, key)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    drawn = marked.withColumn("_order", order).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("stratum").orderBy("_order", key))
    ).filter(F.col("_rn") <= samples)
    quota = F.lit(0)
    for name, count in _quotas(total, samples).items():
        quota = F.when(F.col("stratum") == name, count).otherwise(quota)
    return drawn.filter(F.col("_rn") <= quota).select(key, score, "stratum")


def selection_summary(selected: DataFrame, score: str = "score") -> DataFrame:
    """Count, minimum, maximum, mean and range per stratum and over the whole selection."""
    return selected.rollup("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"), (F.max(score) - F.min(score)).alias("score_range"),
    ).withColumn("stratum", F.coalesce("stratum", F.lit("TOTAL")))


def representativeness(population: DataFrame, selected: DataFrame, score: str = "score") -> DataFrame:
    """Whether the selection's mean lies within a tenth of the population's sample deviation."""
    sample_mean = selected.agg(F.avg(score).alias("m")).scalar()
    facts = population.agg(F.avg(score).alias("population_mean"), F.stddev_samp(score).alias("population_std"))
    gap = F.abs(F.col("population_mean") - F.col("selection_mean"))
    return facts.withColumn("selection_mean", sample_mean).withColumns(
        {"difference": gap, "representative": gap < 0.1 * F.col("population_std")}
    )
