"""The whole reports: each takes input tables and writes or returns its result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.operators import blocks as bl
from quillgauge.operators import code_metrics as cm
from quillgauge.operators import correspondence as co
from quillgauge.operators import pairs as pz
from quillgauge.operators import prompts as pr
from quillgauge.operators import ranking, selection, stats
from quillgauge.sources.readers import features_by_rules, grouped_variants, slice_rows
from quillgauge.sources.writers import write_tables


def prompt_report(stories: DataFrame, text: str = "prompt") -> dict[str, DataFrame]:
    """Scored prompts, standard prompts and the run counters."""
    scored = pr.stamp(pr.score_prompts(stories, text))
    return {
        "scored_prompts": scored,
        "standard_prompts": pr.standard_prompt_table(stories, text),
        "run_counts": pr.run_counts(stories, text),
    }


def syntax_report(variants: DataFrame, root: str) -> dict[str, str]:
    """Metric rows, parameter summary, penalty details, averages and statistics below ``root``.

    The metric rows are written first and read back, so the code is parsed once.
    """
    spark = variants.sparkSession
    metrics = cm.code_metrics(variants.withColumn("null_code", F.col("code").isNull()))
    written = write_tables({"metric_rows": metrics}, root)
    rows = spark.read.parquet(written["metric_rows"])
    numeric = [*cm.COUNTS, "negative_score", *cm.SCORES, "decisions_activities_ratio", "lines_vs_average"]
    main = cm.with_lines_vs_average(rows, F.col("null_code"))
    by_column = main.unpivot(
        ["variant"], [F.col(n).cast("double").alias(n) for n in numeric], "metric", "value"
    ).select(F.concat_ws("_", "variant", "metric").alias("column"), "value")
    return written | write_tables(
        {
            "main_results": main.drop("null_code", "penalties", "code"),
            "parameters_summary": cm.variant_totals(rows),
            "negative_scores_details": cm.penalty_details(rows.drop("null_code")),
            "average_metrics": cm.average_metrics(rows.filter(~F.col("null_code"))),
            "statistical_metrics": stats.column_statistics(by_column),
        },
        root,
    )


def similarity_report(
    variants: DataFrame, root: str, cross_groups: bool = False, vector: str | None = None,
    start: int | None = None, end: int | None = None,
) -> dict[str, str]:
    """Pair table and its statistics for the groups of at least two variants.

    Stories ``[start, end)`` by id are compared. With ``cross_groups`` the inter sample is computed
    too, which is every pair of all columns.
    """
    spark = variants.sparkSession
    variants = grouped_variants(variants)
    if start is not None or end is not None:
        stories = slice_rows(variants.select("story_id").distinct(), ["story_id"], start, end)
        variants = variants.join(stories, "story_id", "left_semi")
    names = ["jaccard", "levenshtein", "tfidf", "bm25", *(["embedding"] if vector else []), "mean", "weighted"]
    within = ("story_id",) if cross_groups else ("story_id", "model_group")
    pairs = pz.pair_similarity(variants, within=within, vector=vector)
    if not cross_groups:
        pairs = pairs.withColumns({"group_a": F.col("model_group"), "group_b": F.col("model_group")})
    written = write_tables({"pair_similarity": pz.label_pairs(pairs)}, root)
    rows = spark.read.parquet(written["pair_similarity"])
    return written | write_tables({"pair_statistics": stats.pair_statistics(rows, names)}, root)


def correspondence_report(variants: DataFrame, stories: DataFrame, root: str, **vectors: str) -> dict[str, str]:
    """Correspondence rows and the statistics of every ``prompt_<variant>_<metric>`` column."""
    spark = variants.sparkSession
    written = write_tables({"correspondence": co.correspondence(variants, stories, **vectors)}, root)
    rows = spark.read.parquet(written["correspondence"])
    names = ["similarity", "quality", "match_rate", "bleu", "rouge_l"] if vectors else ["quality", "bleu", "rouge_l"]
    long = rows.unpivot(["variant"], names, "name", "value").select(
        F.concat_ws("_", F.lit("prompt"), "variant", "name").alias("metric"), "value"
    )
    return written | write_tables({"statistics": stats.metric_statistics(long)}, root)


def statistics_report(reports: dict[str, DataFrame], prompted: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Rank the features and groups of several (feature, value) tables and summarise them.

    ``prompted`` names the prompt-code reports among them.
    """
    features, groups = {}, {}
    for source, long in reports.items():
        found = stats.feature_statistics(long, ["feature"]).withColumn(
            "grp", stats.feature_group(F.col("feature"), source in prompted)
        )
        features[source] = ranking.add_ranking(found, "feature")
        groups[source] = stats.group_statistics(found)
    merged = ranking.merge_reports(groups)
    summary = ranking.add_ranking(ranking.cross_report_summary(merged), "grp")
    return {f"features_{s}": df for s, df in features.items()} | {
        "groups": ranking.add_ranking(merged, "grp"),
        "summary": summary,
        "summary_lines": ranking.summary_lines(summary),
    }


def selection_report(
    scored: DataFrame, root: str, score: str = "score", key: str = "id", samples: int = 9, seed: int = 42
) -> dict[str, str]:
    """A stratified sample for human assessment, its summary and its check, below ``root``.

    The sample (key, score, stratum) is written first; summary and check read it back, so the
    strata are found once. The check compares mean and sample deviation with those of all rows.
    """
    spark = scored.sparkSession
    written = write_tables({"selected_prompts": selection.stratified_sample(scored, score, key, samples, seed)}, root)
    chosen = spark.read.parquet(written["selected_prompts"])
    facts = chosen.agg(F.struct(F.count(F.lit(1)).alias("n"), F.stddev_samp(score).alias("std")).alias("s")).scalar()
    total = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    check = selection.representativeness(scored, chosen, score).withColumns(
        {"selection_std": facts["std"], "n_selected": facts["n"], "n_population": total}
    )
    return written | write_tables(
        {"selection_summary": selection.selection_summary(chosen, score), "selection_check": check}, root
    )


def diagram_report(cells: DataFrame, root: str, folder: str = "jpg") -> dict[str, str]:
    """The manifest of all diagrams with their target files, its counters and its columns, below ``root``.

    ``cells`` are long cells (sheet, row_index, col_index, column_name, cell). The manifest is the
    work list of a renderer: every block with syntax, stamp, format and path. The blocks of the cells
    are found once for it; the column table reads it back.
    """
    spark = cells.sparkSession
    listed = pr.stamp(bl.manifest(cells, folder), "listed_at").withColumn("output_format", F.lit("JPEG"))
    written = write_tables({"manifest": listed, "counts": bl.cell_counts(cells)}, root)
    of = {kind: F.count(F.when(F.col("syntax") == kind, 1)).alias(kind.replace("-", "_")) for kind in bl.SYNTAX_TYPES}
    columns = spark.read.parquet(written["manifest"]).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("diagrams"), *of.values()
    )
    return written | write_tables({"columns": columns}, root)


def analysis_report(spark: SparkSession, report_dir: str, rules: dict, prompted: tuple[str, ...] = ()) -> DataFrame | None:
    """Averages of the columns that the rules name in each report file: (file, grp, n, average).

    ``prompted`` names the prompt-code files. Null when no file has a column that fits.
    """
    parts = [
        long.select(F.lit(file).alias("file"), stats.feature_group(F.col("feature"), file in prompted).alias("grp"), "value")
        for file, long in features_by_rules(spark, report_dir, rules).items()
    ]
    return stats.report_averages(reduce(DataFrame.unionByName, parts), ["file", "grp"]) if parts else None
