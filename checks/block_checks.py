"""Blocks, assets, readers and writers over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from checks import code_checks, prompt_checks, views
from checks.registry import RX_WS, check, sql_strip, table, with_
from quillgauge.functions.numbers import np_round
from quillgauge.operators import blocks as bl
from quillgauge.operators import code_metrics as cm
from quillgauge.plans import reports
from quillgauge.session import shared_folder
from quillgauge.sources import assets, readers, writers
from quillgauge.streaming import prompts as streaming

CELLS = ("cells", views.V_CELLS)
TEXT = ("tx", f"select story_id, variant, {sql_strip('cell')} as cell from cells")
B = (
    "b",
    r"""select story_id, variant, i as diagram_index, list_extract(bs, i) as block from (
  select *, unnest(generate_series(1, len(bs)))::int as i from (
  select *, case when len(found) > 0 then found when cell = '' then []
    when starts_with(lower(cell), '@startuml') or ends_with(lower(cell), '@enduml') then [cell]
    else [concat('@startuml', chr(10), cell, chr(10), '@enduml', chr(10))] end as bs
  from (select *, regexp_extract_all(cell, '(?is)@startuml\b.*?@enduml\b') as found from tx)))""",
)
_LOW = "concat(chr(10), lower(block), chr(10))"
SYNTAX = rf"""case when modern > legacy then 'activity-modern' when legacy > modern then 'activity-legacy' else 'unknown' end"""
SY = (
    "sy",
    rf"""select *, {SYNTAX} as syntax from (select *,
  case when regexp_matches(low, '(?m)^{RX_WS}*start{RX_WS}*$') then 2 else 0 end
  + case when regexp_matches(low, '(?m)^{RX_WS}*stop{RX_WS}*$') then 2 else 0 end
  + case when regexp_matches(low, ':[^:\n]+;{RX_WS}*(\n|$)') then 1 else 0 end
  + case when contains(low, 'partition ') then 1 else 0 end as legacy,
  case when regexp_matches(low, '\bif{RX_WS}*\([^)]+?\){RX_WS}*then\b') and contains(low, 'endif') then 2 else 0 end
  + case when contains(low, 'repeat') and contains(low, 'while') then 2 else 0 end
  + case when contains(low, 'fork') and (contains(low, 'end fork') or contains(low, 'endfork')) then 2 else 0 end
  + case when contains(low, 'switch') and contains(low, 'endswitch') then 2 else 0 end as modern
  from (select *, {_LOW} as low from b))""",
)
_NAME = "concat('Row', story_id + 1, case when diagram_index > 1 then concat('_D', diagram_index) else '' end, '_', substr(md5(block), 1, 6))"


def sql_safe(x):
    cleaned = f"trim(substr(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_.-]+', '_', 'g'), '_+', '_', 'g'), 1, 50), '_')"
    return f"case when {cleaned} = '' then 'unknown' else {cleaned} end"


def _blocks(spark, sf):
    text = bl.strip(F.col("cell"))
    return views.cells(spark, sf).select("story_id", "variant", F.posexplode(bl.blocks(text)).alias("i", "block")).select(
        "story_id", (F.col("i") + 1).alias("diagram_index"), "block"
    )


@check("blk1_blocks", with_(CELLS, TEXT, B, select="select story_id, diagram_index, block from b"))
def diagram_blocks(spark, sf):
    return _blocks(spark, sf)


@check("blk2_syntax_type", with_(CELLS, TEXT, B, SY, select="select story_id, diagram_index, syntax from sy"))
def syntax_type(spark, sf):
    return _blocks(spark, sf).select("story_id", "diagram_index", bl.syntax_type(F.col("block")).alias("syntax"))


@check("blk3_unique_name", with_(CELLS, TEXT, B, select=f"select story_id, diagram_index, {_NAME} as name from b"))
def unique_name(spark, sf):
    name = bl.unique_name(F.col("story_id") + 1, F.col("diagram_index"), F.col("block"))
    return _blocks(spark, sf).select("story_id", "diagram_index", name.alias("name"))


@check("blk4_safe_name", f"select doc_id, {sql_safe('text')} as name from documents")
def safe_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", bl.safe_name(F.col("text")).alias("name"))


def _sheet(spark, sf):
    return views.cells(spark, sf).select(
        F.lit("documents").alias("sheet"), (F.col("story_id") + 1).alias("row_index"), F.lit(1).alias("col_index"),
        F.col("variant").alias("column_name"), "cell",
    )


@check(
    "blk5_manifest",
    with_(CELLS, TEXT, B, SY, select="select 'documents' as sheet, story_id + 1 as row_index, 1 as col_index, variant as column_name, "
          f"diagram_index, block, syntax, concat('jpg/', {sql_safe('variant')}, '/', {_NAME}, '.jpg') as file_name from sy"),
)
def manifest(spark, sf):
    return bl.manifest(_sheet(spark, sf))


@check(
    "agg12_cell_counts",
    with_(CELLS, TEXT, B, select="select (select count(*) from tx) as total_cells, (select count(*) from tx where cell <> '') as cells_with_content, "
          "count(*) as total_diagrams, count(distinct variant) as column_folders from b"),
)
def cell_counts(spark, sf):
    sheet = _sheet(spark, sf)
    return bl.cell_counts(sheet)


FILES, STEMS = ("fl", views.V_FILES), ("sm", views.V_STEMS)


@check(
    "join5_prefix_match",
    with_(FILES, STEMS, select="select stem, folder, file, concat(folder, ' ', file) as target from fl join (select distinct stem from sm) s on starts_with(file, stem)"),
)
def prefix_match(spark, sf):
    return bl.match_prefix(views.files(spark, sf), views.stems(spark, sf))


@check(
    "join5_prefix_match_new_only",
    with_(FILES, STEMS, select="select stem, folder, file, concat(folder, ' ', file) as target from fl join (select distinct stem from sm) s "
          "on starts_with(file, stem) where folder <> 'Brand#11'"),
)
def prefix_match_new_only(spark, sf):
    files = views.files(spark, sf)
    existing = bl.match_prefix(files.filter("folder = 'Brand#11'"), views.stems(spark, sf)).select("stem", "target")
    return bl.match_prefix(files, views.stems(spark, sf), existing=existing)


@check(
    "join5_exact_match",
    with_(FILES, STEMS, select="select stem, folder, file, concat(folder, ' ', file) as target from fl join (select distinct stem from sm) s on split_part(file, '_', 1) = stem"),
)
def exact_match(spark, sf):
    return bl.match_prefix(views.files(spark, sf), views.stems(spark, sf), exact=True)


@check(
    "src7_asset_names",
    with_(FILES, select="select folder, file from fl where folder <> 'Brand#12'"),
)
def asset_names(spark, sf):
    paths = views.files(spark, sf).select(F.concat_ws("/", F.lit("report/jpg"), "folder", "file").alias("path"))
    return bl.asset_names(paths, skip=("Brand#12",)).select("folder", "file")


@check(
    "src7_listed_assets",
    "select distinct concat('folder=', p_brand) as folder, 'part-' as file from part where p_brand <> 'Brand#12'",
)
def listed_assets(spark, sf):
    """A folder of files for each brand, written from the table and listed again."""
    root = f"{shared_folder(spark)}/assets-{uuid.uuid4().hex}"
    parts = table(spark, sf, "part").select(F.translate("p_brand", "#", "-").alias("folder"), F.col("p_name").alias("value"))
    parts.repartition("folder").write.partitionBy("folder").text(root)
    found = assets.list_assets(spark, root, extensions=("txt",), skip=("folder=Brand-12",))
    return found.select(F.translate("folder", "-", "#").alias("folder"), F.substring("file", 1, 5).alias("file"))


# --- readers ---------------------------------------------------------------------------


@check(
    "src2_wide_to_long",
    "select c_custkey, variant, upper(substr(variant, 1, 3)) as model_group, code from "
    "(unpivot (select c_custkey, c_name, c_mktsegment from customer) on c_name, c_mktsegment into name variant value code)",
)
def wide_to_long(spark, sf):
    wide = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return readers.to_long(wide, ["c_custkey"])


@check(
    "src3_requested_columns",
    "select coalesce(p_name, '') as p_name, coalesce(cast(p_size as varchar), '') as p_size from part",
)
def requested_columns(spark, sf):
    return readers.select_requested(table(spark, sf, "part"), ["p_name", "p_colour", "p_size"])


@check(
    "src4_row_range",
    "select p_partkey, p_name from (select *, row_number() over (order by p_partkey) - 1 as i from part) where i >= 50 and i < 150",
)
def row_range(spark, sf):
    return readers.slice_rows(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"], 50, 150)


@check("src4_invalid_range", "select p_partkey from part")
def invalid_range(spark, sf):
    return readers.slice_rows(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], 90, 20)


@check(
    "src6_suffix_features",
    "select 'l_discount' as feature, l_discount::double as value from lineitem union all select 'l_tax', l_tax::double from lineitem",
)
def suffix_features(spark, sf):
    """Rules over a report folder that holds the table as CSV; files and columns that are not there are skipped."""
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    table(spark, sf, "lineitem").write.option("header", True).csv(f"{folder}/lines.csv")
    rules = {"statistics": [
        {"file": "lines.csv", "columns": {"include": ["_discount", "_tax", "_absent"]}},
        {"file": "absent.csv", "columns": {"include": ["_tax"]}},
    ]}
    return readers.features_by_rules(spark, folder, rules)["lines.csv"]


SOURCES = [f"src{i}" for i in range(20)]


@check(
    "snk4_wide_report",
    with_(*code_checks.COUNTED, select="select model_group, story_id, "
          + ", ".join(f"max(case when variant = '{v}' then {m} end)::double as {v}_{m}" for v in SOURCES for m in ("activities", "numberline"))
          + " from s group by all"),
)
def wide_report(spark, sf):
    metrics = cm.code_metrics(views.diagrams(spark, sf)).select(
        "model_group", "story_id", "variant", F.col("activities").cast("double"), F.col("numberline").cast("double")
    )
    return readers.to_wide(metrics, ["model_group", "story_id"], SOURCES, ["activities", "numberline"])


# --- writers ---------------------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@check(
    "snk1_written_report",
    with_(code_checks.D, select="select variant, count(*) as cells, sum(length(code))::bigint as characters from d group by 1"),
)
def written_report(spark, sf):
    totals = views.diagrams(spark, sf).groupBy("variant").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.length("code")).alias("characters")
    )
    path = writers.write_report(totals, f"{_folder(spark, 'report')}/totals", start=0, end=50)
    return spark.read.option("header", True).schema("variant string, cells bigint, characters bigint").csv(path)


@check(
    "snk2_report_tables",
    with_(*code_checks.COUNTED, select="select variant, sum(activities)::bigint as activities, count(*) as cells, "
          "(select count(*) from (" + " union all ".join(f"select 1 from s where {r[0]}" for r in code_checks._RECORDS.values()) + ")) as records "
          "from s group by variant"),
)
def report_tables(spark, sf):
    metrics = cm.code_metrics(views.diagrams(spark, sf))
    paths = writers.write_tables(
        {"main_results": metrics.drop("code"), "penalties": cm.penalty_details(metrics).drop("original_code")}, _folder(spark, "tables")
    )
    rows = spark.read.parquet(paths["main_results"])
    records = spark.read.parquet(paths["penalties"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy("variant").agg(F.sum("activities").alias("activities"), F.count(F.lit(1)).alias("cells")).withColumn("records", records)


_STREAM_SQL = prompt_checks.SCORED_SQL.replace("doc_id + 1 as row_number", "doc_id")


@check("snk3_streamed_scores", with_(*prompt_checks.ANALYSED, select=_STREAM_SQL))
def streamed_scores(spark, sf):
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    root = _folder(spark, "stream")
    documents = streaming.read_prompt_stream(spark, f"{sf.rstrip('/')}/{{documents.parquet}}", schema)
    query = streaming.score_prompt_stream(documents, f"{root}/scores", f"{root}/checkpoint", text="text")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/scores")


@check(
    "set3_distinct_sets",
    with_(code_checks.D, ("w", "select story_id, list_distinct(string_split(lower(code), ' ')) as a, list_distinct(string_split(upper(code), ' ')) as b from d"),
          select="select story_id, len(a)::bigint as distinct_a, len(list_intersect(a, b))::bigint as shared, len(list_distinct(a || b))::bigint as united from w"),
)
def distinct_sets(spark, sf):
    rows = views.diagrams(spark, sf).select(
        "story_id", F.array_distinct(F.split(F.lower("code"), " ", -1)).alias("a"), F.array_distinct(F.split(F.upper("code"), " ", -1)).alias("b")
    )
    return rows.select(
        "story_id", F.size("a").cast("long").alias("distinct_a"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"),
        F.size(F.array_union("a", "b")).cast("long").alias("united"),
    )


# --- whole reports ---------------------------------------------------------------------


@check(
    "plan_diagram_report",
    with_(CELLS, TEXT, B, SY, select="select variant as column_name, count(*) as diagrams, "
          + ", ".join(f"count(*) filter (where syntax = '{kind}') as {kind.replace('-', '_')}" for kind in bl.SYNTAX_TYPES)
          + ", count(distinct concat(story_id, ':', diagram_index)) as files, (select count(*) from tx) as total_cells, (select count(*) from tx where cell <> '') as cells_with_content "
          "from sy group by variant"),
)
def diagram_report(spark, sf):
    paths = reports.diagram_report(_sheet(spark, sf), _folder(spark, "diagrams"))
    files = spark.read.parquet(paths["manifest"]).groupBy("column_name").agg(F.count_distinct("file_name").alias("files"))
    counts = spark.read.parquet(paths["counts"]).select(F.struct("total_cells", "cells_with_content").alias("c")).scalar()
    return spark.read.parquet(paths["columns"]).join(files, "column_name").withColumns(
        {"total_cells": counts["total_cells"], "cells_with_content": counts["cells_with_content"]}
    )


@check(
    "plan_analysis_report",
    "select 'customers.csv' as file, 'ACC' as grp, count(*) as n, round_even(avg(c_acctbal), 6) + 0.0 as average from customer "
    "union all select 'customers.csv', 'NAT', count(*), round_even(avg(c_nationkey), 6) + 0.0 from customer "
    "union all select 'parts.csv', 'ABA', 2 * count(*), round_even((avg(p_size) + avg(p_retailprice)) / 2, 6) + 0.0 from part",
)
def analysis_report(spark, sf):
    root = _folder(spark, "analysis")
    parts = table(spark, sf, "part").selectExpr("p_partkey as row_id", "p_size as ABA001_score", "p_retailprice as ABA002_score")
    customers = table(spark, sf, "customer").selectExpr("c_acctbal as prompt_ACC_match_rate", "c_nationkey as prompt_NAT_match_rate")
    writers.write_report(parts, f"{root}/parts.csv")
    writers.write_report(customers, f"{root}/customers.csv")
    rules = {"statistics": [
        {"file": "parts.csv", "columns": {"include": ["_score"]}}, {"file": "customers.csv", "columns": {"include": ["_match_rate"]}},
        {"file": "absent.csv", "columns": {"include": ["_score"]}},
    ]}
    found = reports.analysis_report(spark, root, rules, ("customers.csv",))
    return found.select("file", "grp", "n", np_round(F.col("average"), 6).alias("average"))
