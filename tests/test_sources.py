"""Readers, writers, the stream and the whole reports."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from quillgauge.operators import prompts as pr
from quillgauge.plans import reports
from quillgauge.sources import assets, readers, writers
from quillgauge.streaming import prompts as streaming


def test_story_csv_with_bom_and_quotes(spark, tmp_path):
    path = tmp_path / "stories.csv"
    path.write_text('﻿story\n"first, with comma "\n"two\nlines"\n"say ""hi"""\n', encoding="utf-8")
    assert [r.prompt for r in readers.read_stories(spark, str(path)).collect()] == ["first, with comma", "two\nlines", 'say "hi"']
    path.write_text("id,text,query\n1,,from query\n2, direct ,x\n3,,\n", encoding="utf-8")
    assert [r.prompt for r in readers.read_stories(spark, str(path)).collect()] == ["from query", "direct", "3"]


def test_wide_long_wide(spark):
    wide = spark.createDataFrame([(1, "p", "a", None), (2, "q", "b", "c")], "story_id long, prompt string, GBT001 string, GBT002 string")
    long = readers.to_long(wide, ["story_id"])
    assert long.count() == 4 and {r.model_group for r in long.collect()} == {"GBT"}
    back = readers.to_wide(long, ["story_id"], ["GBT001", "GBT002"], ["code"])
    assert back.columns == ["story_id", "GBT001_code", "GBT002_code"] and back.count() == 2
    assert readers.column_groups(["GBT001", "gbt2", "CLD001", "x"]) == {"GBT": ["GBT001", "gbt2"]}


def test_feature_rules_skip_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,x_score,y_score\n1,2,n/a\n2,4,5\n")
    rules = {"statistics": [{"file": "a.csv", "columns": {"include": ["_score"]}}, {"file": "b.csv", "columns": {"include": ["_score"]}},
                            {"file": "a.csv", "columns": {"include": ["_none"]}}]}
    found = readers.features_by_rules(spark, str(tmp_path), rules)
    assert list(found) == ["a.csv"]
    assert sorted((r.feature, r.value) for r in found["a.csv"].collect() if r.value is not None) == [("x_score", 2.0), ("x_score", 4.0), ("y_score", 5.0)]


def test_range_names():
    assert writers.with_range("r/out.csv") == "r/out.csv"
    assert writers.with_range("r/out.csv", 0, 50) == "r/out_range_0_50.csv"
    assert writers.with_range("r/out", None, 5) == "r/out_range__5"


def test_asset_listing(spark, tmp_path):
    for name in ("GBT001/Row1_a.jpg", "GBT001/Row2_b.JPEG", "GBT001/log.csv", "ABC001/Row1.jpg", "merge/Row1/x.jpg"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")
    got = {(r.folder, r.file) for r in assets.list_assets(spark, str(tmp_path), skip=("ABC001", "merge")).collect()}
    assert got == {("GBT001", "Row1_a.jpg"), ("GBT001", "Row2_b.JPEG"), ("Row1", "x.jpg")}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"The System creates Item {i}") for i in range(40)] + [(99, " ")], "id long, prompt string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_prompt_stream(spark, str(tmp_path / "in"), rows.schema, files=1)
    streaming.score_prompt_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pr.score_prompts(rows).collect()))


def test_streamed_scores_of_a_table_in_one_file_and_in_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"The System creates Item {i}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    expected = sorted(map(tuple, pr.score_prompts(rows, "text").collect()))
    for kind in ("folder", "file"):
        assert sorted(map(tuple, entry_module.queries()["snk3_streamed_scores"](spark, str(tmp_path / kind)).collect())) == expected


def test_whole_reports(spark, tmp_path):
    code = "@startuml\nstart\n:step {};\n:then wait;\nstop\n@enduml"
    variants = spark.createDataFrame(
        [(s, v[:3], v, code.format(s * k)) for s in range(4) for k, v in enumerate(["GBT001", "GBT002", "CLD001", "CLD002"])],
        "story_id long, model_group string, variant string, code string",
    )
    stories = spark.createDataFrame([(s, f"Start step {s} and stop the system") for s in range(4)], "story_id long, prompt string")
    syntax = reports.syntax_report(variants, str(tmp_path / "syntax"))
    assert spark.read.parquet(syntax["parameters_summary"]).filter("column_name = 'TOTAL'").first().valid_entries == 16
    assert spark.read.parquet(syntax["average_metrics"]).count() == 33
    assert spark.read.parquet(syntax["statistical_metrics"]).count() == 4 * 18
    similarity = reports.similarity_report(variants, str(tmp_path / "similarity"))
    assert spark.read.parquet(similarity["pair_similarity"]).count() == 4 * 2
    some = reports.similarity_report(variants, str(tmp_path / "some"), cross_groups=True, start=1, end=3)
    assert spark.read.parquet(some["pair_similarity"]).count() == 2 * 6
    assert spark.read.parquet(similarity["pair_statistics"]).count() == 4 * 6
    found = reports.correspondence_report(variants, stories, str(tmp_path / "correspondence"))
    assert spark.read.parquet(found["statistics"]).count() == 4 * 3
    scored = reports.prompt_report(stories)
    assert scored["run_counts"].first().succeeded == 4
    long = spark.read.parquet(syntax["metric_rows"]).select(F.concat("variant", F.lit("_percentage_score")).alias("feature"), F.col("percentage_score").alias("value"))
    summary = reports.statistics_report({"syntax": long})
    assert {r.grp for r in summary["summary"].collect()} == {"GBT", "CLD"}
    assert os.path.isdir(tmp_path / "syntax" / "main_results")
    assert pytest.approx(1.0) == summary["groups"].agg(F.min("ranking")).first()[0]


def test_selection_and_diagram_reports(spark, tmp_path):
    scored = spark.createDataFrame([(i, float(i % 37)) for i in range(200)] + [(200, None)], "id long, score double")
    paths = reports.selection_report(scored, str(tmp_path / "selection"))
    chosen = spark.read.parquet(paths["selected_prompts"]).toPandas()
    assert chosen.groupby("stratum").size().to_dict() == {"Low": 2, "Medium": 4, "High": 3}
    summary = {r.stratum: r for r in spark.read.parquet(paths["selection_summary"]).collect()}
    assert set(summary) == {"Low", "Medium", "High", "TOTAL"} and summary["TOTAL"].n == 9
    check = spark.read.parquet(paths["selection_check"]).first()
    assert (check.n_selected, check.n_population) == (9, 201) and check.selection_std == pytest.approx(chosen.score.std())
    none = reports.selection_report(scored.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(none["selected_prompts"]).isEmpty() and spark.read.parquet(none["selection_check"]).first().n_selected == 0

    cell = "@startuml\nstart\n:a;\nstop\n@enduml\ntext\n@startuml\nfork\nend fork\n@enduml"
    rows = [("s", 1, 1, "m1", cell), ("s", 2, 1, "m1", " "), ("s", 1, 2, "m 2", None), ("s", 2, 2, "m 2", "a -> b")]
    cells = spark.createDataFrame(rows, "sheet string, row_index int, col_index int, column_name string, cell string")
    paths = reports.diagram_report(cells, str(tmp_path / "diagrams"))
    manifest = spark.read.parquet(paths["manifest"]).collect()
    assert len({r.file_name for r in manifest}) == 3 and {r.output_format for r in manifest} == {"JPEG"}
    assert {tuple(r) for r in spark.read.parquet(paths["columns"]).collect()} == {("m1", 2, 1, 1, 0), ("m 2", 1, 0, 0, 1)}
    assert tuple(spark.read.parquet(paths["counts"]).first()) == (4, 2, 3, 2)


def test_analysis_report_by_file_and_group(spark, tmp_path):
    a = spark.createDataFrame([(1, "2", "x"), (3, None, "y")], "GBT001_score int, GBT002_score string, other string")
    b = spark.createDataFrame([(0.5,), (1.5,)], "prompt_CLD001_rate double")
    for name, df in (("a.csv", a), ("b.csv", b)):
        df.write.option("header", True).csv(str(tmp_path / name))
    rules = {"statistics": [{"file": f, "columns": {"include": ["_score", "_rate"]}} for f in ("a.csv", "b.csv", "none.csv")]}
    got = {tuple(r) for r in reports.analysis_report(spark, str(tmp_path), rules, ("b.csv",)).collect()}
    assert got == {("a.csv", "GBT", 3, 2.0), ("b.csv", "CLD", 2, 1.0)}
    assert reports.analysis_report(spark, str(tmp_path), {"statistics": []}) is None


def test_standard_prompt_table(spark):
    rows = [(1, "Start the order and stop the system"), (2, " "), (3, None), (4, "nan"), (5, " Check it ")]
    got = pr.standard_prompt_table(spark.createDataFrame(rows, "row_number long, prompt string")).orderBy("row_number").collect()
    assert [(r.row_number, r.original_prompt, r.character_count, r.processing_status) for r in got] == [
        (1, rows[0][1], 35, "success"), (5, "Check it", 8, "success")
    ]
    assert len(got[0]) == 9 and all(f'"{r.original_prompt}"' in r.ai_enhanced_activity_prompt for r in got)


@pytest.mark.parametrize("size", [64, 1000, 10_000_000])
def test_split_csv_equals_the_reader_of_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    field = lambda: "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', '""\n', 'word', "'"]) for _ in range(rng.randint(0, 40)))
    for f in range(3):
        rows = [[field(), field(), rng.choice(["", "plain", "x y"])] for _ in range(rng.choice([0, 40, 200]))]
        with open(tmp_path / f"part{f}.csv", "w", encoding="utf-8-sig" if f else "utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if f < 2 else "\r\n", quoting=csv.QUOTE_MINIMAL if f else csv.QUOTE_ALL)
            writer.writerows([["text", "b", "c"], *rows, ["x" * 500 + "\n" * 300, "end", '"']])
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    want = []
    for f in range(3):
        part = spark.read.options(**options).csv(str(tmp_path / f"part{f}.csv"))
        lf = len(want) - 1 if f == 2 else 0
        want += [tuple(r) for r in part.toDF("text", "b", "c").collect()]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = readers.read_stories(spark, str(tmp_path)).orderBy("row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.row_number for r in got] == list(range(1, len(want) + 1))
    # of a file whose records end in CRLF, Spark's reader turns those inside fields into LF
    kept = lambda rows: [tuple((x or "").replace("\r\n", "\n") if i > lf else x for x in r) for i, r in enumerate(rows)]
    assert kept([(r.text, r.b, r.c) for r in got]) == kept(want)
