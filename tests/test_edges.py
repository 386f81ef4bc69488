"""Missing values, null groups, ties and sizes that once changed results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillgauge.functions import tails
from quillgauge.functions.numbers import py_round
from quillgauge.operators import blocks, code_metrics, pairs, selection, stats
from quillgauge.operators.positions import quantiles, row_index, rows_in_ranges
from quillgauge.operators.skew import even_join, salted_join
from quillgauge.sources import readers


def test_missing_scores_are_high(spark):
    rows = [(i, None if i in (2, 5) else float(i)) for i in range(8)]
    got = {r.id: r.stratum for r in selection.strata(spark.createDataFrame(rows, "id long, score double")).collect()}
    assert got[2] == got[5] == "High" and got[0] == got[1] == "Low" and got[7] == "Medium"


def test_tied_keys_get_their_own_numbers(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    rows = row_index(df, ["k"]).collect()
    assert sorted(r.row_index for r in rows) == list(range(1, 31))
    assert [r.k for r in sorted(rows, key=lambda r: r.row_index)] == [0] * 10 + [1] * 10 + [2] * 10
    assert readers.slice_rows(df, ["k"], 5, 9).count() == 4


def test_null_groups_stay(spark):
    rows = [(g, float(i * i % 17), i % 2 == 0) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "feature string, value double, x boolean")
    tables = [
        stats.shapiro(df, ["feature"]), stats.rank_sum(df, ["feature"], F.col("x")), stats.density(df, ["feature"]),
        stats.histogram(df, ["feature"]), stats.qq_points(df, ["feature"]), quantiles(df, ["feature"], "value", {"m": 0.5}),
        stats.feature_statistics(df, ["feature"]), stats.column_statistics(df, "feature"), stats.metric_statistics(df, "feature"),
    ]
    for table in tables:
        by = {}
        for r in table.collect():
            by.setdefault(r.feature, []).append(tuple(r)[1:])
        for nameless, named in zip(sorted(by[None]), sorted(by["a"]), strict=True):  # the same values, under another name
            assert [x if x is None else pytest.approx(x) for x in named] == list(nameless)
    p = {r.feature: r.shapiro_p for r in tables[6].collect()}
    assert p[None] is not None and p[None] == pytest.approx(p["a"])


def test_large_values_are_rounded(spark):
    values = [1234567890.126, -98765432109.875, 5e15 + 0.5, 2.675, 1e300]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(py_round(F.col("v"), 2).alias("v")).collect()]
    assert got == [round(v, 2) for v in values]


def test_shapiro_above_five_thousand(spark):
    df = spark.range(6000).select(F.lit("c").alias("column"), F.pmod(F.col("id") * 7919, F.lit(6007)).cast("double").alias("value"))
    assert stats.column_statistics(df).first().shapiro_p is not None
    assert stats.column_statistics(df, largest=5000).first().shapiro_p is None


def test_rank_sum_beyond_the_counted_arrangements(monkeypatch):
    cases = [(u, small, 4000) for small in (1, 2, 5, 8) for u in (small * 4000, small * 3900, small * 3000, small * 2100)]
    exact = [tails.rank_sum_exact(*c) for c in cases]
    monkeypatch.setattr(tails, "MOST_COEFFICIENTS", 0)
    for case, want in zip(cases, exact):
        assert tails.rank_sum_exact(*case) == pytest.approx(want, abs=2e-4)
    assert math.isfinite(tails.rank_sum_p(5e9, 8, 10**9, 0.0))


def test_vocabulary_is_not_limited_by_default(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "A", "A1", text), (1, "A", "A2", text + " tail")]
    df = spark.createDataFrame(rows, "story_id long, model_group string, variant string, code string")
    whole = pairs.pair_similarity(df, metrics=("tfidf",)).first().tfidf
    limited = pairs.pair_similarity(df, metrics=("tfidf",), limit=100).first().tfidf
    assert whole < 1.0 and limited == 1.0


def test_file_names_do_not_collide(spark):
    long = "column name that is longer than fifty characters, number"
    cells = [("s", 1, i, f"{long} {i}", "@startuml\nstart\nstop\n@enduml") for i in (1, 2, 3)]
    names = [r.file_name for r in blocks.manifest(spark.createDataFrame(cells, "sheet string, row_index int, col_index int, column_name string, cell string")).collect()]
    assert len(set(names)) == 3


def test_averages_of_nothing(spark):
    empty = code_metrics.code_metrics(spark.createDataFrame([], "story_id long, variant string, code string"))
    rows = code_metrics.average_metrics(empty).collect()
    assert len(rows) == 33 and all(r.value == 0.0 for r in rows)


def test_rules_skip_only_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x_score,y\n1,2\nbad,3\n")
    rules = {"statistics": [{"file": f, "columns": {"include": ["_score"]}} for f in ("a.csv", "missing.csv")]}
    found = readers.features_by_rules(spark, str(tmp_path), rules)
    assert list(found) == ["a.csv"] and sorted((r.value is None, r.value) for r in found["a.csv"].collect()) == [(False, 1.0), (True, None)]


def test_story_rows_are_numbered(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿story\n"one, two\nthree"\nfour\n')
    rows = readers.read_stories(spark, str(tmp_path / "s.csv")).collect()
    assert [r.row_number for r in sorted(rows, key=lambda r: r.row_number)] == [1, 2]


def test_joins_under_skew(spark):
    many = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(90)], "k string, v int")
    one = spark.createDataFrame([("hot", 1), (None, 2)], "k string, w int")
    assert {(r.k, r.w) for r in salted_join(many, one, ["k"], F.col("v")).collect()} == {("hot", 1), (None, 2)}
    hot = even_join(many, one, ["k"], F.col("v"), limit=10)
    assert sorted(map(tuple, hot.select("k", "v", "w").collect())) == [("hot", i, 1) for i in range(90) if i % 3]


def test_half_tied_rows_use_all_ranges(spark):
    n = 60_000
    df = spark.range(n, numPartitions=6).selectExpr("case when id % 2 = 0 then 5 else id % 1000 end as k", "id", "cast(null as map<int, int>) as m")
    ranged, ranges, _, number = rows_in_ranges(df, ["k"], 16)
    sizes = [r["count"] for r in ranged.groupBy(number).count().collect()]
    assert len(sizes) == ranges == 16 and max(sizes) < 2.5 * n / ranges
    rows = row_index(df, ["k"], "row", ranges=16).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(1, n + 1))
    assert [r.k for r in rows] == sorted(r.k for r in rows) and len({r.id for r in rows}) == n


def test_row_index_orders_nulls_text_and_empty_tables(spark):
    data = [(x, i) for i, x in enumerate(["b", None, "", "a", "é", None, "b"] * 300)]
    rows = row_index(spark.createDataFrame(data, "k string, _range long").repartition(5), ["k", "_range"]).orderBy("row_index").collect()
    want = sorted(data, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert [(r.k, r._range) for r in rows] == want and [r.row_index for r in rows] == list(range(1, len(data) + 1))
    assert row_index(spark.createDataFrame([], "k string"), ["k"]).collect() == []


def test_density_equals_the_sum_of_all_kernels(spark):
    rng = random.Random(9)
    samples = {"normal": [rng.gauss(3, 2) for _ in range(400)], "far": [rng.random() for _ in range(300)] + [1e6], "ties": [1.0] * 50 + [2.0] * 3, None: [0.0, 1.0]}
    rows = [(k, v) for k, vs in samples.items() for v in vs]
    found = stats.density(spark.createDataFrame(rows, "feature string, value double"), ["feature"]).collect()
    assert len(found) == 200 * len(samples)
    for k, vs in samples.items():
        n, mean = len(vs), sum(vs) / len(vs)
        bw = n**-0.2 * math.sqrt(sum((v - mean) ** 2 for v in vs) / (n - 1))
        height = 1 / (bw * math.sqrt(2 * math.pi))
        for r in (r for r in found if r.feature == k):
            want = sum(math.exp(-0.5 * ((r.x - v) / bw) ** 2) for v in vs) / n * height
            assert abs(r.density - want) < 1e-9 * height
