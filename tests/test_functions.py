"""Helpers against Python itself or brute force."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgauge.functions import counts, numbers, tails, text
from quillgauge.functions.sequences import lcs_length


def test_strip_words_tokens_follow_python(spark):
    texts = ["  \tplain　", "\x1cA b\x85", "Größe über_x, ÇA 12½!", "", " \n ", "a b  c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t", text.strip(F.col("t")).alias("s"), text.words(F.col("t")).alias("w"), text.space_tokens(F.col("t")).alias("k"),
        text.long_words(F.col("t")).alias("l"),
    ).collect()
    for r in rows:
        assert r.s == r.t.strip()
        assert r.w == re.findall(r"\w+", r.t.lower())
        assert r.k == r.t.lower().split()
        assert r.l == re.findall(r"\b\w{2,}\b", r.t.lower())


def test_py_round_is_pythons_round(spark):
    random.seed(5)
    values = [0.5, 1.5, 2.675, 70.65, 0.0625, 1.005, -2.675, -0.05, 0.15, 0.25, 0.35, 1e-9, 123456.785, 0.125]
    values += [k / 8 for k in range(-40, 40)] + [round(random.uniform(-100, 100), 3) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3, 4):
        got = [r.y for r in df.select(numbers.py_round(F.col("x"), digits).alias("y")).collect()]
        assert got == [round(v, digits) + 0.0 for v in values]


def test_normal_quantile(spark):
    points = {0.975: 1.959963984540054, 0.5: 0.0, 0.001: -3.090232306167813, 1e-12: -7.034483825301132, 0.9: 1.2815515655446004}
    df = spark.createDataFrame([(p,) for p in points], "p double")
    for r in numbers.with_normal_quantile(df, F.col("p"), "q").collect():
        assert r.q == pytest.approx(points[r.p], abs=1e-12)


def test_term_counts_and_matches(spark):
    left, right = "a b a c a b d".split(), "b a e b".split()
    df = spark.createDataFrame([(left, right), ([], right)], "x array<string>, y array<string>")
    rows = df.select(
        counts.term_counts(F.col("x")).alias("c"), counts.term_counts(counts.grams(F.col("x"), 2)).alias("g"),
        counts.matched(counts.term_counts(F.col("x")), counts.term_counts(F.col("y"))).alias("m"),
    ).collect()
    assert rows[0].c == {"a": 3, "b": 2, "c": 1, "d": 1}
    assert rows[0].g == {"a b": 2, "b a": 1, "a c": 1, "c a": 1, "b d": 1}
    assert sorted((m.l, m.r) for m in rows[0].m) == [(2, 2), (3, 1)]
    assert rows[1].c == {} and rows[1].m == []


def _lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=90), st.text("abcd", max_size=90))
def test_lcs_length(a, b):
    assert lcs_length(a, b) == _lcs_table(a, b) == lcs_length(b, a)


def test_tails_published_values():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert tails.t_critical(38, 0.05) == pytest.approx(2.0243941639, abs=1e-8)
    assert tails.t_power(0.8, 26, 1.0, 0.05) == pytest.approx(0.8074866, abs=1e-6)
    assert tails.t_power(0.5, 64, 1.0, 0.05) == pytest.approx(0.8014596, abs=1e-6)
    assert 2 * tails.normal_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.shapiro_p(0.7888146, 11) == pytest.approx(0.006704, abs=2e-5)
    assert tails.shapiro_p(1.0, 20) == 1.0


def test_rank_sum_exact_against_enumeration():
    from itertools import combinations

    for nx, ny in ((2, 5), (3, 4), (4, 4)):
        sums = [sum(c) - nx * (nx - 1) / 2 for c in combinations(range(nx + ny), nx)]
        for u in range(math.ceil(nx * ny / 2), nx * ny + 1):
            expected = min(1.0, 2 * sum(s >= u for s in sums) / len(sums))
            assert tails.rank_sum_exact(u, nx, ny) == pytest.approx(expected)


def test_rank_sum_exact_on_both_sides_of_the_switch(monkeypatch):
    cases = [(nx, ny, int(nx * ny / 2 + z * (nx * ny * (nx + ny + 1) / 12) ** 0.5)) for nx, ny, z in ((9, 50_000, 1.7), (40, 20_000, 3.0), (200, 400, 0.3), (60, 5_000, 2.0))]
    exact = [tails.rank_sum_exact(u, nx, ny) for nx, ny, u in cases]
    monkeypatch.setattr(tails, "MOST_COEFFICIENTS", 1)
    for (nx, ny, u), want in zip(cases, exact):
        assert tails.rank_sum_exact(u, nx, ny) == pytest.approx(want, abs=1e-5)
    assert 0 < tails.rank_sum_p(200 * 60_000 * 0.52, 200, 60_000, 0, "exact") < 1
