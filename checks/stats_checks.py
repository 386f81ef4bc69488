"""Statistics, ranking and selection over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import pair_checks, views
from checks.registry import check, sql_np_round, sql_py_round, table, with_
from quillgauge.functions import numbers
from quillgauge.functions.numbers import Z_975, np_round
from quillgauge.operators import pairs as pz
from quillgauge.operators import ranking, selection, stats
from quillgauge.operators.positions import quantiles, row_index
from quillgauge.plans import reports
from quillgauge.session import shared_folder

FEA = ("fea", views.V_FEATURES)
EV = ("ev", "select event_type as metric, value from events")
# Two samples of one table: every third customer against the others.
SAM = ("sam", "select c_mktsegment as feature, c_custkey % 3 = 0 as is_x, c_acctbal as value from customer")
Z = f"{Z_975!r}::double"


def _events(spark, sf):
    return table(spark, sf, "events").selectExpr("event_type as metric", "value")


def _samples(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_mktsegment as feature", "c_custkey % 3 = 0 as is_x", "c_acctbal as value")


def rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[np_round(F.col(c), digits).alias(c) for c in columns])


def r6(**columns):
    return ", ".join(f"{sql_np_round(x, 6)} as {name}" for name, x in columns.items())


def sql_poly(coefficients, x):
    result = f"{coefficients[-1]!r}::double"
    for c in reversed(coefficients[:-1]):
        result = f"({result} * {x} + {c!r}::double)"
    return result


def sql_quantile(p):
    """AS 241 in SQL; ``p`` is bound once."""
    centre = "(0.180625::double - (p - 0.5) * (p - 0.5))"
    r = "sqrt(-ln(least(p, 1 - p)))"
    middle, tail = f"({r} - 1.6::double)", f"({r} - 5.0::double)"
    a, b, c = numbers._CENTRE, numbers._MIDDLE, numbers._TAIL
    outer = (
        f"case when {r} <= 5 then {sql_poly(b[0], middle)} / {sql_poly(b[1], middle)} "
        f"else {sql_poly(c[0], tail)} / {sql_poly(c[1], tail)} end"
    )
    body = (
        f"case when abs(p - 0.5) <= 0.425 then (p - 0.5) * {sql_poly(a[0], centre)} / {sql_poly(a[1], centre)} "
        f"when p < 0.5 then -({outer}) else {outer} end"
    )
    return f"list_transform([({p})::double], lambda p: {body})[1]"


# --- Shapiro-Wilk ----------------------------------------------------------------------

SW = [
    ("sr", "select feature, value, row_number() over (partition by feature order by value) as i, "
           "count(*) over (partition by feature) as n from fea where value is not null"),
    ("sm", f"select *, {sql_quantile('(i - 0.375) / (n + 0.25)')} as m from sr"),
    ("sg", """select feature, n, 1 / sqrt(n::double) as u, sum(m * m) as ssq, sum(m * value) as smx, max(m) as m1,
  max(case when i = n - 1 then m end) as m2, max(value) - min(value) as d1,
  max(case when i = n - 1 then value end) - max(case when i = 2 then value end) as d2, var_pop(value) * n as ss
  from sm group by feature, n"""),
    ("sa", """select *, ((((-2.706056::double * u + 4.434685::double) * u - 2.07119::double) * u - 0.147981::double) * u + 0.221157::double) * u + m1 / sqrt(ssq) as a1,
  ((((-3.582633::double * u + 5.682633::double) * u - 1.752461::double) * u - 0.293762::double) * u + 0.042981::double) * u + m2 / sqrt(ssq) as a2 from sg"""),
    ("sw", """select feature, n, least(1::double, pow(a1 * d1 + a2 * d2 + (smx - m1 * d1 - m2 * d2)
  / sqrt((ssq - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss) as w from sa"""),
]


# --- tails of distributions in SQL ------------------------------------------------------


def bound(x, name, body):
    """``body`` with ``x`` evaluated once as ``name``."""
    return f"list_transform([({x})::double], lambda {name}: {body})[1]"


def sql_normal_sf(z):
    """P(Z > z): the series of the error function, whose terms are all positive."""
    a = "greatest(abs(z) / sqrt(2::double), 1e-300::double)"
    term = f"exp((2 * k + 1) * ln({a}) + 2 * k * ln(2::double) + lgamma(k + 1::double) - lgamma(2 * k + 2::double) - {a} * {a})"
    half = f"1 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 250), lambda k: {term}))"
    return bound(z, "z", f"case when z > 8.3 then 0::double when z < -8.3 then 1::double when z >= 0 then 0.5 - {half} else 0.5 + {half} end")


def sql_t_two_sided(t, df):
    """P(|T| > t): Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    steps = 4000
    spot = f"(th + (pi() / 2 - th) * k / {steps})"
    weight = f"case when k = 0 or k = {steps} then 1 when k % 2 = 1 then 4 else 2 end"
    area = f"(pi() / 2 - th) / {3 * steps} * list_sum(list_transform(generate_series(0, {steps}), lambda k: {weight} * pow(greatest(cos({spot}), 0), df - 1)))"
    scale = "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi())"
    return bound(df, "df", bound(f"atan(abs({t}) / sqrt(df))", "th", f"{scale} * {area}"))


def sql_t_critical(df, alpha):
    """The t that |T| exceeds with probability ``alpha``, by halving."""
    middle = "(s[1] + s[2]) / 2"
    tail = sql_t_two_sided("m", "df")
    step = f"list_transform([{middle}], lambda m: case when {tail} > {alpha}::double then [m, s[2]] else [s[1], m] end)[1]"
    return bound(df, "df", f"list_reduce(list_concat([[0::double, 64::double]], list_transform(generate_series(1, 56), lambda k: [0::double])), lambda s, k: {step})[1]")


def sql_rank_sum_p(u, nx, ny, ties):
    """Normal approximation with tie and continuity correction."""
    z = (f"(greatest({u}, {nx}::double * {ny} - {u}) - {nx}::double * {ny} / 2 - 0.5) / "
         f"sqrt({nx}::double * {ny} / 12 * (({nx} + {ny} + 1) - {ties} / (({nx} + {ny})::double * ({nx} + {ny} - 1))))")
    return f"least(1::double, 2 * {sql_normal_sf(z)})"


#: Royston's p of W for 12 values and more.
SHAPIRO_P = sql_normal_sf(
    "(ln(1 - w) - (-1.5861::double - 0.31082::double * ln(n) - 0.083751::double * ln(n) * ln(n) + 0.0038915::double * ln(n) * ln(n) * ln(n))) "
    "/ exp(-0.4803::double - 0.082676::double * ln(n) + 0.0030302::double * ln(n) * ln(n))"
)
Z_P = f"2 * {sql_normal_sf('abs(z_stat)')}"
Z_POWER = f"{sql_normal_sf(f'{Z} - abs(z_stat)')} + {sql_normal_sf(f'{Z} + abs(z_stat)')}"
_TABLE = ["mean", "std_dev", "shapiro_p", "z_stat", "p_value", "effect_size", "power", "mwu_p", "ci_low", "ci_high"]


@check("st1_shapiro_w", with_(FEA, *SW, select=f"select feature, n, {r6(w='w')} from sw"))
def shapiro_w(spark, sf):
    return stats.shapiro_w(views.features(spark, sf), ["feature"]).select("feature", "n", np_round(F.col("w"), 6).alias("w"))


@check("st1_shapiro_p", with_(FEA, *SW, select="select feature, n, " + r6(w="w", shapiro_p=SHAPIRO_P) + " from sw"))
def shapiro_p(spark, sf):
    return rounded(stats.shapiro(views.features(spark, sf), ["feature"]), ["feature", "n"], ["w", "shapiro_p"])


# --- column, metric and feature statistics ----------------------------------------------

COLM = (
    "cm",
    f"""select feature, n, mean, std_dev, mean / (std_dev / sqrt(n)) as z_stat, mean / std_dev as effect_size,
  mean - {Z} * (std_dev / sqrt(n)) as ci_low, mean + {Z} * (std_dev / sqrt(n)) as ci_high
from (select feature, count(value) as n, avg(value) as mean, stddev_samp(value) as std_dev from fea group by feature) where n >= 3""",
)
_COLS = ["mean", "std_dev", "z_stat", "effect_size", "ci_low", "ci_high"]


@check("agg4_column_moments", with_(FEA, COLM, select="select feature, n, " + r6(**{c: c for c in _COLS}) + " from cm"))
def column_moments(spark, sf):
    return rounded(stats.column_moments(views.features(spark, sf), "feature"), ["feature", "n"], _COLS)


@check(
    "agg4_column_statistics",
    with_(FEA, *SW, COLM, select="select feature, " + r6(**{c: c for c in _TABLE if c not in ("shapiro_p", "p_value", "power", "mwu_p")})
          + f", null::double as mwu_p, {r6(shapiro_p=SHAPIRO_P.replace('ln(n)', 'ln(sw.n)'), p_value=Z_P, power=Z_POWER)} from cm join sw using (feature)"),
)
def column_statistics(spark, sf):
    return stats.column_statistics(views.features(spark, sf), "feature")


for _name, _column in (("st2_z_stat", "z_stat"), ("st8_effect_size", "effect_size"), ("st10_interval", "ci_low, ci_high")):

    def _register(name, columns):
        @check(name, with_(FEA, COLM, select="select feature, " + r6(**{c: c for c in columns}) + " from cm"))
        def run(spark, sf):
            return rounded(stats.column_moments(views.features(spark, sf), "feature"), ["feature"], columns)

    _register(_name, _column.split(", "))


@check("st2_p_value", with_(FEA, COLM, select="select feature, " + r6(z_stat="z_stat", p_value=Z_P) + " from cm"))
def z_p_value(spark, sf):
    return stats.column_statistics(views.features(spark, sf), "feature").select("feature", "z_stat", "p_value")


@check("st11_z_power", with_(FEA, COLM, select="select feature, " + r6(z_stat="z_stat", power=Z_POWER) + " from cm"))
def z_power(spark, sf):
    return stats.column_statistics(views.features(spark, sf), "feature").select("feature", "z_stat", "power")


METM = (
    "mm",
    f"""select metric, n, mean, std_dev, (mean - 0.5) / (s / sqrt(n)) as z_stat, (mean - 0.5) / std_dev as effect_size,
  mean - {Z} * std_dev / sqrt(n) as ci_low, mean + {Z} * std_dev / sqrt(n) as ci_high, u, ties
from (select metric, count(*) as n, avg(value) as mean, stddev_pop(value) as std_dev, stddev_samp(value) as s,
   (count(*) filter (where value > 0.5))::double * count(*) + 0.5::double * (count(*) filter (where value = 0.5)) * count(*) as u
   from ev group by metric)
join (select metric, sum(k * k * k - k) as ties from (select metric, value, count(*)::double as k from (
   select metric, value from ev union all select metric, 0.5 from ev) group by all) group by metric) using (metric)""",
)
_METS = ["mean", "std_dev", "z_stat", "effect_size", "ci_low", "ci_high", "u", "ties"]


@check("agg6_metric_moments", with_(EV, METM, select="select metric, n, " + r6(**{c: c for c in _METS}) + " from mm"))
def metric_moments(spark, sf):
    return rounded(stats.metric_moments(_events(spark, sf)), ["metric", "n"], _METS)


_EV_SW = (("fea", "select metric as feature, value from ev"), *SW)


def r4(**columns):
    return ", ".join(f"{sql_np_round(x, 4)} as {name}" for name, x in columns.items())


@check(
    "agg6_metric_statistics",
    with_(EV, METM, *_EV_SW, select="select metric, "
          + r4(**{c: f"mm.{c}" for c in _TABLE if c not in ("shapiro_p", "p_value", "power", "mwu_p")}) + ", null::double as power, "
          + r4(shapiro_p=SHAPIRO_P.replace("ln(n)", "ln(sw.n)"), p_value=sql_t_two_sided("z_stat", "mm.n - 1"), mwu_p=sql_rank_sum_p("mm.u", "mm.n", "mm.n", "mm.ties"))
          + " from mm join sw on sw.feature = mm.metric"),
)
def metric_statistics(spark, sf):
    return stats.metric_statistics(_events(spark, sf))


@check("st3_t_stat", with_(EV, METM, select="select metric, " + r6(z_stat="z_stat") + " from mm"))
def t_stat(spark, sf):
    return rounded(stats.metric_moments(_events(spark, sf)), ["metric"], ["z_stat"])


@check(
    "st3_t_p_value",
    with_(EV, METM, select="select metric, " + r4(z_stat="z_stat", p_value=sql_t_two_sided("z_stat", "n - 1")) + " from mm"),
)
def t_p_value(spark, sf):
    return stats.metric_statistics(_events(spark, sf)).select("metric", "z_stat", "p_value")


def sql_features(source, key):
    """Feature moments in SQL; skewness and kurtosis from central moments."""
    return (
        f"select {key}, n, mean / f as mean, std / f as std_dev, case when mean = 0 then 'inf'::double else abs(std / mean) end as std_mean, "
        "case when n > 3 and m2 > 0 then m3 / pow(m2, 1.5) end as skewness, case when n > 3 and m2 > 0 then m4 / (m2 * m2) - 3 end as kurtosis, "
        "1 - n::double / total as missing from ("
        f"select {key}, count(value) as n, count(*) as total, any_value(mean) as mean, stddev_samp(value) as std, "
        "avg(pow(value - mean, 2)) as m2, avg(pow(value - mean, 3)) as m3, avg(pow(value - mean, 4)) as m4, "
        "case when min(value) >= 0 and max(value) <= 100 then 100::double else 1::double end as f from "
        f"(select *, avg(value) over (partition by {key}) as mean from {source}) group by {key})"
    )


FM = ("fm", sql_features("fea", "feature"))
EM = ("em", sql_features("ev", "metric"))
_FEATS = ["mean", "std_dev", "std_mean", "skewness", "kurtosis", "missing"]


@check("agg7_feature_moments", with_(FEA, FM, select="select feature, n, " + r6(**{c: c for c in _FEATS}) + " from fm"))
def feature_moments(spark, sf):
    return rounded(stats.feature_moments(views.features(spark, sf), ["feature"]), ["feature", "n"], _FEATS)


@check("st14_shape", with_(FEA, FM, select="select feature, " + r6(skewness="skewness", kurtosis="kurtosis") + " from fm"))
def shape(spark, sf):
    return rounded(stats.feature_moments(views.features(spark, sf), ["feature"]), ["feature"], ["skewness", "kurtosis"])


@check("st15_variation_missing", with_(FEA, FM, select="select feature, " + r6(std_mean="std_mean", missing="missing") + " from fm"))
def variation(spark, sf):
    return rounded(stats.feature_moments(views.features(spark, sf), ["feature"]), ["feature"], ["std_mean", "missing"])


@check(
    "agg7_feature_statistics",
    with_(FEA, FM, *SW, select="select feature, fm.n, " + r6(**{c: f"fm.{c}" for c in _FEATS}, shapiro_p=SHAPIRO_P.replace("ln(n)", "ln(sw.n)")) + " from fm join sw using (feature)"),
)
def feature_statistics(spark, sf):
    return rounded(stats.feature_statistics(views.features(spark, sf), ["feature"]), ["feature", "n"], [*_FEATS, "shapiro_p"])


# Percent-like values: acctbal scaled into 0..100 must be divided by 100.
PCT = ("pc", "select feature, (value + 1000) / 200 as value from fea")


@check("agg7_percent_rescale", with_(FEA, PCT, ("pm", sql_features("pc", "feature")),
                                     select="select feature, n, " + r6(mean="mean", std_dev="std_dev", std_mean="std_mean") + " from pm"))
def percent_rescale(spark, sf):
    scaled = views.features(spark, sf).withColumn("value", (F.col("value") + 1000) / 200)
    return rounded(stats.feature_moments(scaled, ["feature"]), ["feature", "n"], ["mean", "std_dev", "std_mean"])


# Group statistics: brands of parts are the features, their first three characters after
# "prompt_" the groups of the correspondence source.
PF = ("pf", "select concat('prompt_', upper(substr(p_type, 1, 3)), p_size, '_match_rate') as feature, p_retailprice as value from part")
PM = ("pm", sql_features("pf", "feature"))


def _part_features(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('prompt_', upper(substr(p_type, 1, 3)), p_size, '_match_rate') as feature", "p_retailprice as value"
    )


@check(
    "agg8_group_statistics",
    with_(PF, PM, select="select substr(split_part(feature, 'prompt_', 2), 1, 3) as grp, "
          + r6(**{c: f"avg({c})" for c in _FEATS}) + " from pm group by 1"),
)
def group_statistics(spark, sf):
    features = stats.feature_moments(_part_features(spark, sf), ["feature"]).withColumn(
        "grp", stats.feature_group(F.col("feature"), prompted=True)
    )
    return rounded(stats.group_statistics(features), ["grp"], _FEATS)


MERGED = (
    "mg",
    "select grp, mean, std_dev, std_mean, skewness, kurtosis, missing, 'customers' as source from "
    "(select substr(feature, 1, 3) as grp, * from fm) union all "
    "select grp, avg(mean), avg(std_dev), avg(std_mean), avg(skewness), avg(kurtosis), avg(missing), 'events' from "
    "(select upper(substr(metric, 1, 3)) as grp, * from em) group by grp union all "
    "select substr(split_part(feature, 'prompt_', 2), 1, 3) as grp, avg(mean), avg(std_dev), avg(std_mean), avg(skewness), avg(kurtosis), avg(missing), 'parts' "
    "from pm group by 1",
)


def _merged(spark, sf):
    customers = stats.feature_moments(views.features(spark, sf), ["feature"]).withColumn(
        "grp", stats.feature_group(F.col("feature"))
    )
    events = stats.feature_moments(_events(spark, sf), ["metric"]).withColumn("grp", F.upper(F.substring("metric", 1, 3)))
    parts = stats.feature_moments(_part_features(spark, sf), ["feature"]).withColumn(
        "grp", stats.feature_group(F.col("feature"), prompted=True)
    )
    return ranking.merge_reports(
        {"customers": stats.group_statistics(customers), "events": stats.group_statistics(events),
         "parts": stats.group_statistics(parts)}
    )


_MERGE_CTES = (FEA, FM, EV, EM, PF, PM, MERGED)


@check("set1_merged_reports", with_(*_MERGE_CTES, select="select source, grp, " + r6(**{c: c for c in _FEATS}) + " from mg"))
def merged_reports(spark, sf):
    return rounded(_merged(spark, sf), ["source", "grp"], _FEATS)


@check("agg9_cross_report_summary", with_(*_MERGE_CTES, select="select grp, " + r6(**{c: f"avg({c})" for c in _FEATS}) + " from mg group by grp"))
def cross_report_summary(spark, sf):
    return rounded(ranking.cross_report_summary(_merged(spark, sf)), ["grp"], _FEATS)


@check(
    "agg13_report_averages",
    with_(PF, select="select substr(feature, 8, 3) as grp, count(value) as n, " + r6(average="avg(value)") + " from pf group by 1"),
)
def report_averages(spark, sf):
    long = _part_features(spark, sf).withColumn("grp", stats.feature_group(F.col("feature"), prompted=True))
    return rounded(stats.report_averages(long, ["grp"]), ["grp", "n"], ["average"])


@check(
    "flt4_minimum_samples",
    with_(("f", "select p_brand || ':' || p_size as feature, p_retailprice as value from part"),
          select="select feature, count(*) as n, " + r6(mean="avg(value)", std_dev="stddev_samp(value)") + " from f group by 1 having count(*) >= 3"),
)
def minimum_samples(spark, sf):
    long = table(spark, sf, "part").selectExpr("concat(p_brand, ':', p_size) as feature", "p_retailprice as value")
    return rounded(stats.column_moments(long, "feature"), ["feature", "n"], ["mean", "std_dev"])


@check(
    "flt5_present_values",
    "select c_mktsegment as feature, count(*) as n from customer where c_custkey % 20 <> 0 group by 1",
)
def present_values(spark, sf):
    # zero division gives infinity, which passes; NaN and null do not
    odd = table(spark, sf, "customer").selectExpr(
        "c_mktsegment as feature",
        "case when c_custkey % 20 = 0 then double('NaN') when c_custkey % 20 = 1 then double('Infinity') else c_acctbal end as value",
    )
    return stats.present(odd).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


# --- two samples -----------------------------------------------------------------------

RANKS = (
    "rk",
    """select feature, count(*) filter (where is_x) as nx, count(*) filter (where not is_x) as ny, sum(case when is_x then rank else 0 end) as rx
from (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rank from sam)
group by feature""",
)
UU = ("uu", "select *, rx - nx * (nx + 1) / 2 as u from rk")


@check(
    "st5_mann_whitney_u",
    with_(SAM, RANKS, UU, ("ti", "select feature, sum(k * k * k - k) as ties from (select feature, value, count(*)::double as k from sam group by all) group by 1"),
          select="select feature, nx, ny, u::double as u, ties from uu join ti using (feature)"),
)
def mann_whitney_u(spark, sf):
    return stats.rank_sum(_samples(spark, sf), ["feature"], F.col("is_x")).select("feature", "nx", "ny", "u", "ties")


TI = ("ti", "select feature, sum(k * k * k - k) as ties from (select feature, value, count(*)::double as k from sam group by all) group by 1")


@check(
    "st5_mann_whitney_p",
    with_(SAM, RANKS, UU, TI, select="select feature, u::double as u, " + r6(mwu_p=sql_rank_sum_p("u", "nx", "ny", "ties")) + " from uu join ti using (feature)"),
)
def mann_whitney_p(spark, sf):
    return rounded(stats.rank_sum(_samples(spark, sf), ["feature"], F.col("is_x")), ["feature", "u"], ["mwu_p"])


@check("st6_u_z", with_(SAM, RANKS, UU, select="select feature, " + r6(mwu_z="(u - nx * ny / 2) / sqrt(nx * ny * (nx + ny + 1) / 12)") + " from uu"))
def u_z(spark, sf):
    return rounded(stats.rank_sum(_samples(spark, sf), ["feature"], F.col("is_x")), ["feature"], ["mwu_z"])


@check("st9_cliffs_delta", with_(SAM, RANKS, UU, select="select feature, " + r6(delta="2 * u / (nx * ny) - 1") + " from uu"))
def cliffs_delta(spark, sf):
    return rounded(stats.rank_sum(_samples(spark, sf), ["feature"], F.col("is_x")), ["feature"], ["delta"])


TWO = (
    "tw",
    """select feature, count(*) filter (where is_x) as nx, count(*) filter (where not is_x) as ny,
  avg(value) filter (where is_x) as mx, avg(value) filter (where not is_x) as my,
  var_samp(value) filter (where is_x) as vx, var_samp(value) filter (where not is_x) as vy from sam group by feature""",
)


@check(
    "st4_welch",
    with_(SAM, TWO, select="select feature, " + r6(welch_t="(mx - my) / sqrt(vx / nx + vy / ny)",
          welch_df="pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1))") + " from tw"),
)
def welch(spark, sf):
    return rounded(stats.two_sample_moments(_samples(spark, sf), ["feature"], F.col("is_x")), ["feature"], ["welch_t", "welch_df"])


@check(
    "st7_cohen_d",
    with_(SAM, TWO, select="select feature, " + r6(cohen_d="(mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2))") + " from tw"),
)
def cohen_d(spark, sf):
    return rounded(stats.two_sample_moments(_samples(spark, sf), ["feature"], F.col("is_x")), ["feature"], ["cohen_d"])


# --- pair statistics over all pairs of a conversation ------------------------------------

_AP = ("p", pair_checks.ALL_PAIRS[1])
_VALUES = (
    "vals",
    """select unnest([a, b]) as "column", metric, kind, value from (
  select a, b, case when group_a = group_b then 'intra' else 'inter' end as kind, 'jaccard' as metric, """
    + sql_py_round("jaccard", 4) + """ as value from p join jac using (story_id, a, b) union all
  select a, b, case when group_a = group_b then 'intra' else 'inter' end, 'tfidf', """
    + sql_py_round("tfidf", 4) + " from p join tf using (story_id, a, b)) where value is not null",
)
_PAIR_CTES = (pair_checks.V, _AP, pair_checks.TOK, pair_checks.JAC, pair_checks.TERMS, pair_checks.TF, _VALUES)
_PM = ["mean", "std_dev", "ci_low", "ci_high", "welch_t", "welch_df", "cohen_d"]
_PAIR_SQL = (
    "pmo",
    f"""select "column", metric, n_all, nx as n_intra, ny as n_inter, mean, std_dev, mean - {Z} * std_dev / sqrt(n_all) as ci_low,
  mean + {Z} * std_dev / sqrt(n_all) as ci_high,
  case when nx > 1 and ny > 1 and vx / nx + vy / ny > 0 then (mx - my) / sqrt(vx / nx + vy / ny) end as welch_t,
  case when nx > 1 and ny > 1 and vx / nx + vy / ny > 0 then pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)) end as welch_df,
  case when nx > 1 and ny > 1 then case when vx + vy = 0 then 0 else (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) end end as cohen_d
from (select "column", metric, count(*) as n_all, avg(value) as mean, stddev_samp(value) as std_dev,
  count(*) filter (where kind = 'intra') as nx, count(*) filter (where kind = 'inter') as ny,
  avg(value) filter (where kind = 'intra') as mx, avg(value) filter (where kind = 'inter') as my,
  var_samp(value) filter (where kind = 'intra') as vx, var_samp(value) filter (where kind = 'inter') as vy from vals group by all)""",
)


def _labelled(spark, sf, *metrics):
    return pz.label_pairs(pz.pair_similarity(views.variants(spark, sf), within=("story_id",), metrics=metrics))


@check(
    "agg5_pair_moments",
    with_(*_PAIR_CTES, _PAIR_SQL, select='select "column", metric, n_all, n_intra, n_inter, ' + r6(**{c: c for c in _PM}) + " from pmo"),
)
def pair_moments(spark, sf):
    values = stats.pair_values(_labelled(spark, sf, "jaccard", "tfidf"), ["jaccard", "tfidf"])
    return rounded(stats.pair_moments(values), ["column", "metric", "n_all", "n_intra", "n_inter"], _PM)


# All pairs of a conversation with their similarities as the report rounds them, one row per column of a pair.
_PAIRS = (
    "p",
    "select x.story_id, x.variant as a, y.variant as b, x.code as code_a, y.code as code_b, "
    "case when x.model_group = y.model_group then 'intra' else 'inter' end as kind from v x join v y "
    "on x.story_id = y.story_id and x.variant < y.variant",
)
_WEIGHTS = {"jaccard": 0.25, "levenshtein": 0.25, "tfidf": 0.3}  # fixed values: the report's weights


def _scores_sql(names):
    """(a, b, kind, the metrics, their mean and weighted mean) for each pair."""
    there = ", ".join(names)
    weighted = " + ".join(f"coalesce({n} * {_WEIGHTS[n]}::double, 0)" for n in names)
    total = " + ".join(f"case when {n} is null then 0::double else {_WEIGHTS[n]}::double end" for n in names)
    tables = {"jaccard": "jac", "levenshtein": "lev", "tfidf": "tf"}
    joins = " ".join(f"join {tables[n]} using (story_id, a, b)" for n in names)
    return (
        "select a, b, kind, " + ", ".join(f"{sql_py_round(n, 4)} as {n}" for n in names)
        + f", {sql_np_round(f'list_avg(list_filter([{there}], lambda x: x is not null))', 4)} as mean, "
        + f"{sql_py_round(f'({weighted}) / ({total})', 4)} as weighted from p {joins}"
    )


def _tested(names, metrics):
    """Tables up to ``ps``: the pair statistics per (column, metric), not rounded."""
    values = " union all ".join(f"select a, b, kind, '{m}' as metric, {m} as value from scores" for m in metrics)
    parts = [pair_checks.V, _PAIRS, pair_checks.TOK, pair_checks.JAC]
    if "tfidf" in names:
        parts += [pair_checks.TERMS, pair_checks.TF]
    if "levenshtein" in names:
        parts += [pair_checks.TEXTS, *pair_checks.LCS, pair_checks.LEV]
    w_p = f"case when w >= 1 then 1::double else {SHAPIRO_P} end"
    d = "power_d"
    shift = "power_d * sqrt(nx::double * ny / (nx + ny))"
    return [
        *parts, ("scores", _scores_sql(names)),
        ("vals", f"select unnest([a, b]) as \"column\", metric, kind, value from ({values}) where value is not null"),
        _PAIR_SQL,
        # normality of all values and of either kind; these samples have more than eleven values
        ("fea", """select "column" || '|' || metric || '|' || unnest(['all', kind]) as feature, value from vals"""),
        *SW,
        ("sp", f"select feature, case when d1 = 0 then 1::double else {w_p} end as p from (select sw.*, sg.d1 from sw join sg using (feature))"),
        ("sam", """select "column" || '|' || metric as feature, kind = 'intra' as is_x, value from vals"""),
        RANKS, UU, TI,
        (
            "ch",
            """select pmo.*, nx, ny, a.p as shapiro_p, coalesce(n_intra >= 3 and n_inter >= 3 and i.p > 0.05 and e.p > 0.05, false) as normal,
  n_intra >= 2 and n_inter >= 2 as testable, u, ties
from pmo join uu on uu.feature = "column" || '|' || metric join ti using (feature)
left join sp a on a.feature = uu.feature || '|all' left join sp i on i.feature = uu.feature || '|intra' left join sp e on e.feature = uu.feature || '|inter'""",
        ),
        (
            "tests",
            f"""select *, case when normal then cohen_d else delta end as effect, case when normal then welch_t else mwu_z end as stat,
  case when normal then {sql_t_two_sided('welch_t', 'welch_df')} else mwu_p end as p
from (select *, (u - nx * ny / 2) / sqrt(nx * ny * (nx + ny + 1) / 12) as mwu_z, 2 * u / (nx * ny) - 1 as delta,
  {sql_rank_sum_p('u', 'nx', 'ny', 'ties')} as mwu_p from ch where testable)""",
        ),
        # power: P(|T'| > c) = 1 - sum over j of Poisson(j) P(Beta(j + 1/2, df / 2) <= x); each such
        # probability is the one before less one term, and the first is 1 - alpha
        ("pw", f"""select *, {shift} * {shift} / 2 as lam, c * c / (df + c * c) as x from (
  select *, {sql_t_critical('df', 0.05)} as c from (select "column", metric, nx, ny, (nx + ny - 2)::double as df,
    abs(effect) * case when normal then 1.0::double else 1.1::double end as {d} from tests where abs(effect) > 0))"""),
        ("pj", """select "column", metric, j, exp(j * ln(lam) - lam - lgamma(j + 1::double)) as pois,
  exp((j + 0.5) * ln(x) + df / 2 * ln(1 - x) - ln(j + 0.5::double) - lgamma(j + 0.5::double) - lgamma(df / 2) + lgamma(j + 0.5::double + df / 2)) as term
from (select *, unnest(generate_series(0, (lam + 14 * sqrt(lam) + 60)::bigint)) as j from pw)"""),
        ("power", """select "column", metric, 1 - sum(pois * inside) as power from (select *, 0.95::double - coalesce(sum(term) over (
  partition by "column", metric order by j rows between unbounded preceding and 1 preceding), 0) as inside from pj) group by all"""),
        ("ps", """select pmo."column", pmo.metric, upper(substr(pmo."column", 1, 3)) as model_group, pmo.n_all, pmo.n_intra, pmo.n_inter, pmo.mean, pmo.std_dev,
  sa_.p as shapiro_p, t.stat as z_stat, t.p as p_value, t.effect as effect_size, power.power, t.mwu_p, pmo.ci_low, pmo.ci_high
from pmo left join tests t using ("column", metric) left join power using ("column", metric)
left join sp sa_ on sa_.feature = pmo."column" || '|' || pmo.metric || '|all'"""),
    ]


_FIVE = ["jaccard", "levenshtein", "tfidf", "mean", "weighted"]


@check(
    "agg5_pair_statistics",
    with_(*_tested(_FIVE[:3], _FIVE), select='select "column", metric, model_group, n_all, n_intra, n_inter, ' + r6(**{c: c for c in _TABLE}) + " from ps"),
)
def pair_statistics(spark, sf):
    return stats.pair_statistics(
        _labelled(spark, sf, "jaccard", "levenshtein", "tfidf"), ["jaccard", "levenshtein", "tfidf", "mean", "weighted"]
    )


@check("st12_t_power", with_(*_tested(["jaccard"], ["jaccard"]), select='select "column", ' + r6(effect_size="effect_size", power="power") + " from ps"))
def t_power(spark, sf):
    return stats.pair_statistics(_labelled(spark, sf, "jaccard"), ["jaccard"]).select("column", "effect_size", "power")


@check(
    "st13_test_choice",
    with_(*_tested(["jaccard"], ["jaccard"]), select='select "column", ' + r6(**{c: c for c in ("z_stat", "p_value", "effect_size", "mwu_p")}) + " from ps"),
)
def test_choice(spark, sf):
    return stats.pair_statistics(_labelled(spark, sf, "jaccard"), ["jaccard"]).select(
        "column", "z_stat", "p_value", "effect_size", "mwu_p"
    )


# --- plotted data ----------------------------------------------------------------------

_FILL = """case when i = n then pow(0.5::double, 1 / n::double) when i = 1 then 1 - pow(0.5::double, 1 / n::double)
 else (i - 0.3175::double) / (n + 0.365::double) end"""


@check("st16_qq_points", with_(FEA, SW[0], select=f"select feature, i, {r6(theoretical=sql_quantile(_FILL), value='value')} from sr"))
def qq_points(spark, sf):
    return rounded(stats.qq_points(views.features(spark, sf), ["feature"]), ["feature", "i"], ["theoretical", "value"])


HIST = (
    "h",
    """select *, greatest(1, ceil((hi - lo) / case when fd > 0 then least(fd, sg) else sg end))::bigint as bins from (
  select metric, min(value) as lo, max(value) as hi,
   2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1 / 3::double) as fd,
   (max(value) - min(value)) / (log2(count(*)) + 1) as sg from ev group by metric)""",
)


@check(
    "st17_histogram",
    with_(EV, HIST, select="select metric, bin, " + r6(low="lo + bin * ((hi - lo) / bins)", high="lo + (bin + 1) * ((hi - lo) / bins)")
          + ', count(*) as "count" from (select metric, lo, hi, bins, least(floor((value - lo) / (hi - lo) * bins), bins - 1)::bigint as bin '
            "from ev join h using (metric)) group by metric, bin, lo, hi, bins"),
)
def histogram(spark, sf):
    return rounded(stats.histogram(_events(spark, sf), ["metric"]), ["metric", "bin", "count"], ["low", "high"])


@check(
    "st17_normal_curve",
    with_(EV, ("g", "select metric, avg(value) as mu, stddev_pop(value) as sd, min(value) as lo, max(value) as hi from ev group by 1"),
          ("x", "select *, lo + point * (hi - lo) / 199::double as x from g, (select unnest(generate_series(0, 199))::int as point)"),
          select="select metric, point, " + r6(x="x", density="exp(-0.5 * pow((x - mu) / sd, 2)) / (sd * sqrt(2 * pi()))") + " from x"),
)
def normal_curve(spark, sf):
    return rounded(stats.normal_curve(_events(spark, sf), ["metric"]), ["metric", "point"], ["x", "density"])


@check(
    "st18_density",
    with_(EV, ("g", "select metric, count(*)::double as n, pow(count(*), -0.2) * stddev_samp(value) as bw, min(value) as lo, max(value) as hi from ev group by 1"),
          ("x", "select *, lo - 3 * bw + point * ((hi - lo + 6 * bw) / 199::double) as x from g, (select unnest(generate_series(0, 199))::int as point)"),
          select="select metric, point, " + r6(x="any_value(x)", density="sum(exp(-0.5 * pow((x - value) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi()))")
                 + " from x join ev using (metric) group by metric, point"),
)
def density(spark, sf):
    return rounded(stats.density(_events(spark, sf), ["metric"]), ["metric", "point"], ["x", "density"])


@check(
    "agg1_exact_median",
    with_(FEA, select="select feature, " + r6(median="median(value)", q1="quantile_cont(value, 0.25)", q3="quantile_cont(value, 0.75)")
          + " from fea group by 1"),
)
def exact_median(spark, sf):
    found = quantiles(views.features(spark, sf), ["feature"], "value", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return rounded(found, ["feature"], ["median", "q1", "q3"])


# --- ranking ---------------------------------------------------------------------------
# Shapiro p has no SQL twin, so these use W in its place (any number works as sort key).

RNK = (
    "rn",
    """select *, row_number() over (order by score desc, shapiro_p desc nulls last, feature) as ranking from (
select *, (case when std_mean < 0.5 then 1 else 0 end + case when shapiro_p >= 0.05 then 1 else 0 end
 + case when missing < 0.05 then 2 else 0 end + case when abs(skewness) < 1 and abs(kurtosis) < 3 then 1 else 0 end)::int as score
from rf)""",
)
RF = (
    "rf",
    "select *, case when mean > 949 then mean / 1000 end as shapiro_p from (select feature, " + r6(**{c: c for c in _FEATS}) + " from pm)",
)


def _ranked(spark, sf):
    features = rounded(stats.feature_moments(_part_features(spark, sf), ["feature"]), ["feature"], _FEATS).withColumn(
        "shapiro_p", F.when(F.col("mean") > 949, F.col("mean") / 1000)
    )
    return ranking.add_ranking(features, "feature")


@check("win1_quality_score", with_(PF, PM, RF, RNK, select="select feature, score from rn"))
def quality_score(spark, sf):
    return _ranked(spark, sf).select("feature", "score")


@check("win2_ranking", with_(PF, PM, RF, RNK, select="select feature, score, ranking::int as ranking from rn"))
def feature_ranking(spark, sf):
    return _ranked(spark, sf).select("feature", "score", "ranking")


def _sql_fixed(x, digits):
    return f"case when {x} is null then 'nan' when {x} = 'inf'::double then 'inf' else printf('%.{digits}f', {x}) end"


@check(
    "win3_top_features",
    with_(PF, PM, RF, RNK, select="select ranking::int as ranking, feature, concat(ranking, '. ', feature, ' (Mean=', "
          + _sql_fixed("mean", 2) + ", ', Std=', " + _sql_fixed("std_dev", 2) + ", ', Shapiro p=', " + _sql_fixed("shapiro_p", 3)
          + ", ', Score=', score, ')') as line from rn where ranking <= 10"),
)
def top_features(spark, sf):
    return ranking.top_features(_ranked(spark, sf))


INTERPRET = """concat_ws('; ', case when std_mean < 0.5 then 'Stable variance' else 'High variance' end,
 case when shapiro_p >= 0.05 then 'Likely normal distribution' else 'Non-normal distribution' end,
 case when missing < 0.05 then 'Low missingness' when missing < 0.2 then 'Moderate missingness' when missing is not null then 'High missingness' end,
 case when skewness is not null and kurtosis is not null then
   case when abs(skewness) < 1 and abs(kurtosis) < 3 then 'Moderate shape' else 'Irregular shape' end end)"""


@check("win4_interpretation", with_(PF, PM, RF, RNK, select=f"select feature, {INTERPRET} as labels from rn"))
def interpretation(spark, sf):
    ranked = _ranked(spark, sf)
    return ranked.select("feature", ranking.interpretation(ranked).alias("labels"))


@check(
    "win5_summary_lines",
    with_(PF, PM, RF, RNK, select="select ranking::int as ranking, feature, concat('Rank ', ranking, ' (Score=', score, ') → Group ', feature, ': Mean=', "
          + _sql_fixed("mean", 2) + ", ', Std=', " + _sql_fixed("std_dev", 2) + ", ', Std/Mean=', " + _sql_fixed("std_mean", 2)
          + ", ', Shapiro-Wilk p=', " + _sql_fixed("shapiro_p", 3) + ", ', Skew=', " + _sql_fixed("skewness", 2) + ", ', Kurt=', "
          + _sql_fixed("kurtosis", 2) + ", ', Missing%=', " + _sql_fixed("missing * 100", 2) + f", ' → ', {INTERPRET}) as line from rn"),
)
def summary_lines(spark, sf):
    return ranking.summary_lines(_ranked(spark, sf), "feature")


# --- strata and selection --------------------------------------------------------------

SC = ("sc", views.V_SCORES)
STRATA = (
    "sta",
    """select id, score, case when pos <= floor(n * 0.25) then 'Low' when pos <= floor(n * 0.75) then 'Medium' else 'High' end as stratum
from (select *, row_number() over (order by score, id) as pos, count(*) over () as n from sc)""",
)
SEL = (
    "sel",
    """select id, score, stratum from (select *, row_number() over (partition by stratum order by md5(concat('42:', id)), id) as rn from sta)
where rn <= case stratum when 'Low' then 2 when 'Medium' then 4 else 3 end""",
)


@check("win6_strata", with_(SC, STRATA, select="select * from sta"))
def strata(spark, sf):
    return selection.strata(views.scores(spark, sf))


@check("win7_stratified_sample", with_(SC, STRATA, SEL, select="select * from sel"))
def stratified_sample(spark, sf):
    return selection.stratified_sample(views.scores(spark, sf))


# Scores with gaps: missing ones come last, so they are High.
_GAPS = ("sc", "select doc_id as id, case when doc_id % 7 = 0 then null else cast(n_chars as double) end as score from documents")


@check("win6_missing_scores", with_(_GAPS, (STRATA[0], STRATA[1].replace("order by score, id", "order by score is null, score, id")), select="select * from sta"))
def strata_missing(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id as id", "case when doc_id % 7 = 0 then null else cast(n_chars as double) end as score")
    return selection.strata(rows)


@check(
    "win8_tied_keys",
    "select source, max(last) - count(*) + 1 as first, max(last) as last, count(*) as numbers from "
    "(select source, count(*) over (order by source) as last from documents) group by source",
)
def tied_row_numbers(spark, sf):
    rows = row_index(table(spark, sf, "documents").select("source", "doc_id"), ["source"])
    return rows.groupBy("source").agg(
        F.min("row_index").alias("first"), F.max("row_index").alias("last"), F.count_distinct("row_index").alias("numbers")
    )


# A group without a name counts like any other.
_NAMELESS = ["case when p_size % 5 = 0 then null else p_brand end as feature", "p_retailprice as value"]


@check(
    "st1_null_group",
    with_(("fea", f"select {', '.join(_NAMELESS)} from part"), *SW, select=f"select feature, n, {r6(w='w')} from sw"),
)
def shapiro_null_group(spark, sf):
    return rounded(stats.shapiro_w(table(spark, sf, "part").selectExpr(*_NAMELESS), ["feature"]), ["feature", "n"], ["w"])


@check("win8_row_index", "select doc_id, row_number() over (order by source, doc_id) as row_index from documents")
def row_numbers(spark, sf):
    return row_index(table(spark, sf, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "row_index")


@check(
    "agg10_selection_summary",
    with_(SC, STRATA, SEL, select="select coalesce(stratum, 'TOTAL') as stratum, count(*) as n, min(score) as min_score, max(score) as max_score, "
          + r6(mean_score="avg(score)", score_range="max(score) - min(score)") + " from sel group by grouping sets ((stratum), ())"),
)
def selection_summary(spark, sf):
    summary = selection.selection_summary(selection.stratified_sample(views.scores(spark, sf)))
    return rounded(summary, ["stratum", "n", "min_score", "max_score"], ["mean_score", "score_range"])


@check(
    "agg11_representativeness",
    with_(SC, STRATA, SEL, select="select " + r6(population_mean="pm", population_std="ps", selection_mean="sm", difference="abs(pm - sm)")
          + ", abs(pm - sm) < 0.1 * ps as representative from (select avg(score) as pm, stddev_samp(score) as ps from sc), (select avg(score) as sm from sel)"),
)
def representativeness(spark, sf):
    scores = views.scores(spark, sf)
    facts = selection.representativeness(scores, selection.stratified_sample(scores))
    return rounded(facts, ["representative"], ["population_mean", "population_std", "selection_mean", "difference"])


@check(
    "set2_strata_union",
    with_(SC, STRATA, select="select stratum, count(*) as n, " + r6(mean="avg(score)") + " from sta group by 1"),
)
def strata_union(spark, sf):
    grouped = selection.strata(views.scores(spark, sf)).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")
    )
    return rounded(grouped, ["stratum", "n"], ["mean"])


@check(
    "plan_selected_prompts",
    with_(SC, STRATA, SEL, select="select sel.*, n_selected, n_population, " + r6(selection_mean="sm", selection_std="ss", population_std="ps")
          + ", abs(pm - sm) < 0.1 * ps as representative from sel, (select count(*) as n_selected, avg(score) as sm, stddev_samp(score) as ss from sel), "
          "(select count(*) as n_population, avg(score) as pm, stddev_samp(score) as ps from sc)"),
)
def selected_prompts(spark, sf):
    paths = reports.selection_report(views.scores(spark, sf), f"{shared_folder(spark)}/selection-{uuid.uuid4().hex}")
    facts = spark.read.parquet(paths["selection_check"]).select(F.struct("*").alias("c")).scalar()
    names = ["n_selected", "n_population", "selection_mean", "selection_std", "population_std", "representative"]
    rows = spark.read.parquet(paths["selected_prompts"]).withColumns({n: facts[n] for n in names})
    return rounded(rows, ["id", "score", "stratum", "n_selected", "n_population", "representative"], names[2:5])
