"""Statistics of report columns: moments, normality, tests, effect sizes, curves.

Sums and moments combine before they shuffle. Order statistics go through
``value_positions``, so no feature is ever sorted inside one task. The small UDFs of
``functions.tails`` see one aggregated row per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import tails
from quillgauge.functions.numbers import Z_975, finite, np_round, with_normal_quantile
from quillgauge.operators.positions import quantiles, rank_rows, value_positions
from quillgauge.operators.skew import keyed_join, salted_join
from quillgauge.session import materialize


def _c(name: str) -> Column:
    return F.col(name)


def _safe(num: Column, den: Column) -> Column:
    """num / den, null where den is zero."""
    return num / F.when(den != 0, den)


def present(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a value; infinity counts, NaN does not."""
    return df.filter(finite(_c(value)))


# --- normality -------------------------------------------------------------------------


def _poly(u: Column, coefficients: list[float]) -> Column:
    """c1 u + c2 u^2 + ..."""
    result = F.lit(0.0)
    for k in reversed(coefficients):
        result = (result + k) * u
    return result


#: Ranks at each end of a sample whose normal scores are summed one by one.
EDGE = 32


def _inside_sum(z: Column, big: Column) -> Column:
    """Antiderivative of the normal scores over ranks at the score ``z``, with the Euler-Maclaurin terms
    of the midpoint rule; ``big`` is n + 1/4. Beyond ``EDGE`` ranks from the ends the error is below 1e-10."""
    density = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
    g = 1.0 / (big * density)  # the score's growth from rank to rank
    g3 = g * g * g
    return (
        -big * density - g / 24.0 + (7.0 / 5760.0) * g3 * (1.0 + 2.0 * z * z)
        - (31.0 / 967680.0) * g3 * g * g * (7.0 + 46.0 * z * z + 24.0 * z * z * z * z)
    )


def _inside_squares(z: Column, big: Column) -> Column:
    """Sum of the squared normal scores of all ranks but ``EDGE`` at each end, ``z`` being the score
    half a rank beyond the lower ones; the same terms for the square."""
    density = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
    g = 1.0 / (big * density)
    g3 = g * g * g
    return (
        big * (1 - 2 * (EDGE + 0.125) / big + 2 * z * density) + z * g / 6.0 - (7.0 / 720.0) * z * g3 * (2.0 + z * z)
        + (31.0 / 483840.0) * g3 * g * g * (104.0 * z + 192.0 * z * z * z + 48.0 * z * z * z * z * z)
    )


def shapiro_w(
    df: DataFrame, keys: list[str], value: str = "value", largest: int | None = None, weight: Column | None = None
) -> DataFrame:
    """Shapiro-Wilk W per group (Royston 1995): (keys, n, w); null below three values.

    ``largest`` gives null above that many values instead. Equal values are one row with a count:
    the normal scores of the ranks they take are a difference of running sums, which only near
    the ends of the sample are summed rank by rank.
    """
    at_value = value_positions(present(df, value), keys, value, weight=weight, mean="_mean")
    if largest is not None:
        at_value = at_value.filter(_c("n") <= largest)
    big = _c("n") + 0.25

    def with_score(df: DataFrame, i: Column, name: str) -> DataFrame:
        return with_normal_quantile(df, (i - 0.375) / big, name)

    before, last, low, high = _c("before"), _c("before") + _c("cnt"), F.lit(EDGE), F.greatest(_c("n") - EDGE, F.lit(EDGE))
    nothing = F.array().cast("array<struct<p:double,part:int>>")

    def ranks(after: Column, to: Column) -> Column:
        point = lambda i: F.struct(((i - 0.375) / big).alias("p"), F.lit(0).alias("part"))
        return F.when(to > after, F.transform(F.sequence(after + 1, to), point)).otherwise(nothing)

    def border(r: Column, part: int) -> Column:
        return F.struct(((r + 0.125) / big).alias("p"), F.lit(part).alias("part"))

    # a value's ranks near the ends one by one, those between as the two borders of their interval
    inner_from, inner_to = F.greatest(before, low), F.least(last, _c("n") - EDGE)
    points = F.concat(
        ranks(before, F.least(last, low)), ranks(F.greatest(before, high), last),
        F.when(inner_to > inner_from, F.array(border(inner_to, 1), border(inner_from, -1))).otherwise(nothing),
    )
    spread = at_value.select(
        *keys, "n", "cnt", "before", value, (_c(value) - _c("_mean")).alias("_v"), F.posexplode(points).alias("_i", "_at")
    )
    scored = with_normal_quantile(spread, _c("_at.p"), "_z")
    part, once = _c("_at.part"), _c("_i") == 0
    score = F.when(part == 0, _c("_z")).otherwise(part * _inside_sum(_c("_z"), big))

    def rank(i: Column) -> Column:
        return F.max(F.when((before < i) & (i <= last), _c(value)))

    sums = scored.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.when(once, _c("cnt") * _c("_v") * _c("_v"))).alias("_ss"),
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.sum(_c("_v") * score).alias("_smx"), F.sum(F.when(part == 0, _c("_z") * _c("_z")).otherwise(0.0)).alias("_outer"),
        rank(F.lit(1)).alias("_x1"), rank(F.lit(2)).alias("_x2"), rank(_c("n") - 1).alias("_y2"), rank(_c("n")).alias("_y1"),
    )
    sums = with_normal_quantile(sums, F.when(_c("n") > 2 * EDGE, (EDGE + 0.125) / big).otherwise(0.5), "_ze")
    squares = F.when(_c("n") > 2 * EDGE, _inside_squares(_c("_ze"), big)).otherwise(0.0)
    sums = sums.withColumn("_ssq", _c("_outer") + squares)
    n, u = _c("n").cast("double"), 1.0 / F.sqrt(_c("n").cast("double"))
    # Polynomial coefficients of the outer weights (AS R94).
    step = with_score(with_score(sums, n, "_m1"), n - 1, "_m2")
    step = step.withColumns(
        {
            "_a1": _poly(u, [0.221157, -0.147981, -2.07119, 4.434685, -2.706056]) + _safe(_c("_m1"), F.sqrt("_ssq")),
            "_a2": _poly(u, [0.042981, -0.293762, -1.752461, 5.682633, -3.582633]) + _safe(_c("_m2"), F.sqrt("_ssq")),
            "_d1": _c("_y1") - _c("_x1"), "_d2": _c("_y2") - _c("_x2"),
        },
    )
    a1, a2, m1, m2 = (_c(x) for x in ("_a1", "_a2", "_m1", "_m2"))
    phi = F.when(
        _c("n") > 5, _safe(_c("_ssq") - 2 * m1 * m1 - 2 * m2 * m2, 1 - 2 * a1 * a1 - 2 * a2 * a2)
    ).otherwise(_safe(_c("_ssq") - 2 * m1 * m1, 1 - 2 * a1 * a1))
    middle = F.when(_c("n") > 5, _c("_smx") - m1 * _c("_d1") - m2 * _c("_d2")).otherwise(_c("_smx") - m1 * _c("_d1"))
    outer = F.when(_c("n") > 5, a1 * _c("_d1") + a2 * _c("_d2")).otherwise(a1 * _c("_d1"))
    # three values: the weights are -sqrt(1/2), 0, sqrt(1/2)
    b = F.when(_c("n") == 3, _c("_d1") * math.sqrt(0.5)).when(_c("n") > 3, outer + _safe(middle, F.sqrt(F.greatest(phi, F.lit(0.0)))))
    w = F.when(_c("n") < 3, None).when(_c("_min") == _c("_max"), 1.0).otherwise(F.least(_safe(b * b, _c("_ss")), F.lit(1.0)))
    return step.select(*keys, "n", w.cast("double").alias("w"))


def shapiro(
    df: DataFrame, keys: list[str], value: str = "value", largest: int | None = None, weight: Column | None = None
) -> DataFrame:
    """Shapiro-Wilk per group: (keys, n, w, shapiro_p)."""
    return shapiro_w(df, keys, value, largest, weight).withColumn("shapiro_p", tails.shapiro_p_udf("w", "n"))


# --- two samples -----------------------------------------------------------------------


def rank_sum(
    df: DataFrame, keys: list[str], is_x: Column, value: str = "value", weight: Column | None = None
) -> DataFrame:
    """Mann-Whitney per group: nx, ny, u (of x), ties, mwu_p, mwu_z (no tie correction), delta."""
    one = F.lit(1) if weight is None else weight
    at = value_positions(
        present(df, value), keys, value, weight=weight,
        sums={"_x": F.when(is_x, one).otherwise(0), "_y": F.when(is_x, 0).otherwise(one)},
    )
    rank = _c("before") + (_c("cnt") + 1) / 2.0
    cnt = _c("cnt").cast("double")
    sums = at.groupBy(*keys).agg(
        F.sum("_x").alias("nx"), F.sum("_y").alias("ny"), F.sum(_c("_x") * rank).alias("_rx"),
        F.sum(cnt * cnt * cnt - cnt).alias("ties"),
    )
    nx, ny = _c("nx").cast("double"), _c("ny").cast("double")
    step = sums.withColumn("u", _c("_rx") - nx * (nx + 1) / 2.0)
    both = (_c("nx") > 0) & (_c("ny") > 0)
    return step.withColumns(
        {
            "mwu_z": F.when(both, _safe(_c("u") - nx * ny / 2.0, F.sqrt(nx * ny * (nx + ny + 1) / 12.0))),
            "delta": F.when(both, _safe(2.0 * _c("u"), nx * ny) - 1.0),
            "mwu_p": tails.rank_sum_p_udf(F.when(both, _c("u")), nx, ny, _c("ties")),
        }
    ).select(*keys, "nx", "ny", "u", "ties", "mwu_z", "delta", "mwu_p")


def two_sample_moments(df: DataFrame, keys: list[str], is_x: Column, value: str = "value") -> DataFrame:
    """Means and variances of both samples, Welch's t and df, and Cohen's d (pooled)."""
    x, y = F.when(is_x, _c(value)), F.when(~is_x, _c(value))
    sums = present(df, value).groupBy(*keys).agg(
        F.count(x).alias("nx"), F.count(y).alias("ny"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"),
    )
    return _compare_moments(sums)


def _compare_moments(sums: DataFrame) -> DataFrame:
    enough = (_c("nx") >= 2) & (_c("ny") >= 2)
    sx, sy = _c("vx") / _c("nx"), _c("vy") / _c("ny")
    sums = sums.withColumns({"_sx": F.when(enough, sx), "_sy": F.when(enough, sy)})
    pooled = F.sqrt(((_c("nx") - 1) * _c("vx") + (_c("ny") - 1) * _c("vy")) / F.when(enough, _c("nx") + _c("ny") - 2))
    spread = _c("_sx") + _c("_sy")
    return sums.withColumns(
        {
            "welch_t": _safe(_c("mx") - _c("my"), F.sqrt(spread)),
            "welch_df": _safe(
                spread * spread,
                _c("_sx") * _c("_sx") / F.when(enough, _c("nx") - 1) + _c("_sy") * _c("_sy") / F.when(enough, _c("ny") - 1),
            ),
            "cohen_d": F.when(enough, F.when(pooled == 0, 0.0).otherwise(_safe(_c("mx") - _c("my"), pooled))),
        }
    ).drop("_sx", "_sy")


# --- column statistics -----------------------------------------------------------------


def column_moments(long: DataFrame, key: str = "column", value: str = "value") -> DataFrame:
    """Per column with at least three values: mean, sample deviation, z and effect against 0,
    and the normal 95% interval (the mean itself for constant columns)."""
    base = present(long, value).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_dev")
    ).filter(_c("n") >= 3)
    error = _c("std_dev") / F.sqrt(_c("n").cast("double"))
    varies = _c("std_dev") > 0
    half = F.when(varies, error * Z_975).otherwise(0.0)
    return base.withColumns(
        {
            "z_stat": F.when(varies, _safe(_c("mean"), error)).otherwise(0.0),
            "effect_size": F.when(varies, _safe(_c("mean"), _c("std_dev"))).otherwise(0.0),
            "ci_low": _c("mean") - half,
            "ci_high": _c("mean") + half,
        }
    )


def _rounded(df: DataFrame, keep: list[str], columns: list[str], digits: int) -> DataFrame:
    return df.select(*keep, *[np_round(_c(c), digits).alias(c) for c in columns])


def column_statistics(long: DataFrame, key: str = "column", value: str = "value", largest: int | None = None) -> DataFrame:
    """The syntax report's statistics table: tests each column against a mean of 0.

    ``largest`` leaves the Shapiro p of columns with more values out (null).
    """
    joined = keyed_join(
        column_moments(long, key, value), shapiro(long, [key], value, largest=largest).select(key, "shapiro_p"), [key], "left"
    )
    varies = _c("std_dev") > 0
    full = joined.withColumns(
        {
            "p_value": F.when(varies, tails.normal_two_sided_udf("z_stat")).otherwise(1.0),
            "power": F.when(varies, tails.z_power_udf("z_stat", F.lit(Z_975))).otherwise(0.0),
            "mwu_p": F.lit(None).cast("double"),
        }
    )
    return _rounded(full, [key], ["mean", "std_dev", "shapiro_p", "z_stat", "p_value", "effect_size", "power",
                                  "mwu_p", "ci_low", "ci_high"], 6)


def metric_moments(long: DataFrame, key: str = "metric", value: str = "value", centre: float = 0.5) -> DataFrame:
    """Per metric with two values and more: mean, population deviation, t and effect against
    ``centre``, the normal interval (null for constant metrics) and Mann-Whitney's U against
    as many copies of ``centre``, which needs only counts."""
    rows = present(long, value)
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_k"))
    k = _c("_k").cast("double")
    # ties of the joint sample: every other value ties with itself, the centre with its n copies
    ties = counted.groupBy(key).agg(
        F.sum(F.when(_c(value) != centre, k * k * k - k).otherwise(0.0)).alias("_own"),
        F.sum(F.when(_c(value) == centre, k).otherwise(0.0)).alias("_eq"),
        F.sum(F.when(_c(value) > centre, k).otherwise(0.0)).alias("_gt"),
    )
    base = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"),
        F.stddev_samp(value).alias("_s"),
    ).filter(_c("n") >= 2)
    n = _c("n").cast("double")
    shared = _c("_eq") + n
    gap = _c("mean") - centre
    no_spread = F.when(gap == 0, F.lit(None).cast("double")).when(gap > 0, float("inf")).otherwise(float("-inf"))
    varies = _c("std_dev") > 0
    half = F.when(varies, Z_975 * _c("std_dev") / F.sqrt(n))
    return keyed_join(base, ties, [key]).select(
        key, "n", "mean", "std_dev",
        F.when(varies, _safe(gap, _c("_s") / F.sqrt(n))).otherwise(no_spread).alias("z_stat"),
        F.when(varies, _safe(gap, _c("std_dev"))).otherwise(0.0).alias("effect_size"),
        (_c("mean") - half).alias("ci_low"),
        (_c("mean") + half).alias("ci_high"),
        (_c("_gt") * n + 0.5 * _c("_eq") * n).alias("u"),
        (_c("_own") + shared * shared * shared - shared).alias("ties"),
    )


def metric_statistics(long: DataFrame, key: str = "metric", value: str = "value", centre: float = 0.5) -> DataFrame:
    """The correspondence report's statistics table. Power is always null there."""
    joined = keyed_join(metric_moments(long, key, value, centre), shapiro(long, [key], value).select(key, "shapiro_p"), [key], "left")
    n = _c("n").cast("double")
    full = joined.withColumns(
        {
            "p_value": tails.t_two_sided_udf("z_stat", n - 1),
            "power": F.lit(None).cast("double"),
            "mwu_p": tails.rank_sum_p_udf(_c("u"), n, n, _c("ties")),
        }
    )
    return _rounded(full, [key], ["mean", "std_dev", "shapiro_p", "z_stat", "p_value", "effect_size", "power",
                                  "mwu_p", "ci_low", "ci_high"], 4)


# --- pair statistics -------------------------------------------------------------------


def pair_values(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """(column, metric, kind, value, cnt): each labelled pair counts for both of its columns.

    The similarities have four decimals, so counting equal values before the shuffle leaves
    at most ten thousand rows per column, metric and kind, whatever the number of stories.
    """
    long = pairs.withColumn(
        "_m", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _c(m).alias("value")) for m in metrics]))
    ).select(F.explode(F.array("a", "b")).alias("column"), "kind", "_m.metric", "_m.value")
    return present(long).groupBy("column", "metric", "kind", "value").agg(F.count(F.lit(1)).alias("cnt"))


def pair_moments(values: DataFrame) -> DataFrame:
    """Per (column, metric): moments of all values, and of the intra and inter samples."""
    keys = ["column", "metric"]
    pieces, finished = [], []
    for n, mean, var, test in (
        ("n_all", "mean", "_v", F.lit(True)), ("nx", "mx", "vx", _c("kind") == "intra"), ("ny", "my", "vy", _c("kind") == "inter")
    ):
        k, v = F.when(test, _c("cnt")), F.when(test, _c("value"))
        pieces += [
            F.coalesce(F.sum(k), F.lit(0)).alias(n), F.sum(k * v).alias(f"_s{n}"), F.sum(k * v * v).alias(f"_q{n}"),
            F.min(v).alias(f"_lo{n}"), F.max(v).alias(f"_hi{n}"),
        ]
        average = _safe(_c(f"_s{n}"), _c(n))
        squares = F.when(_c(f"_lo{n}") == _c(f"_hi{n}"), 0.0).otherwise(_c(f"_q{n}") - _c(f"_s{n}") * average)
        finished += [_c(n), average.alias(mean), F.when(_c(n) > 1, _safe(squares, _c(n) - 1)).alias(var)]
    sums = values.groupBy(*keys).agg(*pieces).select(*keys, *finished).withColumn("std_dev", F.sqrt("_v"))
    half = Z_975 * _c("std_dev") / F.sqrt(_c("n_all").cast("double"))
    return (
        _compare_moments(sums.withColumns({"ci_low": _c("mean") - half, "ci_high": _c("mean") + half}))
        .drop("_v", "mx", "my", "vx", "vy")
        .withColumnsRenamed({"nx": "n_intra", "ny": "n_inter"})
    )


def pair_statistics(pairs: DataFrame, metrics: list[str], alpha: float = 0.05, sizes_ratio: bool = True) -> DataFrame:
    """The similarity report's statistics per (column, metric).

    Welch's t with Cohen's d when both samples have three values and pass Shapiro-Wilk,
    else Mann-Whitney with Cliff's delta; both need two values in each sample. The power
    uses the true size ratio unless ``sizes_ratio`` is off (then 1).
    """
    keys = ["column", "metric"]
    # the small table of counted values is kept once; every test below reads it
    values = materialize(pair_values(pairs, metrics))
    samples = values.withColumn("sample", F.explode(F.array(F.lit("all"), _c("kind"))))
    normality = shapiro(samples, [*keys, "sample"], weight=_c("cnt")).groupBy(*keys).pivot("sample", ["all", "intra", "inter"]).agg(
        F.first("shapiro_p")
    )
    tests = rank_sum(values, keys, _c("kind") == "intra", weight=_c("cnt")).select(*keys, "mwu_z", "delta", "mwu_p")
    joined = keyed_join(keyed_join(pair_moments(values), normality, keys, "left"), tests, keys, "left")
    testable = (_c("n_intra") >= 2) & (_c("n_inter") >= 2)
    normal = F.coalesce(
        (_c("n_intra") >= 3) & (_c("n_inter") >= 3) & (_c("intra") > alpha) & (_c("inter") > alpha), F.lit(False)
    )
    chosen = joined.withColumn("_normal", normal).withColumn(
        "_effect", F.when(_c("_normal"), _c("cohen_d")).otherwise(_c("delta"))
    )
    strength = F.abs("_effect") * F.when(_c("_normal"), 1.0).otherwise(1.1)
    sizes = _c("n_inter") / F.when(_c("n_intra") > 0, _c("n_intra")).cast("double") if sizes_ratio else F.lit(1.0)
    full = chosen.withColumns(
        {
            "shapiro_p": _c("all"),
            "z_stat": F.when(testable, F.when(_c("_normal"), _c("welch_t")).otherwise(_c("mwu_z"))),
            "_welch_p": tails.t_two_sided_udf(F.when(testable & _c("_normal"), _c("welch_t")), _c("welch_df")),
            "effect_size": F.when(testable, _c("_effect")),
            "power": tails.t_power_udf(
                F.when(testable & (strength > 0), strength), _c("n_intra").cast("double"), sizes, F.lit(alpha)
            ),
            "mwu_p": F.when(testable, _c("mwu_p")),
        }
    ).withColumn("p_value", F.when(_c("_normal"), _c("_welch_p")).otherwise(_c("mwu_p")))
    return _rounded(
        full.withColumn("model_group", F.upper(F.substring("column", 1, 3))),
        [*keys, "model_group", "n_all", "n_intra", "n_inter"],
        ["mean", "std_dev", "shapiro_p", "z_stat", "p_value", "effect_size", "power", "mwu_p", "ci_low", "ci_high"], 6,
    )


# --- feature statistics ----------------------------------------------------------------


def feature_moments(long: DataFrame, keys: list[str], value: str = "value", rescale: str = "reference") -> DataFrame:
    """Per feature: mean, sample deviation, |std/mean| (infinite for mean 0), biased skewness and
    excess kurtosis (more than three values), share of missing values.

    Features whose values all lie in 0..100 are divided by 100; ``percent_only`` leaves those
    alone that already lie in 0..1. A feature without values keeps one row, all missing.
    """
    v = F.when(finite(_c(value)), _c(value))
    base = long.groupBy(*keys).agg(
        F.count(v).alias("n"), F.count(F.lit(1)).alias("_rows"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"),
        F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"), F.min(v).alias("_min"), F.max(v).alias("_max"),
    )
    percent = (_c("_min") >= 0) & (_c("_max") <= 100)
    if rescale == "percent_only":
        percent = percent & (_c("_max") > 1)
    factor = F.when(percent, 100.0).otherwise(1.0)
    return base.select(
        *keys, "n",
        (_c("_mean") / factor).alias("mean"),
        (_c("_std") / factor).alias("std_dev"),
        F.when(_c("n") > 0, F.when(_c("_mean") == 0, float("inf")).otherwise(F.abs(_safe(_c("_std"), _c("_mean"))))).alias("std_mean"),
        F.when(_c("n") > 3, _c("_skew")).alias("skewness"),
        F.when(_c("n") > 3, _c("_kurt")).alias("kurtosis"),
        (1.0 - _c("n") / _c("_rows")).alias("missing"),
    )


def feature_statistics(long: DataFrame, keys: list[str], value: str = "value", rescale: str = "reference") -> DataFrame:
    """Feature moments with the Shapiro-Wilk p (more than three values)."""
    normal = shapiro(long, keys, value).select(*keys, F.when(_c("n") > 3, _c("shapiro_p")).alias("shapiro_p"))
    return keyed_join(feature_moments(long, keys, value, rescale), normal, keys, "left")


FEATURE_COLUMNS = ["mean", "std_dev", "std_mean", "shapiro_p", "skewness", "kurtosis", "missing"]


def feature_group(feature: Column, prompted: bool = False) -> Column:
    """Group key: the first three characters of the feature name; features of a ``prompted``
    (prompt-code) report take the three characters after ``prompt_`` where it occurs."""
    if not prompted:
        return F.substring(feature, 1, 3)
    return F.when(
        F.contains(feature, F.lit("prompt_")), F.substring(F.element_at(F.split(feature, "prompt_", -1), 2), 1, 3)
    ).otherwise(F.substring(feature, 1, 3))


def group_statistics(features: DataFrame, group: str = "grp", columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Unweighted mean of the feature statistics of each group, nulls skipped."""
    return features.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns if c in features.columns])


def report_averages(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Average of the report columns of each (file, group)."""
    return present(long, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("average"))


# --- plotted data ----------------------------------------------------------------------


def qq_points(df: DataFrame, keys: list[str], value: str = "value", positions: str = "filliben") -> DataFrame:
    """Normal Q-Q points: (keys, i, theoretical, value), one row per value.

    ``filliben`` are the order-statistic medians, ``weibull`` is i / (n + 1).
    """
    i, n = _c("i").cast("double"), _c("n").cast("double")
    if positions == "weibull":
        p = i / (n + 1.0)
    else:
        end = F.pow(F.lit(0.5), 1.0 / n)
        p = F.when(_c("i") == _c("n"), end).when(_c("i") == 1, 1.0 - end).otherwise((i - 0.3175) / (n + 0.365))
    rows = rank_rows(value_positions(present(df, value), keys, value), keys, value)
    return with_normal_quantile(rows, p, "theoretical").select(*keys, "i", "theoretical", value)


def histogram(df: DataFrame, keys: list[str], value: str = "value", bins: int | None = None) -> DataFrame:
    """Equal-width bins over each feature's range: (keys, bin, low, high, count).

    Without ``bins`` the width is the smaller of Freedman-Diaconis and Sturges.
    """
    rows = present(df, value)
    ends = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    span = _c("_hi") - _c("_lo")
    if bins is None:
        ends = keyed_join(ends, quantiles(rows, keys, value, {"_q1": 0.25, "_q3": 0.75}), keys)
        diaconis = 2.0 * (_c("_q3") - _c("_q1")) / F.pow(_c("_n").cast("double"), F.lit(1.0 / 3.0))
        sturges = span / (F.log2(_c("_n").cast("double")) + 1.0)
        width = F.when(diaconis > 0, F.least(diaconis, sturges)).otherwise(sturges)
        ends = ends.withColumn("_bins", F.when(width > 0, F.ceil(_safe(span, width))).otherwise(1)).drop("_q1", "_q3")
    else:
        ends = ends.withColumn("_bins", F.lit(bins).cast("bigint"))
    ends = ends.withColumns(
        {"_lo": F.when(span > 0, _c("_lo")).otherwise(_c("_lo") - 0.5), "_hi": F.when(span > 0, _c("_hi")).otherwise(_c("_hi") + 0.5)}
    )
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    placed = salted_join(counted, ends, keys, _c(value))
    spot = F.least(
        F.floor((_c(value) - _c("_lo")) / (_c("_hi") - _c("_lo")) * _c("_bins")), _c("_bins") - 1
    )
    width = (_c("_hi") - _c("_lo")) / _c("_bins")
    return (
        placed.withColumns({"bin": spot.cast("bigint"), "_w": width})
        .groupBy(*keys, "bin", "_lo", "_w").agg(F.sum("_k").alias("count"))
        .select(*keys, "bin", (_c("_lo") + _c("bin") * _c("_w")).alias("low"),
                (_c("_lo") + (_c("bin") + 1) * _c("_w")).alias("high"), "count")
    )


def normal_curve(df: DataFrame, keys: list[str], value: str = "value", points: int = 200) -> DataFrame:
    """Density of the fitted normal (population deviation) on a grid over the feature's range."""
    fitted = present(df, value).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    ).filter((_c("_n") >= 3) & (_c("_sd") > 0))
    grid = fitted.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = _c("_lo") + _c("point") * (_c("_hi") - _c("_lo")) / float(points - 1)
    z = (_c("x") - _c("_mu")) / _c("_sd")
    return grid.withColumn("x", x).select(
        *keys, "point", "x", (F.exp(-0.5 * z * z) / (_c("_sd") * math.sqrt(2.0 * math.pi))).alias("density")
    )


#: Cells per bandwidth, terms kept of a value's place in its cell, and the kernel's reach in bandwidths.
CELLS, TERMS, REACH = 4, 10, 9.0


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of the probabilists' Hermite polynomials, lowest power first."""
    rows = [[1], [0, 1]]
    for j in range(1, terms - 1):
        shifted, before = [0, *rows[j]], rows[j - 1]
        rows.append([c - j * (before[i] if i < len(before) else 0) for i, c in enumerate(shifted)])
    return rows[:terms]


def density(df: DataFrame, keys: list[str], value: str = "value", points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid: bandwidth n^(-1/5) times the sample deviation.

    Values are put into cells of a quarter of a bandwidth, kept as a count and moments about
    the cell's middle; each cell then adds the kernel, expanded in Hermite polynomials, to the grid
    points within nine bandwidths. What is left out is below 1e-11 of the kernel's height for each
    value. A value is one row, a cell a few.
    """
    rows = present(df, value)
    fitted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    ).filter(_c("_sd") > 0)
    fitted = fitted.withColumn("_bw", F.pow(_c("_n"), F.lit(-0.2)) * _c("_sd"))
    start = _c("_lo") - cut * _c("_bw")
    step = (_c("_hi") - _c("_lo") + 2.0 * cut * _c("_bw")) / float(points - 1)
    fitted = fitted.select(*keys, "_n", "_bw", start.alias("_start"), step.alias("_step"))
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    width = _c("_bw") / CELLS
    placed = salted_join(counted, fitted, keys, _c(value)).withColumn("_cell", F.floor((_c(value) - _c("_start")) / width)).withColumn(
        "_t", (_c(value) - _c("_start") - (_c("_cell") + 0.5) * width) / _c("_bw")
    )
    powers = [F.sum(_c("_k") * F.pow(_c("_t"), F.lit(j)) / float(math.factorial(j))).alias(f"_m{j}") for j in range(TERMS)]
    cells = placed.groupBy(*keys, "_cell", "_n", "_bw", "_start", "_step").agg(*powers)
    hermite = _hermite(TERMS)
    series = {
        f"_c{i}": sum((_c(f"_m{j}") * float(hermite[j][i]) for j in range(i, TERMS) if hermite[j][i]), F.lit(0.0)) for i in range(TERMS)
    }
    middle = (_c("_cell") + 0.5) * width
    first = F.greatest(F.ceil((middle - REACH * _c("_bw")) / _c("_step")), F.lit(0)).cast("int")
    last = F.least(F.floor((middle + REACH * _c("_bw")) / _c("_step")), F.lit(points - 1)).cast("int")
    spread = cells.withColumns(series | {"_middle": middle}).withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last))))
    at = spread.withColumn("_u", (_c("point") * _c("_step") - _c("_middle")) / _c("_bw"))
    kernel = _c(f"_c{TERMS - 1}")
    for i in reversed(range(TERMS - 1)):
        kernel = kernel * _c("_u") + _c(f"_c{i}")
    added = at.groupBy(*keys, "point").agg(F.sum(F.exp(-0.5 * _c("_u") * _c("_u")) * kernel).alias("_s"))
    grid = fitted.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return keyed_join(grid, added, [*keys, "point"], "left").select(
        *keys, "point", (_c("_start") + _c("point") * _c("_step")).alias("x"),
        (F.coalesce(F.greatest("_s", F.lit(0.0)), F.lit(0.0)) / (_c("_n") * _c("_bw") * math.sqrt(2.0 * math.pi))).alias("density"),
    )