"""Rounding and normal-distribution expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_975 = 1.959963984540054  # 97.5% point of the standard normal distribution


def py_round(x: Column, digits: int) -> Column:
    """Python's ``round(float, digits)``: half to even on the exact binary value.

    ``x * 10**digits`` is computed together with its exact rounding error (a split
    product), so a product that only looks like a tie is resolved the right way.
    Pass a plain column: the expression uses it several times.
    """
    m = F.lit(float(10**digits))
    x = x.cast("double")
    p = x * m
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    error = (high * m - p) + (x - high) * m
    tie = (p - F.floor(p).cast("double")) == F.lit(0.5)
    nearest = (
        F.when(tie & (error > 0), F.rint(p + 0.25))
        .when(tie & (error < 0), F.rint(p - 0.25))
        .otherwise(F.rint(p))
    )
    # from 2**52 on the product has no fraction left to round; "+ 0.0" turns -0.0 into 0.0
    return F.when(F.abs(p) < 4503599627370496.0, nearest / m + F.lit(0.0)).otherwise(x)


def np_round(x: Column, digits: int) -> Column:
    """numpy's round: scale, round half to even, scale back."""
    m = F.lit(float(10**digits))
    return F.rint(x.cast("double") * m) / m + F.lit(0.0)


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """``num / den``, or ``default`` where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(
        F.lit(default).cast("double")
    )


def finite(x: Column) -> Column:
    """The non-null test of the statistics: NaN counts as missing, infinity does not."""
    return x.isNotNull() & ~F.isnan(x)


# Algorithm AS 241 (Wichura 1988), PPND16, numerators and denominators.
_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
_MIDDLE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)
_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15],
)


def _polynomial(coefficients: list[float], x: Column) -> Column:
    result = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = result * x + F.lit(c)
    return result


def normal_quantile(q: Column, r: Column) -> Column:
    """Inverse normal from q = p - 1/2 and r = sqrt(-ln(min(p, 1 - p))); pass plain columns."""
    centre, middle, tail = F.lit(0.180625) - q * q, r - 1.6, r - 5.0
    outer = F.when(r <= 5.0, _polynomial(_MIDDLE[0], middle) / _polynomial(_MIDDLE[1], middle)).otherwise(
        _polynomial(_TAIL[0], tail) / _polynomial(_TAIL[1], tail)
    )
    return F.when(
        F.abs(q) <= 0.425, q * _polynomial(_CENTRE[0], centre) / _polynomial(_CENTRE[1], centre)
    ).otherwise(F.when(q < 0, -outer).otherwise(outer))


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the standard normal quantile of ``p`` (0 < p < 1) as column ``name``.

    The two intermediate columns keep the generated code small.
    """
    step = df.withColumn("_p", p).withColumns(
        {"_q": F.col("_p") - 0.5, "_r": F.sqrt(-F.ln(F.least(F.col("_p"), 1 - F.col("_p"))))}
    )
    return step.withColumn(name, normal_quantile(F.col("_q"), F.col("_r"))).drop("_p", "_q", "_r")
