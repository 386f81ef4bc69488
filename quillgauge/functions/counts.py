"""Term counts kept as maps inside a row, and sums over the terms two maps share.

A map is built from the row's own text and two maps of a pair are matched by
``map_zip_with`` (a hash match in the JVM), so comparing two texts that already sit in
one row needs neither another shuffle nor Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgauge.functions.text import let


def grams(tokens: Column, n: int) -> Column:
    """n-grams of a token array, joined by one blank."""
    if n == 1:
        return tokens
    return let(
        tokens,
        lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.size(t) - (n - 1)),
                lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "),
            )
        ),
    )


def term_counts(terms: Column) -> Column:
    """map<term, count> of an array: sort it, then measure the runs of equal terms."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            starts,
            lambda b: F.map_from_arrays(
                F.transform(b, lambda i: F.element_at(s, i)),
                F.zip_with(
                    b,
                    F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s) + 1)),
                    lambda lo, hi: hi - lo,
                ),
            ),
        )

    return let(
        F.sort_array(terms),
        lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.create_map().cast("map<string,int>")),
    )


def matched(left: Column, right: Column) -> Column:
    """array<struct<l, r>> of the values of the keys both maps have."""
    both = F.map_zip_with(
        left, right,
        lambda _, a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("l"), b.alias("r"))),
    )
    return F.filter(F.map_values(both), lambda s: s.isNotNull())


def total(values: Column) -> Column:
    """Sum of a numeric array as double, 0 when empty."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
