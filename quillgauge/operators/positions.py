"""Exact order statistics without putting a group into one task.

A window ``partitionBy(feature).orderBy(value)`` sorts a whole feature in one task, which
fails when one feature holds a third of all rows. Here:

1. equal values are counted first (combined before the shuffle), so a hot value is one row;
2. a fixed-size sample of the distinct values - the value with the smallest hash in each of
   ``samples`` hash classes, hence the same on every evaluation - gives splitters that cut a
   feature into about equal ranges;
3. only the per-range totals are summed in order, and the running count inside a range is a
   window over that range alone.

The result is exact; the sample only decides where ranges are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.operators.skew import salted_join


def value_positions(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column] | None = None,
    weight: Column | None = None,
    ranges: int = 128,
    mean: str | None = None,
) -> DataFrame:
    """One row per (keys, distinct value): ``cnt``, ``before`` and the group's ``n`` (and its ``mean``).

    ``before`` is the number of rows of the group with a smaller value. ``sums`` adds more
    totals per value (for two-sample ranks); ``weight`` counts a row that often. Rows
    without a value are left out; a null key is a group like any other.
    """
    if keys:  # as one struct, keys are never null: joins keep null groups, and plans share their exchange
        packed = df.withColumn("_group", F.struct(*keys)).drop(*keys)
        found = _positions(packed, ["_group"], value, sums, weight, ranges, mean)
        return found.select(*[F.col(f"_group.{k}").alias(k) for k in keys], *[c for c in found.columns if c != "_group"])
    return _positions(df, keys, value, sums, weight, ranges, mean)


def _positions(
    df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None, weight: Column | None, ranges: int,
    mean: str | None,
) -> DataFrame:
    extra = {name: F.sum(e).alias(name) for name, e in (sums or {}).items()}
    present = df.filter(F.col(value).isNotNull())
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = present.groupBy(*keys, value).agg(count.alias("cnt"), *extra.values())

    samples = ranges * 8
    # this filter is always true; it keeps every total in the plan, so that both uses of
    # ``counted`` share one exchange
    whole = F.col("cnt") > 0
    for name in extra:
        whole = whole & F.col(name).isNotNull()
    hashed = counted.filter(whole).select(*keys, value, F.xxhash64(F.lit("order"), value).alias("_h"))
    picked = hashed.groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(samples)).alias("_c")).agg(
        F.min_by(value, "_h").alias("_v")
    )
    every_eighth = F.filter(F.sort_array(F.collect_list("_v")), lambda v, i: (i % 8 == 7))  # at most `samples` values
    splitters = picked.groupBy(*keys).agg(every_eighth.alias("_split"))

    if keys:
        cut = salted_join(counted, splitters, keys, F.col(value))
    else:
        cut = counted.withColumn("_split", splitters.select("_split").scalar())
    ranged = cut.withColumn("_range", F.size(F.filter("_split", lambda s: s <= F.col(value)))).drop("_split")

    # at most `ranges` + 1 rows per group reach these two windows
    weighed = [F.sum(F.col("cnt") * F.col(value)).alias("_w")] if mean else []
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("cnt").alias("_t"), *weighed)
    group = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_range",
        F.coalesce(
            F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_t").over(group).alias("n"),
        *([(F.sum("_w").over(group) / F.sum("_t").over(group)).alias(mean)] if mean else []),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_offset", "_inside")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    at = value_positions(df, keys, value)
    outputs, pieces = [], {}
    for name, q in wanted.items():
        spot = (F.col("n") - 1) * F.lit(q)
        low = F.floor(spot)

        def value_at(position: Column) -> Column:
            return F.max(
                F.when((F.col("before") <= position) & (position < F.col("before") + F.col("cnt")), F.col(value))
            )

        pieces |= {f"_lo_{name}": value_at(low), f"_hi_{name}": value_at(F.ceil(spot)), f"_w_{name}": F.max(spot - low)}
        outputs.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name)
        )
    return at.groupBy(*keys).agg(*[e.alias(n) for n, e in pieces.items()]).select(*keys, *outputs)


def row_index(df: DataFrame, order: list[str], name: str = "row_index", ranges: int | None = None) -> DataFrame:
    """1-based row number by an order key, nulls first, without a sort of the whole table in one place.

    Rows that tie on the key are numbered by a hash of the whole row, and may be many: the ranges
    that the rows are dealt to are cut in (key, hash). The cuts are a sample chosen by hash, the
    same on every evaluation; counts per range give each range its first number. Every row is
    shuffled once, to its range; nothing is grouped by the key or joined back. ``ranges``
    defaults to four per shuffle partition. Rows equal in every column share a range.
    """
    wanted = ranges or min(4096, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged, ranges, key, number = rows_in_ranges(df, order, wanted)
    counts = ranged.groupBy(F.col(number).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    # at most ``ranges`` rows: the first number of each range, in order
    totals = counts.agg(F.sort_array(F.collect_list(F.struct("r", "n"))).alias("t")).select(
        F.aggregate(
            F.sequence(F.lit(0), F.lit(ranges - 1)), F.array(F.lit(0).cast("bigint")),
            lambda sums, r: F.concat(
                sums, F.array(F.element_at(sums, -1) + F.coalesce(F.get(F.filter("t", lambda t: t["r"] == r), F.lit(0))["n"], F.lit(0)))
            ),
        )
    ).scalar()
    inside = F.row_number().over(Window.partitionBy(number).orderBy(key))
    spot = _unused(ranged, "_inside")
    numbered = ranged.withColumn(spot, inside)
    return numbered.withColumn(name, F.get(totals, F.col(number)) + F.col(spot)).drop(key, number, spot)


def _unused(df: DataFrame, name: str) -> str:
    """The name, with as many lines in front as keep it from those of the table."""
    while name in df.columns:
        name = "_" + name
    return name


def rows_in_ranges(df: DataFrame, order: list[str], wanted: int) -> tuple[DataFrame, int, str, str]:
    """Deal rows to ranges of an order key: the rows, the number of ranges (a power of two, at most
    ``wanted``), and the names of two new columns, the key (a hash of the row at its end) and the range.

    Cuts are quantiles of a sample of the keys, so ranges are about equal whatever the ties.
    """
    steps = max(1, wanted.bit_length() - 1)
    ranges = 1 << steps  # cuts are found by halving
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    key, number, at_hand = (_unused(df, n) for n in ("_order", "_range", "_cuts"))
    keyed = df.withColumn(key, F.struct(*order, F.xxhash64(*hashable).alias("_tie_of_rows")))
    dice = F.xxhash64(F.lit("order"), F.col(key)["_tie_of_rows"])
    # one row in 64 takes part, one of each hash class of those is kept: a bounded sample that needs no count
    picked = keyed.filter(F.pmod(dice, F.lit(64)) == 0).groupBy(F.pmod(F.shiftright(dice, 6), F.lit(8 * ranges)).alias("c")).agg(
        F.min_by(key, dice).alias("o")
    )
    nth = lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / ranges).cast("int"))
    cuts = picked.agg(F.sort_array(F.collect_list("o")).alias("s")).select(
        F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), nth)
    ).scalar()
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])

    def below(at: Column, step: Column) -> Column:
        return F.when(F.get(F.col(at_hand), at + step - 1) <= F.col(key), at + step).otherwise(at)

    ranged = keyed.withColumn(at_hand, cuts).withColumn(number, F.aggregate(halves, F.lit(0), below)).drop(at_hand)
    return ranged, ranges, key, number


def rank_rows(positions: DataFrame, keys: list[str], value: str, chunk: int = 65_536) -> DataFrame:
    """One row per rank ``i`` = 1..n of every group with the value at that rank.

    A value with very many copies becomes many chunks, which are spread over the tasks.
    """
    chunks = positions.select(
        *keys, value, "cnt", "before", "n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("cnt") - 1) / chunk))).alias("_chunk"),
    ).repartition(*[F.col(k) for k in keys], F.col(value), F.col("_chunk"))
    first = F.col("before") + 1 + F.col("_chunk") * chunk
    last = F.col("before") + F.least(F.col("cnt"), (F.col("_chunk") + 1) * chunk)
    return chunks.select(*keys, value, "n", F.explode(F.sequence(first, last)).alias("i"))
