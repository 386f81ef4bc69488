"""Structural metrics of activity-diagram code.

Everything here is one narrow projection per diagram: a line is classified once, the
counts come from the array of classes, and no row leaves its partition. Only the averages
and totals at the end of the module aggregate, and those combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions.numbers import np_round, py_round
from quillgauge.functions.text import WORD, WS, fence, let, strip, stripped_lines
from quillgauge.operators.positions import value_positions

# Weights of the raw score.
WEIGHTS = {
    "activities": 3.0,
    "decisions": 4.0,
    "forks": 3.0,
    "swimlanes": 2.0,
    "detaches": -1.5,
    "options": 1.0,
    "edges": 1.2,
    "notes": 0.8,
    "partitions": 1.5,
    "numberline": 0.05,
    "negative_score": 1.0,
}
COUNTS = [name for name in WEIGHTS if name != "negative_score"]
SCORES = [
    "raw_score", "percentage_score", "functional_complexity", "organization_score", "structural_integrity",
]

# Line classes used for the counts.
_SKIPPED, _PLAIN = -1, 0
_LINE = {
    name: number
    for number, name in enumerate(
        ["activity", "if", "switch", "fork", "swimlane", "detach", "note", "partition",
         "endif", "join", "endswitch", "start", "stop"], 1)
}
# Line classes used for the flow: the reader of a diagram sees them in this order.
FLOW_TYPES = ["activity", "decision", "start", "stop", "branch", "endif", "fork", "join"]
_FLOW = {name: number for number, name in enumerate(FLOW_TYPES, 1)}


def _line_class(line: Column) -> Column:
    """Class of a stripped line: dispatch on its first character, then on a short lower-cased head.

    Keyword lines are shorter than the head, so comparing the head compares the line.
    """
    content = strip(F.substr(line, F.lit(2), F.greatest(F.length(line) - 2, F.lit(0))))
    activity = (
        F.endswith(line, F.lit(";"))
        & ~F.rlike(line, F.lit("(?i)then|else|case|while|until|repeat"))
        & (content != "")
    )

    def keyword(head: Column) -> Column:
        return (
            F.when(F.startswith(head, F.lit("if")),
                   F.when(F.rlike(line, F.lit(f"(?i)^if[{WS}]+[^\\n]*[{WS}]+then([^{WORD}]|$)")), _LINE["if"])
                   .otherwise(_PLAIN))
            .when(F.startswith(head, F.lit("switch")),
                  F.when(F.rlike(line, F.lit(rf"(?i)^switch[{WS}]*\([^\n]*\)")), _LINE["switch"]).otherwise(_PLAIN))
            .when(head.isin("fork", "split"), _LINE["fork"])
            .when(head == "endif", _LINE["endif"])
            .when(head.isin("stop", "end"), _LINE["stop"])
            .when(head == "start", _LINE["start"])
            .when(head == "detach", _LINE["detach"])
            .when(head == "endswitch", _LINE["endswitch"])
            .when((head == "join") | _is_end_fork(line, head), _LINE["join"])
            .when(F.rlike(head, F.lit(f"^note[{WS}]")), _LINE["note"])
            .when(F.rlike(head, F.lit(f"^partition[{WS}]")), _LINE["partition"])
            .otherwise(_PLAIN)
        )

    return (
        F.when((line == "") | F.startswith(line, F.lit("'")) | F.startswith(line, F.lit("@")), _SKIPPED)
        .when(F.startswith(line, F.lit(":")), F.when(activity, _LINE["activity"]).otherwise(_PLAIN))
        .when(F.startswith(line, F.lit("|")),
              F.when(F.rlike(line, F.lit(r"^\|[^|]+\|$")), _LINE["swimlane"]).otherwise(_PLAIN))
        .otherwise(let(_head(line), keyword))
    )


def _head(line: Column) -> Column:
    return F.lower(F.substring(line, 1, 12))


def _is_end_fork(line: Column, head: Column) -> Column:
    return F.startswith(head, F.lit("end")) & F.rlike(line, F.lit(f"(?i)^end[{WS}]*fork$"))


def _flow_class(line: Column) -> Column:
    def keyword(head: Column) -> Column:
        return (
            F.when(F.startswith(head, F.lit("if")),
                   F.when(F.rlike(line, F.lit(rf"(?i)^if[{WS}]*\([^\n]*\)")), _FLOW["decision"]).otherwise(0))
            .when(head == "start", _FLOW["start"])
            .when(head.isin("stop", "end"), _FLOW["stop"])
            .when(F.startswith(head, F.lit("then")) | F.startswith(head, F.lit("else")), _FLOW["branch"])
            .when(head == "endif", _FLOW["endif"])
            .when(head == "fork", _FLOW["fork"])
            .when((head == "join") | _is_end_fork(line, head), _FLOW["join"])
            .otherwise(0)
        )

    return (
        F.when(line == "", 0)
        .when(F.startswith(line, F.lit(":")),
              F.when(F.rlike(line, F.lit("^:[^:]*;$")), _FLOW["activity"]).otherwise(0))
        .otherwise(let(_head(line), keyword))
    )


def _count(classes: Column, *numbers: int) -> Column:
    """How often the numbers occur: native array functions, no lambda."""
    found = [F.size(classes) - F.size(F.array_remove(classes, n)) for n in numbers]
    result = found[0]
    for more in found[1:]:
        result = result + more
    return result


def _orphans(code: Column, lines: Column, flow: Column) -> Column:
    """Activities without a connection, by position in the flow.

    "The closest element lies within ten lines" is "one lies within ten lines", so each
    activity looks at two slices of the class array.
    """
    first = F.array_position(flow, _FLOW["activity"])  # 1-based, 0 when absent
    last = F.size(flow) + 1 - F.array_position(F.reverse(flow), _FLOW["activity"])
    start = F.array_position(flow, _FLOW["start"])
    stop = F.array_position(flow, _FLOW["stop"])
    before = F.array(*[F.lit(_FLOW[n]) for n in ("activity", "decision", "branch", "endif", "start")])
    after = F.array(*[F.lit(_FLOW[n]) for n in ("activity", "decision", "stop", "endif")])

    def connected(p: Column) -> Column:
        line = F.element_at(lines, p)
        arrow = F.contains(code, F.lit("->")) & (
            F.contains(code, F.concat(F.lit("->"), line)) | F.contains(code, F.concat(line, F.lit("->")))
        )
        middle = F.arrays_overlap(F.slice(flow, F.greatest(p - 10, F.lit(1)), F.least(p - 1, F.lit(10))), before) & (
            F.arrays_overlap(F.slice(flow, p + 1, F.lit(10)), after)
        )
        return arrow | (
            F.when(p == first, (start > 0) & (start < p))
            .when(p == last, (stop > 0) & (stop > p))
            .otherwise(middle)
        )

    positions = F.sequence(F.lit(1), F.size(flow))
    return F.size(
        F.filter(
            positions,
            lambda p: (F.element_at(flow, p) == _FLOW["activity"]) & ~connected(p),
        )
    )


def with_line_counts(df: DataFrame, code: str = "code") -> DataFrame:
    """Add the ten element counts and the balance inputs; null code counts as empty."""
    filled = df.withColumn(code, F.coalesce(F.col(code), F.lit("")))
    lines = fence(filled, {"_lines": stripped_lines(F.col(code))})
    classed = fence(lines, {"_class": F.transform("_lines", _line_class)})
    c = F.col("_class")
    counted = {
        "activities": _count(c, _LINE["activity"]),
        "decisions": _count(c, _LINE["if"], _LINE["switch"]),
        "forks": _count(c, _LINE["fork"]),
        "swimlanes": _count(c, _LINE["swimlane"]),
        "detaches": _count(c, _LINE["detach"]),
        "options": F.size(
            F.filter(
                "_lines",
                lambda x: F.endswith(x, F.lit(";")) & F.contains(x, F.lit(":")) & F.contains(F.lower(x), F.lit("option")),
            )
        ),
        "edges": F.regexp_count(F.col(code), F.lit("->{1,2}|<-{1,2}")),
        "notes": _count(c, _LINE["note"]),
        "partitions": _count(c, _LINE["partition"]),
        "numberline": F.size(c) - _count(c, _SKIPPED),
        "_endifs": _count(c, _LINE["endif"]),
        "_joins": _count(c, _LINE["join"]),
        "_switches": _count(c, _LINE["switch"]),
        "_endswitches": _count(c, _LINE["endswitch"]),
        "_starts": _count(c, _LINE["start"]),
        "_stops": _count(c, _LINE["stop"]),
    }
    return fence(classed, {name: value.cast("long") for name, value in counted.items()}).drop("_class")


def with_penalties(counted: DataFrame, code: str = "code") -> DataFrame:
    """Add ``negative_score`` and the ``penalties`` records to counted rows."""
    functional = F.col("activities") + F.col("decisions") + F.col("forks")
    flow = fence(counted, {"_flow": F.transform("_lines", _flow_class)})
    step = fence(
        flow,
        {
            "_if_gap": F.abs(F.col("decisions") - F.col("_endifs")),
            "_fork_gap": F.abs(F.col("forks") - F.col("_joins")),
            "_switch_gap": F.abs(F.col("_switches") - F.col("_endswitches")),
            "_orphans": F.when(
                F.col("activities") > 1, _orphans(F.col(code), F.col("_lines"), F.col("_flow"))
            ).otherwise(0).cast("long"),
            "_ratio": F.when(F.col("activities") > 0, F.col("numberline") / F.col("activities")),
            "_threshold": F.when(functional <= 5, 4.5).when(functional <= 15, 3.5).otherwise(3.0),
        },
    ).drop("_lines", "_flow")
    step = step.withColumn(
        "_excess", F.when(F.col("_ratio") > F.col("_threshold"), F.col("_ratio") - F.col("_threshold"))
    ).withColumn("_pss", F.col("_excess") * F.lit(-0.3))

    def record(present: Column, element: str, count: Column, score: Column, explanation: Column) -> Column:
        return F.when(
            present,
            F.struct(
                F.lit(element).alias("element"),
                count.cast("double").alias("count"),
                score.cast("double").alias("score"),
                explanation.alias("explanation"),
            ),
        )

    c = F.col
    # Element names and explanation texts of the records.
    records = F.array(
        record(
            c("_if_gap") > 0, "orphaned_activities", c("_if_gap"), F.lit(0),
            F.format_string(
                "Info: Potential if-endif imbalance of %d treated as orphaned activities (no penalty)", c("_if_gap")
            ),
        ),
        record(
            c("_fork_gap") > 0, "fork-join_imbalance", c("_fork_gap"), c("_fork_gap") * -3,
            F.format_string("Unbalanced fork-join statements: %d fork vs %d join", c("forks"), c("_joins")),
        ),
        record(
            c("_switch_gap") > 0, "switch-endswitch_imbalance", c("_switch_gap"), c("_switch_gap") * -3,
            F.format_string(
                "Unbalanced switch-endswitch statements: %d switch vs %d endswitch", c("_switches"), c("_endswitches")
            ),
        ),
        record(
            c("_starts") == 0, "missing_start", F.lit(1), F.lit(-10),
            F.lit("CRITICAL: Missing start statement - essential for proper activity diagram flow"),
        ),
        record(
            c("_stops") == 0, "missing_stop", F.lit(1), F.lit(-10),
            F.lit("CRITICAL: Missing stop/end statement - essential for proper activity diagram flow"),
        ),
        record(
            c("_pss").isNotNull(), "pss", py_round(c("_excess"), 1), py_round(c("_pss"), 1),
            F.format_string(
                "Minor: Excessive lines ratio: %.1f lines per activity (smart threshold: %.1f)",
                py_round(c("_ratio"), 1), c("_threshold"),
            ),
        ),
        record(
            c("_orphans") > 0, "orphaned_activities", c("_orphans"), F.lit(0),
            F.format_string(
                "Info: Activities detected as potentially disconnected: %d (no penalty applied)", c("_orphans")
            ),
        ),
    )
    balance = (
        c("_fork_gap") * -3
        + c("_switch_gap") * -3
        - F.when(c("_starts") == 0, 10).otherwise(0)
        - F.when(c("_stops") == 0, 10).otherwise(0)
    )
    return step.withColumn("penalties", F.filter(records, lambda r: r.isNotNull())).withColumn(
        "negative_score", balance.cast("double") + F.coalesce(c("_pss"), F.lit(0.0))
    )


def _two_decimals(x: Column) -> Column:
    """Python's text of a float rounded to two decimals: 48.05, 45.1, 45.0."""
    return F.regexp_replace(F.format_string("%.2f", x), "0$", "")


def with_scores(df: DataFrame) -> DataFrame:
    """Raw, percentage, formatted and quality scores of rows with counts and penalties."""
    c = F.col
    raw = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        raw = raw + c(name) * F.lit(weight)
    positive = F.lit(0.0)
    for name in ("activities", "decisions", "forks", "swimlanes", "edges", "notes", "partitions", "options", "numberline"):
        positive = positive + c(name) * F.lit(WEIGHTS[name])
    step = df.withColumns({"_raw": raw, "_ceiling": F.greatest(positive + 20.0, F.lit(10.0))}).withColumn(
        "_percent", F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("_raw") / c("_ceiling") * 100.0))
    )
    step = step.withColumns(
        {
            "raw_score": py_round(c("_raw"), 2),
            "percentage_score": py_round(c("_percent"), 1),
            "functional_complexity": c("activities") * 1.5 + c("decisions") * 2.0 + c("forks") * 1.5,
            "organization_score": c("swimlanes") * 2.0,
            "_integrity": F.greatest(F.lit(0.0), c("negative_score") + 10.0),
            "_ratio_da": c("decisions") / F.greatest(c("activities"), F.lit(1)),
        }
    )
    # a clamped percentage is the integer 0 and prints without a decimal
    percent = F.when(c("_percent") > 0, F.format_string("%.1f", c("percentage_score"))).otherwise("0")
    return step.withColumns(
        {
            "formatted_score": F.concat(percent, F.lit("% ("), _two_decimals(c("raw_score")), F.lit(")")),
            "structural_integrity": py_round(c("_integrity"), 2),
            "decisions_activities_ratio": py_round(c("_ratio_da"), 3),
        }
    )


METRIC_COLUMNS = [
    *COUNTS, "negative_score", "raw_score", "percentage_score", "formatted_score",
    "functional_complexity", "organization_score", "structural_integrity", "decisions_activities_ratio",
]


def code_metrics(df: DataFrame, code: str = "code") -> DataFrame:
    """The full metric row of every cell, with its ``penalties``; helper columns removed."""
    scored = with_scores(with_penalties(with_line_counts(df, code), code))
    return scored.select(*df.columns, *METRIC_COLUMNS, "penalties")


def with_lines_vs_average(metrics: DataFrame, null_cells: Column | None = None) -> DataFrame:
    """Lines of a cell over the average of all cells: the average is a scalar subquery.

    ``null_cells`` marks the cells whose code was null; they take no part in the average.
    """
    cells = metrics if null_cells is None else metrics.filter(~null_cells)
    average = cells.agg(F.avg("numberline").alias("a")).scalar()
    return metrics.withColumn("_avg", average).withColumn("_lva", F.when(F.col("_avg") > 0, F.col("numberline") / F.col("_avg"))).withColumn(
        "lines_vs_average", F.coalesce(py_round(F.col("_lva"), 3), F.lit(0.0))
    ).drop("_avg", "_lva")


def flow_elements(df: DataFrame, code: str = "code") -> DataFrame:
    """One row per recognised flow element: position, type and the stripped line."""
    lines = df.select(
        *df.columns, F.posexplode(stripped_lines(F.coalesce(F.col(code), F.lit("")))).alias("position", "line")
    )
    names = F.array(*[F.lit(n) for n in FLOW_TYPES])
    return (
        lines.withColumn("_t", _flow_class(F.col("line")))
        .filter(F.col("_t") > 0)
        .withColumn("type", F.element_at(names, F.col("_t")))
        .withColumn("line_number", F.col("position") + 1)
        .drop("_t")
    )


def penalty_details(metrics: DataFrame, code: str = "code") -> DataFrame:
    """One row per penalty record with its cell and the cell's code."""
    keep = [c for c in metrics.columns if c not in (*METRIC_COLUMNS, "penalties", "lines_vs_average", code)]
    # the outer form keeps the optimizer from copying the whole penalty expression into a filter
    records = metrics.select(*keep, F.explode_outer("penalties").alias("_p"), F.col(code).alias("original_code"))
    return records.filter(F.col("_p").isNotNull()).select(
        *keep, "_p.element", "_p.count", "_p.score", "_p.explanation", "original_code"
    )


def average_metrics(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation and median of the eleven metrics: 33 (metric, value) rows.

    One pass counts the equal values of each metric (a value that fills a third of all cells
    is one row); all three numbers come from those counts, and the median is exact. A metric
    without any cell has zeros.
    """
    names = [*COUNTS, "negative_score"]
    long = metrics.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])
        ).alias("_m")
    ).select("_m.name", "_m.v")
    c = F.col

    def value_at(position: Column) -> Column:
        return F.max(F.when((c("before") <= position) & (position < c("before") + c("cnt")), c("v")))

    sums = value_positions(long, ["name"], "v").groupBy("name").agg(
        F.max("n").alias("n"), F.sum(c("v") * c("cnt")).alias("_s"), F.sum(c("v") * c("v") * c("cnt")).alias("_q"),
        value_at(F.floor((c("n") - 1) / 2)).alias("_lo"), value_at(F.ceil((c("n") - 1) / 2)).alias("_hi"),
    )
    mean = c("_s") / c("n")
    found = sums.select(
        "name", mean.alias("avg"), F.sqrt(F.greatest(c("_q") / c("n") - mean * mean, F.lit(0.0))).alias("std"),
        ((c("_lo") + c("_hi")) / 2.0).alias("median"),
    )
    all_names = metrics.sparkSession.createDataFrame([(n,) for n in names], "name string")
    found = all_names.join(found, "name", "left").fillna(0.0, ["avg", "std", "median"])
    return found.unpivot(["name"], ["avg", "std", "median"], "stat", "value").select(
        F.concat_ws("_", "stat", "name").alias("metric"), np_round(c("value"), 4).alias("value")
    )


def variant_totals(metrics: DataFrame, code: str = "code", by: str = "variant") -> DataFrame:
    """Totals and averages per variant over non-blank cells, and the grand TOTAL row.

    One rollup; the five score totals appear only on the TOTAL row.
    """
    valid = strip(F.coalesce(F.col(code), F.lit(""))) != ""
    summed = [*COUNTS, "negative_score", *SCORES]

    def total(name: str) -> Column:
        if name in COUNTS:
            return F.coalesce(F.sum(F.when(valid, F.col(name))), F.lit(0))
        # decimal sums do not depend on the order of the tasks, so neither do rounded averages
        exact = F.sum(F.when(valid, F.col(name).cast("decimal(28,10)")))
        return F.coalesce(exact.cast("double"), F.lit(0.0))

    grouped = metrics.rollup(by).agg(
        *[total(n).alias(f"total_{n}") for n in summed],
        F.count(F.when(valid, 1)).alias("valid_entries"),
        F.grouping(by).alias("_all"),
    )
    c = F.col
    entries = F.greatest(c("valid_entries"), F.lit(1))
    averaged = {"raw_score": 2, "percentage_score": 1, "negative_score": 2, "functional_complexity": 2,
                "organization_score": 2, "structural_integrity": 2}
    ready = grouped.withColumns(
        {f"_avg_{n}": c(f"total_{n}") / entries for n in averaged}
        | {"_dar": c("total_decisions") / F.greatest(c("total_activities"), F.lit(1))}
    )
    only_total = c("_all") == 1
    return ready.select(
        F.when(only_total, "TOTAL").otherwise(c(by)).alias("column_name"),
        *[c(f"total_{n}") for n in COUNTS],
        py_round(c("total_negative_score"), 6).alias("total_negative_score"),
        py_round(c("_dar"), 3).alias("decisions_activities_ratio"),
        *[py_round(c(f"_avg_{n}"), digits).alias(f"avg_{n}") for n, digits in averaged.items()],
        c("valid_entries"),
        *[F.when(only_total, py_round(c(f"total_{n}"), 6)).alias(f"total_{n}") for n in SCORES],
    )


def valid_entries(df: DataFrame, code: str = "code", by: str = "variant") -> DataFrame:
    """Cells and non-blank cells per variant."""
    valid = strip(F.coalesce(F.col(code), F.lit(""))) != ""
    return df.groupBy(by).agg(F.count(F.when(valid, 1)).alias("valid_entries"), F.count(F.lit(1)).alias("cells"))
