"""Quality rules whose limits come from the corpus: quantile sketches for each language and source.

Every measure of a text is an integer. Its sketch is a histogram of buckets whose width grows with
the value (at most 1/32 of it), so sketches of any parts merge by adding counts and the result does
not depend on how the rows were dealt. A stratum (language and source) with few documents takes
the merged sketch of its language, a language with few documents that of the corpus. A limit is a rate
out of the sketch; how far one text may stray from it follows from the text's length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillgauge.llm.arrays import SMALL_SLICE, Texts, distinct_per_text, forget_lasting, mix, release_memory, running, slices
from quillgauge.llm.names import fresh, quoted
from quillgauge.session import materialize

REPEAT_WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words", "n_capitals"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Each measure is a count over a size, per so many of it; and whether low values are judged too.
MEASURES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, False), "word_length": ("word_chars", "n_words", 100, True),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, False), "echo_rate": ("n_echo_words", "n_words", 1000, False),
    "capital_rate": ("n_capitals", "word_chars", 1000, False),
}
#: Quartile ranges between a quartile and its fence; standard deviations of a count that are chance.
FENCE, CHANCE = 3, 4


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of each text; ``n_lines`` are lines with a word, ``n_echo_words`` equal the word before."""
    data, n = texts.data, len(texts)
    solid, offsets = texts.solid, texts.word_offsets
    out = {
        "n_words": np.diff(offsets),
        "word_chars": texts.per_text(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(_SYMBOLS[data]),
        "n_capitals": texts.per_text((data >= ord("A")) & (data <= ord("Z"))),
    }
    # lines: each text's first, and what follows a line feed
    feeds = np.flatnonzero(data == 10)
    feeds_per_text = np.diff(np.searchsorted(feeds, texts.offsets))
    starts = np.sort(np.concatenate([texts.offsets[:-1], feeds + 1]), kind="stable")
    owner = np.repeat(np.arange(n), feeds_per_text + 1)
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends = np.where(last, texts.offsets[1:][owner], np.append(starts[1:], 0) - 1)
    filled = running(solid)
    with_word = filled[ends] > filled[starts]
    keys, owners = distinct_per_text(texts.span_hashes(starts, ends)[with_word], owner[with_word])
    out["n_lines"] = np.bincount(owner[with_word], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owners, minlength=n)
    # windows found twice or more within a text
    firsts, hashes = texts.windows(REPEAT_WINDOW)
    words_owner = texts.text_of_words()
    keys = mix(hashes ^ mix(words_owner[firsts].astype(np.uint64) + np.uint64(1)))
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = firsts[times[inverse] > 1] if len(keys) else firsts
    edges = np.zeros(len(words_owner) + 1, np.int64)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, repeated + REPEAT_WINDOW, -1)
    covered = running(np.cumsum(edges[:-1]) > 0)
    out["n_repeat_words"] = covered[offsets[1:]] - covered[offsets[:-1]]
    h = texts.word_hashes
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (words_owner[1:] == words_owner[:-1])
    echo = running(echo)
    out["n_echo_words"] = echo[offsets[1:]] - echo[offsets[:-1]]
    return out


def with_counts(docs: DataFrame, into: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the counts of every whole text as struct column ``into`` (a column of that name is replaced).

    A null text counts as empty. ``keep`` names the columns that stay; all by default.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    sent = [F.col(f"`{c}`") for c in keep]
    # a text that stays is sent to Python once
    at = keep.index(text_col) if text_col in keep and isinstance(docs.schema[text_col].dataType, StringType) else len(keep)
    if at == len(keep):
        sent.append(F.col(text_col).cast("string").alias(fresh("_text_", keep)))
    struct = pa.struct([(c, pa.int64()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_lasting()
        for batch in batches:
            for texts in slices(batch.column(at), limit=SMALL_SLICE):
                counts = text_counts(texts)
                columns = [batch.column(i).slice(texts.first, len(texts)) for i in range(len(keep))]
                counted = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], fields=list(struct))
                yield pa.RecordBatch.from_arrays([*columns, counted], names=[*keep, into])
            release_memory()

    schema = StructType([docs.schema[c] for c in keep]).add(into, StructType.fromDDL(", ".join(f"{c} long" for c in COUNTS)))
    return docs.select(*sent).mapInArrow(count, schema)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def measures(q: Column) -> dict[str, Column]:
    """Integer measures: per mille, and hundredths of a character for the word length."""
    return {m: F.floor(unit * q[count] / F.greatest(q[size], F.lit(1))) for m, (count, size, unit, _) in MEASURES.items()}


def bucket(value: Column) -> Column:
    """Lower end of a value's bucket: its six leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def limits(counted: DataFrame, into: str, lang_col: str, source_col: str, enough: int = 100) -> DataFrame:
    """The limits of each (language, source): columns ``<measure>_high`` and ``word_length_low``.

    Only texts that pass the base rules are sketched. The high limit is the fence Q3 + 3 (Q3 - Q1),
    or the mean where that is higher: where three quarters of the texts have none of something,
    both quartiles are 0. A minority at one high rate stays above the mean that it raises. The low
    limit is Q1 - 3 (Q3 - Q1). A stratum of ``enough`` texts has its own limits, whatever its
    language has.
    """
    q = F.col(into)
    values = F.array(*(F.struct(F.lit(m).alias("m"), v.alias("v")) for m, v in measures(q).items()))
    sketch = (
        counted.filter(~base_failed(q)).select(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.explode(values).alias("x"))
        .groupBy("_lang", "_source", F.col("x.m").alias("m"), bucket(F.col("x.v")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    )

    def quartiles(part: DataFrame, keys: list[str], name: str) -> DataFrame:
        merged = part.groupBy(*keys, "m", "b").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*keys, "m")
        upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        merged = merged.withColumn("all", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(upto))
        found = merged.groupBy(*keys, "m").agg(
            F.max("all").alias("all"),
            F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("b"))).alias("q1"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("b"))).alias("q3"),
            (F.sum(F.col("b") * F.col("n")) / F.max("all")).alias("mean"),
        )
        spread = FENCE * (F.col("q3") - F.col("q1"))
        cells = []
        for m, (*_, low) in MEASURES.items():
            cells.append(F.max(F.when(F.col("m") == m, F.greatest(F.col("q3") + spread, F.col("mean")))).alias(f"{name}_{m}_high"))
            if low:
                cells.append(F.max(F.when(F.col("m") == m, F.greatest(F.col("q1") - spread, F.lit(0)))).alias(f"{name}_{m}_low"))
        return found.groupBy(*keys).agg(F.max("all").alias(f"{name}_n"), *cells)

    sketch = materialize(sketch)
    own = quartiles(sketch, ["_lang", "_source"], "own")
    lang = quartiles(sketch, ["_lang"], "lang").withColumnRenamed("_lang", "_lang2")
    whole = quartiles(sketch.withColumn("_one", F.lit(1)), ["_one"], "whole")
    table = own.join(lang, F.col("_lang").eqNullSafe(F.col("_lang2"))).withColumn("_one", F.lit(1)).join(whole, "_one")
    few, few_lang = F.col("own_n") < enough, F.col("lang_n") < enough
    columns = []
    for limit in [f"{m}_high" for m in MEASURES] + [f"{m}_low" for m, (*_, low) in MEASURES.items() if low]:
        above = F.when(few_lang, F.col(f"whole_{limit}")).otherwise(F.col(f"lang_{limit}"))
        columns.append(F.when(few, above).otherwise(F.col(f"own_{limit}")).alias(limit))
    return table.select("_lang", "_source", *columns)


def judge(counted: DataFrame, limits_: DataFrame, into: str, lang_col: str, source_col: str, verdict: str) -> DataFrame:
    """Add the verdict: base rules hold and every count is within its stratum's limits.

    At a limit's rate a text of its size would have some expected count e; the text fails where its
    count is off by more than 4 sqrt(e + 1), so that a short text does not fail by chance. The limits are one row for each language and source. They are joined, not broadcast by hint,
    unless they were counted and are few.
    """
    few = limits_.limit(50_001).count() <= 50_000
    at = fresh("_limits_", [*counted.columns, verdict])
    limits_ = limits_.select(F.struct("*").alias(at))  # one column: no name of a limit meets a column of the documents
    joined = counted.join(
        F.broadcast(limits_) if few else limits_,
        F.col(lang_col).eqNullSafe(F.col(f"{at}._lang")) & F.col(source_col).eqNullSafe(F.col(f"{at}._source")), "left",
    )
    q = F.col(into)
    good = ~base_failed(q)
    for m, (count, size, unit, low) in MEASURES.items():
        most, least = (F.col(f"{at}.{m}_{end}") * q[size] / unit for end in ("high", "low"))
        good = good & (q[count] <= most + CHANCE * F.sqrt(most + 1))
        if low:
            good = good & (q[count] >= least - CHANCE * F.sqrt(least + 1))
    stay = [c for c in counted.columns if c.lower() != verdict.lower()]
    return joined.select(*quoted(stay), F.coalesce(good, F.lit(False)).alias(verdict))


def judge_documents(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every document with its counts (``counts``), ``base_failed`` and ``kept``.

    Null texts are empty and so fail; null languages and sources are strata of their own; repeated
    rows are judged alike; an empty table gives no rows.
    """
    names = list(dict.fromkeys([*(keep or []), lang_col, source_col]))
    counted = materialize(with_counts(docs, "counts", text_col, names))
    found = judge(counted, materialize(limits(counted, "counts", lang_col, source_col)), "counts", lang_col, source_col, "kept")
    return found.withColumn("base_failed", base_failed(F.col("counts")))


def keep_good(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they were."""
    into, verdict = fresh("_quality_counts_", docs.columns), fresh("_quality_kept_", docs.columns)
    counted = with_counts(docs, into, text_col, [lang_col, source_col])
    found = materialize(limits(counted, into, lang_col, source_col))
    judged = judge(with_counts(docs, into, text_col), found, into, lang_col, source_col, verdict)
    return judged.filter(verdict).select(*quoted(docs.columns))
