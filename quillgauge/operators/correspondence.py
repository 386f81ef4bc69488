"""How well a variant's code corresponds to the prompt of its story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions.counts import grams, matched, term_counts, total
from quillgauge.functions.numbers import py_round
from quillgauge.functions.sequences import token_lcs
from quillgauge.functions.text import fence, space_tokens
from quillgauge.operators.pairs import vector_cosine
from quillgauge.operators.skew import even_join

MINIMUM_CODE = 20  # code shorter than this scores zero throughout
SMOOTHING_K = 5.0  # BLEU smoothing method 4


def join_prompts(
    variants: DataFrame, stories: DataFrame, limit: int = 1_000_000, source: DataFrame | None = None
) -> DataFrame:
    """Variants with the columns of their story; a story with very many variants is salted."""
    return even_join(variants, stories, ["story_id"], F.col("variant"), limit, source=source)


def basic_quality(code: Column) -> Column:
    """50, plus or minus 10 for the tags, plus 10 for start and stop, plus 10 for three activities."""

    def has(word: str) -> Column:
        return F.contains(code, F.lit(word))

    return (
        F.lit(50.0)
        + F.when(has("@startuml") & has("@enduml"), 10.0).otherwise(-10.0)
        + F.when(has("start") & has("stop"), 10.0).otherwise(0.0)
        + F.when(F.regexp_count(code, F.lit(":[^\\n]+?;")) >= 3, 10.0).otherwise(0.0)
    )


def _gram_columns(tokens: str, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}": term_counts(grams(F.col(tokens), n)) for n in range(1, 5)}


def bleu(matches: list[Column], hypothesis: Column, reference: Column) -> Column:
    """BLEU-4 from clipped match counts, smoothing a zero count by method 4.

    ``hypothesis`` and ``reference`` are token counts. Zero without a unigram match.
    """
    log_sum, step = F.lit(0.0), F.lit(0)
    length = F.ln(F.when(hypothesis > 1, hypothesis))
    for n, found in enumerate(matches, 1):
        size = F.greatest(hypothesis - (n - 1), F.lit(1)).cast("double")
        step = step + F.when(found == 0, 1).otherwise(0)
        smoothed = 1.0 / (F.pow(F.lit(2.0), step) * SMOOTHING_K / length)
        precision = F.when(found > 0, found / size).otherwise(smoothed / size)
        log_sum = log_sum + F.coalesce(F.ln(precision), F.lit(0.0)) * 0.25
    brevity = F.when(hypothesis > reference, 1.0).otherwise(
        F.exp(1.0 - reference / F.when(hypothesis > 0, hypothesis).cast("double"))
    )
    return F.when(matches[0] == 0, 0.0).otherwise(brevity * F.exp(log_sum))


def correspondence(
    variants: DataFrame,
    stories: DataFrame,
    metrics: tuple[str, ...] = ("quality", "bleu", "rouge_l"),
    code_vector: str | None = None,
    prompt_vector: str | None = None,
) -> DataFrame:
    """Similarity, quality, match rate, BLEU and ROUGE-L per (story, variant).

    Null text reads as ``nan``. The join moves the bare texts, which are a fraction of their tokens
    and gram counts; both are prepared and compared inside the joined row. Without vector columns the
    similarity, and with it the match rate, is not known and null.
    ROUGE-L is the F1 of the token LCS.
    """
    def texts(df: DataFrame, text: str, name: str, keep: list[str]) -> DataFrame:
        return df.select(*keep, F.coalesce(F.col(text), F.lit("nan")).alias(name))

    left = texts(variants, "code", "_c", ["story_id", "variant", *([code_vector] if code_vector else [])])
    right = texts(stories, "prompt", "_p", ["story_id", *([prompt_vector] if prompt_vector else [])])
    rows = join_prompts(left, right, source=variants)
    if "bleu" in metrics or "rouge_l" in metrics:
        rows = fence(rows, {"_ct": space_tokens(F.col("_c")), "_pt": space_tokens(F.col("_p"))})
    if "bleu" in metrics:
        rows = fence(rows, _gram_columns("_ct", "_c") | _gram_columns("_pt", "_p"))
    code = F.col("_c")
    long_enough = F.length(code) >= MINIMUM_CODE

    def guarded(value: Column) -> Column:
        return F.when(long_enough, value).otherwise(0.0)

    n_code, n_prompt = F.size("_ct"), F.size("_pt")
    values = {}
    if code_vector and prompt_vector:
        values["_similarity"] = guarded(vector_cosine(F.col(prompt_vector), F.col(code_vector)))
    else:
        values["_similarity"] = F.lit(None).cast("double")
    values["_quality"] = guarded(basic_quality(code))
    if "bleu" in metrics:
        clipped = [
            total(F.transform(matched(F.col(f"_c{n}"), F.col(f"_p{n}")), lambda v: F.least(v["l"], v["r"])))
            for n in range(1, 5)
        ]
        rows = fence(rows, {f"_m{n}": c for n, c in enumerate(clipped, 1)})
        values["_bleu"] = guarded(bleu([F.col(f"_m{n}") for n in range(1, 5)], n_code, n_prompt))
    if "rouge_l" in metrics:
        both = (n_code + n_prompt).cast("double")
        shared = token_lcs(F.when(long_enough, F.col("_ct")), F.when(long_enough, F.col("_pt")))
        values["_rouge_l"] = guarded(F.when(both > 0, 2.0 * shared / F.when(both > 0, both)).otherwise(0.0))
    scored = rows.select("story_id", "variant", *[v.alias(n) for n, v in values.items()]).withColumn(
        "_match", F.col("_similarity") * F.col("_quality")
    )
    rounded = {"similarity": "_similarity", "quality": "_quality", "match_rate": "_match",
               "bleu": "_bleu", "rouge_l": "_rouge_l"}
    return scored.select(
        "story_id", "variant",
        *[py_round(F.col(c), 2 if n == "quality" else 4).alias(n) for n, c in rounded.items() if c in scored.columns],
    )
