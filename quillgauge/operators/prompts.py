"""Prompt analytics: entities, verbs, flow, relationships, complexity and the standard prompt.

All of it is one narrow projection per prompt built from native string and array
functions; nothing shuffles except the join to a label table.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions.numbers import py_round
from quillgauge.functions.text import WORD, WS, any_of, capitalize, fence, let, string_array, strip, words

# Word lists of the analysis.
NOUN_FRAGMENTS = [
    "system", "manager", "service", "controller", "handler", "processor", "interface", "class", "object", "entity",
    "model", "data", "base", "tion", "sion", "ness", "ment", "ship", "hood", "dom", "ism",
]
VERBS = [
    "create", "make", "build", "design", "implement", "manage", "handle", "process", "execute", "run", "start", "stop",
    "update", "delete", "insert", "select", "modify", "send", "receive", "store", "retrieve", "validate",
    "authenticate", "authorize", "connect", "disconnect", "login", "logout", "register", "submit", "approve", "reject",
    "notify",
]
FLOWS = {
    "decision": ["if", "when", "condition", "check"],
    "parallel": ["parallel", "simultaneously", "at the same time"],
    "loop": ["loop", "repeat", "iterate", "while"],
}
RELATIONS = {"sequence": ["then"], "precedes": ["before"], "follows": ["after"], "triggers": ["triggers"],
             "leads_to": ["leads", "to"]}
DEFAULT_ENTITIES = ["User", "System"]
DEFAULT_VERBS = ["start", "process", "end"]
PROMPT_COLUMNS = ["prompt", "text", "description", "input", "query"]
INVALID = ["nan", "null", ""]
BASIC_ENTITIES = [
    "user", "system", "admin", "database", "server", "client", "visitor",
    "form", "page", "button", "field", "message", "notification",
]
BASIC_VERBS = ["start", "login", "submit", "validate", "process", "approve", "notify", "end"]
MODEL_METHOD = "Hugging Face Transformers"
BASIC_METHOD = "Basic Pattern Matching (No NLP models)"

_RELATION = "struct<rel:string,subj:string,obj:string>"


def is_invalid(prompt: Column) -> Column:
    """Blank prompts and the texts ``nan`` and ``null``."""
    return F.lower(F.coalesce(strip(prompt), F.lit(""))).isin(*INVALID)


def raw_prompt(df: DataFrame) -> Column:
    """First non-null candidate column, else the first column; stripped text.

    A null in the fallback column reads as the text ``nan``.
    """
    named = [F.col(c).cast("string") for c in PROMPT_COLUMNS if c in df.columns]
    return strip(F.coalesce(*named, F.col(df.columns[0]).cast("string"), F.lit("nan")))


def _or_default(found: Column, default: list[str]) -> Column:
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(string_array(default)))


def named_words(text: Column, tokens: Column) -> Column:
    """Capitalised ASCII words of three letters and more, then distinct words with a noun fragment."""
    # the look-behind runs only where a capital stands: "no word character before it"
    capitals = F.regexp_extract_all(
        text, F.lit(f"([A-Z](?<![{WORD}].)[a-zA-Z]{{2,}})(?![{WORD}])"), F.lit(1)
    )
    nouns = F.transform(
        F.filter(F.array_distinct(tokens), lambda w: F.rlike(w, F.lit(any_of(NOUN_FRAGMENTS)))), capitalize
    )
    return F.concat(capitals, nouns)


def entities(text: Column, tokens: Column) -> Column:
    """Distinct entities in alphabetical order, or the default pair."""
    return _or_default(F.array_sort(F.array_distinct(named_words(text, tokens))), DEFAULT_ENTITIES)


def verbs(tokens: Column) -> Column:
    """Known verbs in text order, repeats kept, or the default three."""
    return _or_default(F.filter(tokens, lambda w: w.isin(*VERBS)), DEFAULT_VERBS)


def _contains_any(text: Column, parts: list[str]) -> Column:
    """Plain substring searches: much cheaper on long texts than a regex alternation."""
    return reduce(operator.or_, [F.contains(text, F.lit(part)) for part in parts])


def flows(text: Column) -> Column:
    """Flow kinds whose fragments occur anywhere in the text, as substrings."""
    return let(
        F.lower(text),
        lambda low: F.filter(
            F.array(*[F.when(_contains_any(low, parts), F.lit(kind)) for kind, parts in FLOWS.items()]),
            lambda kind: kind.isNotNull(),
        ),
    )


def relationships(text: Column) -> Column:
    """The first three (relation, subject, object) records of the five patterns, in order."""

    def of_kind(low: Column, rel: str, parts: list[str]) -> Column:
        # a match always starts at a word start; possessive runs keep the scan linear
        link = f"[{WS}]++".join(parts)
        pattern = F.lit(f"((?<![{WORD}])[{WORD}]++[{WS}]++{link}[{WS}]++[{WORD}]++)")
        found = F.transform(
            F.regexp_extract_all(low, pattern, F.lit(1)),
            lambda m: let(
                F.split(m, f"[{WS}]+", -1),
                lambda w: F.struct(
                    F.lit(rel).alias("rel"),
                    F.element_at(w, 1).alias("subj"),
                    F.element_at(w, -1).alias("obj"),
                ),
            ),
        )
        named = F.transform(
            F.filter(found, lambda r: (F.length(r["subj"]) > 2) & (F.length(r["obj"]) > 2)),
            lambda r: F.struct(
                r["rel"].alias("rel"), capitalize(r["subj"]).alias("subj"), capitalize(r["obj"]).alias("obj")
            ),
        )
        # the pattern runs only over texts where the key word stands between blanks
        return F.when(F.contains(low, F.lit(parts[0])) & F.rlike(low, F.lit(f"[{WS}]{link}[{WS}]")), named).otherwise(
            F.array().cast(f"array<{_RELATION}>")
        )

    return let(
        F.lower(text),
        lambda low: F.slice(F.concat(*[of_kind(low, rel, parts) for rel, parts in RELATIONS.items()]), F.lit(1), F.lit(3)),
    )


def _complexity(df: DataFrame) -> DataFrame:
    score = F.size(F.array_distinct("entities")) + F.size(F.array_distinct("verbs")) + F.size("flows")
    step = fence(df, {"complexity_score": score.cast("long")}).withColumn(
        "_rate", F.when(F.col("character_count") > 0, F.col("complexity_score") / F.ln(F.col("character_count") + 1))
    )
    return step.withColumn("complexity_rate", F.least(py_round(F.col("_rate"), 2), F.lit(10.0))).drop("_rate")


def analyze(df: DataFrame, text: str = "prompt", method: str = MODEL_METHOD) -> DataFrame:
    """Entities, verbs, flows, relationships, length and complexity of every prompt."""
    t = F.col(text)
    tokens = fence(df, {"_words": words(t)})
    features = fence(
        tokens,
        {
            "entities": entities(t, F.col("_words")),
            "verbs": verbs(F.col("_words")),
            "flows": flows(t),
            "relationships": relationships(t),
            "character_count": F.length(t).cast("long"),
        },
    ).drop("_words")
    return _complexity(features).withColumn("analysis_method", F.lit(method))


def analyze_basic(df: DataFrame, text: str = "prompt") -> DataFrame:
    """The fallback analysis by short word lists; it knows no flow kinds."""
    t = F.col(text)
    plain = F.regexp_extract_all(t, F.lit(f"(?<![{WORD}])([A-Za-z]+)(?![{WORD}])"), F.lit(1))
    found = F.filter(plain, lambda w: F.lower(w).isin(*BASIC_ENTITIES) | (F.length(w) > 8))
    verbs_found = let(
        F.lower(t),
        lambda low: F.filter(
            F.array(*[F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in BASIC_VERBS]), lambda v: v.isNotNull()
        ),
    )
    step = fence(df, {"_found": F.transform(found, capitalize)})
    single = F.array(
        F.struct(F.lit("sequence").alias("rel"), F.lit("Start").alias("subj"), F.lit("End").alias("obj"))
    )
    features = fence(
        step,
        {
            "entities": _or_default(F.array_sort(F.array_distinct(F.col("_found"))), DEFAULT_ENTITIES),
            "verbs": _or_default(verbs_found, DEFAULT_VERBS),
            "flows": F.array().cast("array<string>"),
            "relationships": F.when(F.size("_found") >= 2, single).otherwise(F.array().cast(f"array<{_RELATION}>")),
            "character_count": F.length(t).cast("long"),
        },
    ).drop("_found")
    return _complexity(features).withColumn("analysis_method", F.lit(BASIC_METHOD))


def score_prompts(df: DataFrame, text: str = "prompt") -> DataFrame:
    """The scored-prompt row. Invalid prompts stay, as ``error`` rows with zeros."""
    cleaned = df.withColumn(text, strip(F.coalesce(F.col(text), F.lit("nan"))))
    scored = analyze(cleaned, text).withColumn("_bad", is_invalid(F.col(text)))

    def unless_bad(value: Column, otherwise: Column) -> Column:
        return F.when(F.col("_bad"), otherwise).otherwise(value)

    error, zero = F.lit("Error"), F.lit(0).cast("long")
    keep = [c for c in df.columns if c != text]
    return scored.select(
        *keep,
        F.col(text).alias("original_prompt"),
        unless_bad(F.col("analysis_method"), error).alias("ai_analysis_method"),
        unless_bad(F.array_join(F.slice("entities", 1, 5), ", "), error).alias("detected_entities"),
        unless_bad(F.array_join(F.slice("verbs", 1, 3), ", "), error).alias("detected_actions"),
        unless_bad(F.col("character_count"), zero).alias("character_count"),
        unless_bad(F.col("complexity_score"), zero).alias("complexity_score"),
        unless_bad(F.col("complexity_rate"), F.lit(0.0)).alias("complexity_rate"),
        F.when(F.col("_bad"), "error").otherwise("success").alias("processing_status"),
    )


def stamp(df: DataFrame, name: str = "processing_timestamp") -> DataFrame:
    """Add the processing time as the report writes it."""
    return df.withColumn(name, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


# The text of the standard prompt.
_HEAD = '\nGenerate PlantUML ACTIVITY diagram for:\n"'
_TAIL = """

 Requirements:
1. Start with (*) and end with (*)
2. Represent all main actions as activities in rectangles
3. Use decision diamonds <> for conditional flows
4. Include fork and join for parallel activities
5. Use proper activity flow arrows -->
6. Add swimlanes if multiple actors are involved
7. Include notes and comments for clarity
8. Show error handling and alternative flows

Output Format: Complete PlantUML activity diagram code starting with @startuml and ending with @enduml

Enhanced AI Insight: Focus on modeling the complete workflow with proper activity flow, decisions, and parallel processes as identified by the AI analysis.
"""


def standard_prompt(df: DataFrame, text: str = "prompt", label: str | None = None) -> DataFrame:
    """Add ``standard_prompt`` to analysed prompts; invalid prompts are dropped."""
    none = F.lit("None detected")

    def listed(values: Column, count: int) -> Column:
        return F.when(F.size(values) > 0, F.array_join(F.slice(values, 1, count), ", ")).otherwise(none)

    tuples = F.transform(
        "relationships",
        lambda r: F.concat(F.lit("('"), r["rel"], F.lit("', '"), r["subj"], F.lit("', '"), r["obj"], F.lit("')")),
    )
    related = F.when(F.size(tuples) > 0, F.concat(F.lit("["), F.array_join(tuples, ", "), F.lit("]"))).otherwise(none)
    mood = F.lit("")
    if label is not None:
        mood = F.when(F.coalesce(F.col(label), F.lit("")) != "", F.concat(F.lit("\n- Sentiment: "), F.col(label))).otherwise("")
    kinds = F.when(F.size("flows") > 0, F.concat(F.lit("\n- Flow Patterns: "), F.array_join("flows", ", "))).otherwise("")
    built = F.concat(
        F.lit(_HEAD), F.col(text), F.lit('"\n\n AI Analysis Method: '), F.col("analysis_method"),
        F.lit("\n- Key Entities: "), listed(F.col("entities"), 10),
        F.lit("\n- Action Verbs: "), listed(F.col("verbs"), 8),
        F.lit("\n- Relationships: "), related, mood, kinds, F.lit(_TAIL),
    )
    return df.filter(~is_invalid(F.col(text))).withColumn("standard_prompt", built)


def standard_prompt_table(df: DataFrame, text: str = "prompt", label: str | None = None) -> DataFrame:
    """The standard-prompt report: a row for each valid prompt, stamped; invalid ones have no row.

    The other columns of ``df``, such as ``row_number``, come first; they are those of the whole
    table, so a dropped prompt leaves a gap.
    """
    clean = df.withColumn(text, strip(F.coalesce(F.col(text), F.lit("nan")))).filter(~is_invalid(F.col(text)))
    built = standard_prompt(analyze(clean, text), text, label)
    return stamp(built.select(
        *[c for c in df.columns if c not in (text, label)],
        F.col(text).alias("original_prompt"),
        F.col("standard_prompt").alias("ai_enhanced_activity_prompt"),
        F.col("analysis_method").alias("ai_analysis_method"),
        F.array_join(F.slice("entities", 1, 5), ", ").alias("detected_entities"),
        F.array_join(F.slice("verbs", 1, 3), ", ").alias("detected_actions"),
        "character_count",
        F.lit("success").alias("processing_status"),
    ))


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str, default: str = "NEUTRAL") -> DataFrame:
    """Attach a supplied label per text; texts without one get the default.

    Both sides are unique on ``key``, so no key is hot.
    """
    return df.join(labels.select(key, F.col(label).alias("label")), key, "left").withColumn(
        "label", F.coalesce(F.col("label"), F.lit(default))
    )


def run_counts(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Processed, successful and failed prompts and the success rate in percent.

    A prompt fails just when it is invalid, so no text is analysed for the counts.
    """
    ok = F.count(F.when(~is_invalid(F.coalesce(F.col(text), F.lit(""))), 1))
    return prompts.agg(F.count(F.lit(1)).alias("processed"), ok.alias("succeeded")).select(
        "processed",
        "succeeded",
        (F.col("processed") - F.col("succeeded")).alias("failed"),
        F.when(F.col("processed") > 0, F.col("succeeded") / F.col("processed") * 100.0).alias("_r"),
    ).select("processed", "succeeded", "failed", py_round(F.col("_r"), 1).alias("success_rate"))
