"""Prompt analytics over whole ``documents`` texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import RX_WORD, RX_WS, check, sql_py_round, sql_strip, table, with_
from quillgauge.operators import prompts as pr
from quillgauge.session import shared_folder
from quillgauge.sources import readers


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RX_NOUN = "|".join(pr.NOUN_FRAGMENTS)
CAP = "concat(upper(substr(w, 1, 1)), substr(w, 2))"
T = ("t", f"select doc_id, {sql_strip('text')} as prompt from documents")
W = ("w", f"select doc_id, prompt, lower(prompt) as low, regexp_extract_all(prompt, '{RX_WORD}+') as runs, "
          f"regexp_extract_all(lower(prompt), '{RX_WORD}+') as words from t")


def _relation(kind, parts):
    link = f"{RX_WS}+".join(parts)
    pattern = f"'({RX_WORD}+){RX_WS}+{link}{RX_WS}+({RX_WORD}+)'"
    return (
        f"list_transform(list_filter(list_zip(regexp_extract_all(low, {pattern}, 1), regexp_extract_all(low, {pattern}, 2)), "
        "lambda p: length(p[1]) > 2 and length(p[2]) > 2), lambda p: concat('(''" + kind + "'', ''', upper(p[1][1]), p[1][2:], "
        "''', ''', upper(p[2][1]), p[2][2:], ''')'))"
    )


A = (
    "a",
    f"""select doc_id, prompt, words, length(prompt) as character_count,
  case when len(e) > 0 then e else {_list(pr.DEFAULT_ENTITIES)} end as entities,
  case when len(v) > 0 then v else {_list(pr.DEFAULT_VERBS)} end as verbs,
  list_filter([{', '.join(f"case when regexp_matches(low, '{'|'.join(p)}') then '{k}' end" for k, p in pr.FLOWS.items())}],
    lambda x: x is not null) as flows,
  ({' || '.join(_relation(k, p) for k, p in pr.RELATIONS.items())})[1:3] as relationships
from (select *, list_sort(list_distinct(
    list_filter(runs, lambda x: regexp_matches(x, '^[A-Z][a-zA-Z]*$') and length(x) > 2)
    || list_transform(list_filter(words, lambda x: regexp_matches(x, '{RX_NOUN}')), lambda w: {CAP}))) as e,
  list_filter(words, lambda x: list_contains({_list(pr.VERBS)}, x)) as v from w)""",
)
K = (
    "k",
    f"""select *, least({sql_py_round('complexity_score / ln(character_count + 1)', 2)}, 10.0::double) as complexity_rate
from (select *, (len(list_distinct(entities)) + len(list_distinct(verbs)) + len(flows))::bigint as complexity_score from a)""",
)
ANALYSED = (T, W, A, K)


def _docs(spark, sf):
    """Documents as prompts, stripped as the reader strips them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", pr.raw_prompt(docs.select("text")).alias("prompt"))


def _analysed(spark, sf):
    return pr.analyze(_docs(spark, sf))


@check("src1_story_reader", with_(T, select="select doc_id + 1 as row_number, prompt from t"))
def story_reader(spark, sf):
    """The documents written as quoted CSV, in order over several files, and read again."""
    folder = f"{shared_folder(spark)}/stories-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    docs.select("text").write.option("header", True).option("escape", '"').option("nullValue", "\u0000").csv(folder)
    return readers.read_stories(spark, folder).select("row_number", "prompt")


@check("prm1_words", with_(T, W, select="select doc_id, len(words)::bigint as n_words, array_to_string(words, ' ') as words from w"))
def prompt_words(spark, sf):
    tokens = pr.words(F.col("prompt"))
    return _docs(spark, sf).select("doc_id", tokens.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words")
    )


for _name, _column in (("prm2_entities", "entities"), ("prm3_verbs", "verbs"), ("prm4_flows", "flows")):

    def _register(name, column):
        @check(name, with_(T, W, A, select=f"select doc_id, array_to_string({column}, ', ') as {column} from a"))
        def run(spark, sf):
            return _analysed(spark, sf).select("doc_id", F.array_join(column, ", ").alias(column))

    _register(_name, _column)


@check("prm5_relationships", with_(T, W, A, select="select doc_id, array_to_string(relationships, ', ') as relationships from a"))
def prompt_relationships(spark, sf):
    shown = F.transform(
        "relationships",
        lambda r: F.concat(F.lit("('"), r["rel"], F.lit("', '"), r["subj"], F.lit("', '"), r["obj"], F.lit("')")),
    )
    return _analysed(spark, sf).select("doc_id", F.array_join(shown, ", ").alias("relationships"))


_BASIC = (
    "b",
    f"""select doc_id, prompt, length(prompt) as character_count, raw,
  case when len(raw) > 0 then list_sort(list_distinct(raw)) else {_list(pr.DEFAULT_ENTITIES)} end as entities,
  case when len(v) > 0 then v else {_list(pr.DEFAULT_VERBS)} end as verbs
from (select *, list_transform(list_filter(runs, lambda x: regexp_matches(x, '^[A-Za-z]+$')
      and (list_contains({_list(pr.BASIC_ENTITIES)}, lower(x)) or length(x) > 8)),
    lambda x: concat(upper(x[1]), lower(x[2:]))) as raw,
  list_filter({_list(pr.BASIC_VERBS)}, lambda x: contains(low, x)) as v from w)""",
)


@check(
    "prm6_basic_analysis",
    with_(T, W, _BASIC, select=f"""select doc_id, array_to_string(entities, ', ') as entities, array_to_string(verbs, ', ') as verbs,
  case when len(raw) >= 2 then 1 else 0 end::bigint as relationships, complexity_score,
  least({sql_py_round('complexity_score / ln(character_count + 1)', 2)}, 10.0::double) as complexity_rate
from (select *, (len(list_distinct(entities)) + len(list_distinct(verbs)))::bigint as complexity_score from b)"""),
)
def basic_analysis(spark, sf):
    return pr.analyze_basic(_docs(spark, sf)).select(
        "doc_id", F.array_join("entities", ", ").alias("entities"), F.array_join("verbs", ", ").alias("verbs"),
        F.size("relationships").cast("long").alias("relationships"), "complexity_score", "complexity_rate",
    )


@check("prm7_complexity", with_(*ANALYSED, select="select doc_id, character_count, complexity_score, complexity_rate from k"))
def complexity(spark, sf):
    return _analysed(spark, sf).select("doc_id", "character_count", "complexity_score", "complexity_rate")


# All documents, and for every 9th a blank and for every 10th a NULL prompt more, so that the invalid branch has rows.
TB = (
    "t",
    f"select doc_id, {sql_strip('text')} as prompt from documents "
    "union all select doc_id + 10000000, '' from documents where doc_id % 9 = 0 "
    "union all select doc_id + 20000000, 'NULL' from documents where doc_id % 10 = 0",
)
_BAD = "lower(prompt) in ('nan', 'null', '')"
SCORED_SQL = f"""select doc_id + 1 as row_number, prompt as original_prompt,
  case when {_BAD} then 'Error' else '{pr.MODEL_METHOD}' end as ai_analysis_method,
  case when {_BAD} then 'Error' else array_to_string(entities[1:5], ', ') end as detected_entities,
  case when {_BAD} then 'Error' else array_to_string(verbs[1:3], ', ') end as detected_actions,
  case when {_BAD} then 0 else character_count end as character_count,
  case when {_BAD} then 0 else complexity_score end as complexity_score,
  case when {_BAD} then 0::double else complexity_rate end as complexity_rate,
  case when {_BAD} then 'error' else 'success' end as processing_status from k"""


def _broken(spark, sf):
    docs = table(spark, sf, "documents")
    blank = docs.filter("doc_id % 9 = 0").selectExpr("doc_id + 10000001 as row_number", "'  ' as prompt")
    null = docs.filter("doc_id % 10 = 0").selectExpr("doc_id + 20000001 as row_number", "'NULL' as prompt")
    return docs.selectExpr("doc_id + 1 as row_number", "text as prompt").union(blank).union(null)


# ln(0 + 1) = 0 for a blank prompt: keep the division out of the SQL for those rows.
_KB = ("k", K[1].replace("ln(character_count + 1)", "nullif(ln(character_count + 1), 0)"))


@check("prm8_scored_prompts", with_(TB, W, A, _KB, select=SCORED_SQL))
def scored_prompts(spark, sf):
    return pr.score_prompts(_broken(spark, sf))


@check("flt1_invalid_prompts", with_(TB, select=f"select count(*) filter (where {_BAD}) as invalid, count(*) filter (where not {_BAD}) as kept from t"))
def invalid_prompts(spark, sf):
    bad = pr.is_invalid(F.col("prompt"))
    return _broken(spark, sf).agg(F.count(F.when(bad, 1)).alias("invalid"), F.count(F.when(~bad, 1)).alias("kept"))


@check(
    "agg12_run_counts",
    with_(TB, select=f"""select count(*) as processed, count(*) filter (where not {_BAD}) as succeeded,
  count(*) filter (where {_BAD}) as failed,
  {sql_py_round(f"count(*) filter (where not {_BAD}) / count(*) * 100", 1)} as success_rate from t"""),
)
def run_counts(spark, sf):
    return pr.run_counts(_broken(spark, sf))


def _sql_text(value):
    return "'" + value.replace("'", "''") + "'"


_STANDARD = f"""concat({_sql_text(pr._HEAD)}, prompt, '"', chr(10), chr(10), ' AI Analysis Method: {pr.MODEL_METHOD}',
  chr(10), '- Key Entities: ', array_to_string(entities[1:10], ', '), chr(10), '- Action Verbs: ', array_to_string(verbs[1:8], ', '),
  chr(10), '- Relationships: ', case when len(relationships) > 0 then concat('[', array_to_string(relationships, ', '), ']')
    else 'None detected' end, chr(10), '- Sentiment: ', label,
  case when len(flows) > 0 then concat(chr(10), '- Flow Patterns: ', array_to_string(flows, ', ')) else '' end, {_sql_text(pr._TAIL)})"""
_LABEL = "case when l.quality is null then 'NEUTRAL' when l.quality = 1 then 'POSITIVE' else 'NEGATIVE' end"


def _labels(spark, sf):
    return table(spark, sf, "labels").selectExpr(
        "doc_id", "case when quality = 1 then 'POSITIVE' else 'NEGATIVE' end as quality_label"
    )


@check("prm10_labels", f"select d.doc_id, {_LABEL} as label from documents d left join labels l using (doc_id)")
def labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return pr.with_label(docs, _labels(spark, sf), "doc_id", "quality_label")


@check(
    "prm9_standard_prompt",
    with_(TB, W, A, select=f"select doc_id + 1 as row_number, {_STANDARD} as standard_prompt from "
                           f"(select a.*, {_LABEL} as label from a left join labels l using (doc_id)) where not ({_BAD})"),
)
def standard_prompt(spark, sf):
    marked = pr.with_label(
        _broken(spark, sf), _labels(spark, sf).selectExpr("doc_id + 1 as row_number", "quality_label"), "row_number", "quality_label"
    )
    clean = marked.withColumn("prompt", pr.strip(F.col("prompt")))
    return pr.standard_prompt(pr.analyze(clean), label="label").select("row_number", "standard_prompt")


@check(
    "prm9_standard_table",
    with_(TB, W, A, select=f"""select doc_id + 1 as row_number, prompt as original_prompt, {_STANDARD} as ai_enhanced_activity_prompt,
  '{pr.MODEL_METHOD}' as ai_analysis_method, array_to_string(entities[1:5], ', ') as detected_entities,
  array_to_string(verbs[1:3], ', ') as detected_actions, length(prompt) as character_count, 'success' as processing_status, true as stamped
from (select a.*, {_LABEL} as label from a left join labels l using (doc_id)) where not ({_BAD})"""),
)
def standard_table(spark, sf):
    marked = pr.with_label(
        _broken(spark, sf), _labels(spark, sf).selectExpr("doc_id + 1 as row_number", "quality_label"), "row_number", "quality_label"
    )
    # the stamp is the time of the run: checked for its form
    form = F.rlike("processing_timestamp", F.lit(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"))
    return pr.standard_prompt_table(marked, label="label").withColumn("stamped", form).drop("processing_timestamp")
