"""Prompt-code correspondence over whole conversations, diagrams and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.lcs_sql import lcs
from checks.pair_checks import _dot
from checks.registry import RX_WS, check, sql_py_round, table, with_
from quillgauge.operators import correspondence as co

V = ("v", views.V_VARIANTS)
ST = ("st", views.V_STORIES)
D = ("d", views.V_DIAGRAMS)


@check("join4_prompt_variants", with_(V, ST, select="select story_id, variant, prompt, code from v join st using (story_id)"))
def prompt_variants(spark, sf):
    return co.join_prompts(views.variants(spark, sf).select("story_id", "variant", "code"), views.stories(spark, sf))


# Vectors: each embedding is the code vector of one variant of story vec_id // 6, whose first
# embedding is the prompt vector.
VEC = ("v", views.V_VECTORS)
PV = ("pv", "select vec_id // 6 as story_id, embedding as pe from embeddings where vec_id % 6 = 0")
COS = (
    "cosine",
    f"""select v.story_id, v.variant, coalesce(case when n > 0 then {_dot('pv.pe', 'v.embedding')} / n end, 0) as s
from (select v.*, pv.pe, sqrt({_dot('pv.pe', 'pv.pe')}) * sqrt({_dot('v.embedding', 'v.embedding')}) as n
  from v join pv using (story_id)) v join pv using (story_id)""",
)


def _vector_rows(spark, sf):
    """Each vector with the text of one diagram: vectors go round all of them."""
    all_diagrams = table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    diagrams = views.diagrams(spark, sf).selectExpr("story_id as _d", "code")
    number = F.expr("story_id * 6 + cast(substring(variant, 4) as int)") % all_diagrams
    rows = views.vectors(spark, sf).withColumn("_d", number).join(diagrams, "_d").drop("_d")
    prompts = table(spark, sf, "embeddings").filter("vec_id % 6 = 0").selectExpr(
        "vec_id div 6 as story_id", "'prompt' as prompt", "embedding as pe"
    )
    return co.correspondence(rows, prompts, metrics=(), code_vector="embedding", prompt_vector="pe")


@check("cor1_embedding_similarity", with_(VEC, PV, COS, select=f"select story_id, variant, {sql_py_round('s', 4)} as similarity from cosine"))
def embedding_similarity(spark, sf):
    return _vector_rows(spark, sf).select("story_id", "variant", "similarity")


QUALITY = r"""50::double + case when contains(code, '@startuml') and contains(code, '@enduml') then 10 else -10 end
 + case when contains(code, 'start') and contains(code, 'stop') then 10 else 0 end
 + case when len(regexp_extract_all(code, ':.+?;')) >= 3 then 10 else 0 end"""


@check("cor2_quality", with_(D, select=f"select story_id, variant, ({QUALITY})::double as quality from d"))
def quality(spark, sf):
    return views.diagrams(spark, sf).select("story_id", "variant", co.basic_quality(F.col("code")).alias("quality"))


@check(
    "cor3_match_rate",
    with_(VEC, PV, COS, D, select=f"select c.story_id, c.variant, {sql_py_round(f's * ({QUALITY})', 4)} as match_rate from cosine c "
          "join d on d.story_id = (c.story_id * 6 + substr(c.variant, 4)::int) % (select count(*) from documents)"),
)
def match_rate(spark, sf):
    return _vector_rows(spark, sf).select("story_id", "variant", "match_rate")


@check(
    "flt3_short_code",
    with_(V, ST, select=f"select story_id, variant, case when length(code) < 20 then 0::double else ({QUALITY})::double end as quality "
                        "from v join st using (story_id)"),
)
def short_code(spark, sf):
    return co.correspondence(views.variants(spark, sf), views.stories(spark, sf), metrics=()).select(
        "story_id", "variant", "quality"
    )


def _tokens(x):
    return f"list_filter(regexp_split_to_array(lower({x}), '{RX_WS}+'), lambda t: t <> '')"


J = ("j", f"select story_id, variant, code, {_tokens('code')} as h, {_tokens('prompt')} as r from v join st using (story_id)")


def _grams(side):
    parts = []
    for n in range(1, 5):
        body = f"array_to_string({side}[i:i + {n - 1}], ' ')"
        parts.append(
            f"select story_id, variant, {n} as n, g, count(*) as c from (select story_id, variant, "
            f"unnest(list_transform(generate_series(1, len({side}) - {n - 1}), lambda i: {body})) as g from j) group by all"
        )
    return " union all ".join(parts)


BLEU = (
    "bl",
    """select j.story_id, j.variant, len(h) as hl, len(r) as rl, code, list_transform([1, 2, 3, 4], lambda n:
   coalesce(list_filter(m, lambda z: z.n = n)[1].c, 0)) as m
from j left join (select story_id, variant, list({'n': n, 'c': c}) as m from (
   select hg.story_id, hg.variant, hg.n, sum(least(hg.c, rg.c)) as c from hg join rg using (story_id, variant, n, g) group by all)
 group by all) using (story_id, variant)""",
)


def _bleu_sql():
    terms = []
    for n in range(1, 5):
        zeros = " + ".join(f"case when m[{k}] = 0 then 1 else 0 end" for k in range(1, n + 1))
        size = f"greatest(hl - {n - 1}, 1)::double"
        terms.append(
            f"coalesce(ln(case when m[{n}] > 0 then m[{n}]::double / {size} when hl > 1 then "
            f"1::double / (pow(2::double, {zeros}) * 5::double / ln(hl)) / {size} end), 0::double) * 0.25::double"
        )
    return (
        "case when length(code) < 20 or m[1] = 0 then 0::double else "
        "case when hl > rl then 1::double else exp(1 - rl / nullif(hl, 0)::double) end * exp(" + " + ".join(terms) + ") end"
    )


@check(
    "cor4_bleu",
    with_(V, ST, J, ("hg", _grams("h")), ("rg", _grams("r")), BLEU,
          select=f"select story_id, variant, {sql_py_round(_bleu_sql(), 4)} as bleu from bl"),
)
def bleu(spark, sf):
    return co.correspondence(views.variants(spark, sf), views.stories(spark, sf), metrics=("bleu",)).select(
        "story_id", "variant", "bleu"
    )


# by word
TEXTS = ("texts", "select story_id, variant, code, h as x, r as y from j")
LCS = lcs("texts", ["story_id", "variant"], "x", "y")
ROUGE = (
    "rouge",
    "select story_id, variant, code, case when length(code) < 20 or len(x) + len(y) = 0 then 0::double "
    "else 2 * lcs / (len(x) + len(y))::double end as rouge_l from texts join lcs using (story_id, variant)",
)


@check("cor5_rouge_l", with_(V, ST, J, TEXTS, *LCS, ROUGE, select=f"select story_id, variant, {sql_py_round('rouge_l', 4)} as rouge_l from rouge"))
def rouge_l(spark, sf):
    return co.correspondence(views.variants(spark, sf), views.stories(spark, sf), metrics=("rouge_l",)).select(
        "story_id", "variant", "rouge_l"
    )


@check(
    "cor6_correspondence_table",
    with_(V, ST, J, ("hg", _grams("h")), ("rg", _grams("r")), BLEU, TEXTS, *LCS, ROUGE,
          select="select story_id, variant, null::double as similarity, "
                 + sql_py_round(f"case when length(rouge.code) < 20 then 0::double else ({QUALITY.replace('code', 'rouge.code')})::double end", 2)
                 + f" as quality, null::double as match_rate, {sql_py_round(_bleu_sql().replace('code', 'bl.code'), 4)} as bleu, "
                 + f"{sql_py_round('rouge_l', 4)} as rouge_l from bl join rouge using (story_id, variant)"),
)
def correspondence_table(spark, sf):
    return co.correspondence(views.variants(spark, sf), views.stories(spark, sf))
