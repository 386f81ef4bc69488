"""Pair operators over whole conversations (variants) and embeddings (vectors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.lcs_sql import characters, lcs
from checks.registry import RX_WORD, RX_WS, check, sql_np_round, sql_py_round, sql_strip, table, with_
from quillgauge.operators import pairs as pz
from quillgauge.sources import readers

V = ("v", views.V_VARIANTS)
PAIRS = (
    "p",
    "select x.story_id, x.model_group, x.variant as a, y.variant as b, x.code as code_a, y.code as code_b from v x join v y "
    "on x.story_id = y.story_id and x.model_group = y.model_group and x.variant < y.variant",
)
ALL_PAIRS = (
    "q",
    "select x.story_id, x.variant as a, y.variant as b, x.model_group as group_a, y.model_group as group_b from v x join v y "
    "on x.story_id = y.story_id and x.variant < y.variant",
)
TOK = (
    "tok",
    f"""select *, case when len(inside) > 0 then inside else regexp_extract_all(lower(code), '{RX_WORD}{{2,}}') end as tokens
from (select *, flatten(list_transform(regexp_extract_all(lower(code), ':{RX_WS}*([^;]+){RX_WS}*;', 1),
  lambda s: regexp_extract_all(s, '{RX_WORD}{{2,}}'))) as inside from v)""",
)
_ONE_EMPTY = "case when {a} = 0 and {b} = 0 then 1::double when {a} = 0 or {b} = 0 then 0::double else {x} end"
JAC = (
    "jac",
    "select p.story_id, p.a, p.b, " + _ONE_EMPTY.format(
        a="len(x.tokens)", b="len(y.tokens)",
        x="len(list_intersect(list_distinct(x.tokens), list_distinct(y.tokens)))::double / len(list_distinct(x.tokens || y.tokens))")
    + " as jaccard from p join tok x on x.story_id = p.story_id and x.variant = p.a "
      "join tok y on y.story_id = p.story_id and y.variant = p.b",
)
TERMS = (
    "terms",
    f"""select story_id, variant, term, count(*) as tf from (
  select story_id, variant, unnest(w) as term from (select *, regexp_extract_all(lower(code), '{RX_WORD}{{2,}}') as w from v)
  union all
  select story_id, variant, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: concat(z[1], ' ', z[2]))) as term
  from (select *, regexp_extract_all(lower(code), '{RX_WORD}{{2,}}') as w from v) where len(w) > 1)
group by all""",
)
TF = (
    "tf",
    """select p.story_id, p.a, p.b, case when x.terms is null and y.terms is null then null else coalesce(
   s.xy / (sqrt(s.xx + c.r * (x.ss - s.xx)) * sqrt(s.yy + c.r * (y.ss - s.yy))), 0::double) end as tfidf
from p cross join (select (1 + ln(1.5::double)) * (1 + ln(1.5::double)) as r) c
left join (select story_id, variant, count(*) as terms, sum(tf * tf)::double as ss from terms group by all) x
  on x.story_id = p.story_id and x.variant = p.a
left join (select story_id, variant, count(*) as terms, sum(tf * tf)::double as ss from terms group by all) y
  on y.story_id = p.story_id and y.variant = p.b
left join (select p.story_id, p.a, p.b, sum(l.tf * r.tf)::double as xy, sum(l.tf * l.tf)::double as xx, sum(r.tf * r.tf)::double as yy
  from p join terms l on l.story_id = p.story_id and l.variant = p.a
  join terms r on r.story_id = p.story_id and r.variant = p.b and r.term = l.term group by all) s
  on s.story_id = p.story_id and s.a = p.a and s.b = p.b""",
)
BM = (
    "bm",
    f"""select p.story_id, p.a, p.b, {_ONE_EMPTY.format(a="len(x.tokens)", b="len(y.tokens)",
   x="greatest(0::double, least(1::double, (coalesce(s12, 0) + coalesce(s21, 0)) / (2 * greatest(coalesce(s12, 0), coalesce(s21, 0), 1e-9::double))))")} as bm25
from p join tok x on x.story_id = p.story_id and x.variant = p.a join tok y on y.story_id = p.story_id and y.variant = p.b
left join (select p.story_id, p.a, p.b, sum(l.tf * r.w) as s12, sum(r.tf * l.w) as s21
  from p join wt l on l.story_id = p.story_id and l.variant = p.a
  join wt r on r.story_id = p.story_id and r.variant = p.b and r.token = l.token group by all) s
  on s.story_id = p.story_id and s.a = p.a and s.b = p.b""",
)
POST = ("post", "select story_id, variant, dl, token, count(*) as tf from "
                "(select story_id, variant, len(tokens) as dl, unnest(tokens) as token from tok) group by all")
RAW = ("raw", "select token, ln((select count(*) from v) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as idf from post group by token")
IDF = ("idf", f"select token, case when idf < 0 then (select avg(idf) from raw) * {pz.BM25_EPSILON}::double else idf end as idf from raw")
WT = (
    "wt",
    f"""select story_id, variant, token, tf, idf * tf * {pz.BM25_K1 + 1}::double / (tf + {pz.BM25_K1}::double * (1 - {pz.BM25_B}::double
  + {pz.BM25_B}::double * dl / (select avg(len(tokens)) from tok))) as w from post join idf using (token)""",
)
# by character, of the stripped texts
TEXTS = ("texts", f"select story_id, a, b, {characters(sql_strip('code_a'))} as x, {characters(sql_strip('code_b'))} as y from "
                  "(select story_id, a, b, coalesce(code_a, '') as code_a, coalesce(code_b, '') as code_b from p)")
LCS = lcs("texts", ["story_id", "a", "b"], "x", "y")
LEV = (
    "lev",
    f"select story_id, a, b, {_ONE_EMPTY.format(a='len(x)', b='len(y)', x='2 * lcs / (len(x) + len(y))::double')} as levenshtein "
    "from texts join lcs using (story_id, a, b)",
)
ALL_PARTS = (V, PAIRS, TOK, JAC, TERMS, TF, POST, RAW, IDF, WT, BM)


def _similarity(spark, sf, *metrics):
    return pz.pair_similarity(views.variants(spark, sf), metrics=metrics)


@check("join1_same_group_pairs", with_(V, PAIRS, select="select story_id, model_group, a, b from p"))
def same_group_pairs(spark, sf):
    return pz.pair_up(
        views.variants(spark, sf).select("story_id", "model_group", "variant"), ["story_id", "model_group"], ["variant"]
    ).select("story_id", "model_group", "a", "b")


@check(
    "join2_cross_group_pairs",
    with_(V, PAIRS, TOK, JAC, ALL_PAIRS, select="select q.story_id, q.a, q.b, q.group_a, q.group_b, "
          + sql_py_round("jaccard", 4) + " as jaccard from q left join jac using (story_id, a, b)"),
)
def cross_group_pairs(spark, sf):
    return pz.with_cross_group(_similarity(spark, sf, "jaccard"), views.variants(spark, sf), ["jaccard"])


@check(
    "join3_pair_labels",
    with_(V, ALL_PAIRS, select="select story_id, a, b, case when group_a = group_b then 'intra' else 'inter' end as kind from q"),
)
def pair_labels(spark, sf):
    pairs = pz.pair_up(
        views.variants(spark, sf).select("story_id", "model_group", "variant"), ["story_id"], ["model_group"]
    ).select("story_id", "a", "b", F.col("l.model_group").alias("group_a"), F.col("r.model_group").alias("group_b"))
    return pz.label_pairs(pairs).drop("group_a", "group_b")


@check(
    "join6_pair_fan_out",
    with_(V, PAIRS, select="select story_id, a, b, unnest([a, b]) as \"column\" from p"),
)
def pair_fan_out(spark, sf):
    pairs = pz.pair_up(
        views.variants(spark, sf).select("story_id", "model_group", "variant"), ["story_id", "model_group"], ["variant"]
    )
    return pz.pairs_to_columns(pairs, ["story_id"])


@check("sim1_activity_tokens", with_(("v", f"select story_id, variant, code from ({views.V_DIAGRAMS})"), TOK,
                                     select="select story_id, array_to_string(tokens, ' ') as tokens from tok"))
def activity_tokens(spark, sf):
    return views.diagrams(spark, sf).select("story_id", F.array_join(pz.activity_tokens(F.col("code")), " ").alias("tokens"))


@check("sim2_jaccard", with_(V, PAIRS, TOK, JAC, select=f"select story_id, a, b, {sql_py_round('jaccard', 4)} as jaccard from jac"))
def jaccard(spark, sf):
    return _similarity(spark, sf, "jaccard").select("story_id", "a", "b", "jaccard")


@check(
    "sim3_edit_ratio",
    with_(V, PAIRS, TEXTS, *LCS, LEV, select=f"select story_id, a, b, {sql_py_round('levenshtein', 4)} as levenshtein from lev"),
)
def edit_ratio(spark, sf):
    return _similarity(spark, sf, "levenshtein").select("story_id", "a", "b", "levenshtein")


@check("sim4_tfidf_cosine", with_(V, PAIRS, TERMS, TF, select=f"select story_id, a, b, {sql_py_round('tfidf', 4)} as tfidf from tf"))
def tfidf_cosine(spark, sf):
    return _similarity(spark, sf, "tfidf").select("story_id", "a", "b", "tfidf")


# Neighbouring documents: long texts, with far more terms than a reply has.
LONG = ("v", "select doc_id // 2 as story_id, 'DOC' as model_group, concat('DOC', doc_id % 2) as variant, text as code from documents")


@check("sim4_tfidf_long_texts", with_(LONG, PAIRS, TERMS, TF, select=f"select story_id, a, b, {sql_py_round('tfidf', 4)} as tfidf from tf"))
def tfidf_long_texts(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id div 2 as story_id", "'DOC' as model_group", "concat('DOC', doc_id % 2) as variant", "text as code"
    )
    return pz.pair_similarity(rows, metrics=("tfidf",)).select("story_id", "a", "b", "tfidf")


@check("sim5_bm25", with_(V, PAIRS, TOK, POST, RAW, IDF, WT, BM, select=f"select story_id, a, b, {sql_py_round('bm25', 4)} as bm25 from bm"))
def bm25(spark, sf):
    return _similarity(spark, sf, "bm25").select("story_id", "a", "b", "bm25")


# The Okapi formula with the two texts as the corpus, token by token.
_PAIR_OKAPI = (
    "ok",
    """select *, list_sum(list_transform(x, lambda t: case when list_contains(y, t)
   then idf * len(list_filter(y, lambda u: u = t)) * 2.5::double / (len(list_filter(y, lambda u: u = t)) + 1.5::double * (0.25::double + 0.75::double * len(y) / mean)) else 0::double end)) as s12,
 list_sum(list_transform(y, lambda t: case when list_contains(x, t)
   then idf * len(list_filter(x, lambda u: u = t)) * 2.5::double / (len(list_filter(x, lambda u: u = t)) + 1.5::double * (0.25::double + 0.75::double * len(x) / mean)) else 0::double end)) as s21
from (select p.story_id, p.a, p.b, x.tokens as x, y.tokens as y, (len(x.tokens) + len(y.tokens)) / 2::double as mean,
  0.25::double * (ln(0.5::double) - ln(2.5::double)) * len(list_intersect(list_distinct(x.tokens), list_distinct(y.tokens)))
    / greatest(len(list_distinct(x.tokens || y.tokens)), 1) as idf
  from p join tok x on x.story_id = p.story_id and x.variant = p.a join tok y on y.story_id = p.story_id and y.variant = p.b)""",
)


@check(
    "sim5_bm25_of_pair",
    with_(V, PAIRS, TOK, _PAIR_OKAPI, select="select story_id, a, b, " + _ONE_EMPTY.format(
        a="len(x)", b="len(y)", x="greatest(0::double, least(1::double, (s12 + s21) / (2 * greatest(s12, s21, 1e-9::double))))") + " as bm25 from ok"),
)
def bm25_of_pair(spark, sf):
    return pz.pair_similarity(views.variants(spark, sf), metrics=("bm25",), bm25_corpus="pair").select("story_id", "a", "b", "bm25")


def _dot(x, y):
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1]::double * z[2]::double))"


VEC = ("v", views.V_VECTORS)
COS = f"{_dot('x.embedding', 'y.embedding')} / (sqrt({_dot('x.embedding', 'x.embedding')}) * sqrt({_dot('y.embedding', 'y.embedding')}))"


@check(
    "sim6_embedding_cosine",
    with_(VEC, select=f"select x.story_id, x.variant as a, y.variant as b, {sql_py_round(f'({COS} + 1) / 2', 4)} as embedding "
                      "from v x join v y on x.story_id = y.story_id and x.model_group = y.model_group and x.variant < y.variant"),
)
def embedding_cosine(spark, sf):
    rows = views.vectors(spark, sf).withColumn("code", F.lit(""))
    return pz.pair_similarity(rows, metrics=(), vector="embedding").select("story_id", "a", "b", "embedding")


_THREE = "[jaccard, tfidf, bm25]"
_COMBINED = (
    "z",
    f"""select story_id, a, b, jaccard, tfidf, bm25, list_avg(list_filter({_THREE}, lambda x: x is not null)) as mean_,
  (coalesce(jaccard * 0.25::double, 0) + coalesce(tfidf * 0.3::double, 0) + coalesce(bm25 * 0.1::double, 0))
  / (case when jaccard is null then 0::double else 0.25::double end + case when tfidf is null then 0::double else 0.3::double end
     + case when bm25 is null then 0::double else 0.1::double end) as weighted_
from jac join tf using (story_id, a, b) join bm using (story_id, a, b)""",
)


@check("sim7_mean", with_(*ALL_PARTS, _COMBINED, select=f"select story_id, a, b, {sql_np_round('mean_', 4)} as mean from z"))
def component_mean(spark, sf):
    return _similarity(spark, sf, "jaccard", "tfidf", "bm25").select("story_id", "a", "b", "mean")


@check("sim8_weighted", with_(*ALL_PARTS, _COMBINED, select=f"select story_id, a, b, {sql_py_round('weighted_', 4)} as weighted from z"))
def component_weighted(spark, sf):
    return _similarity(spark, sf, "jaccard", "tfidf", "bm25").select("story_id", "a", "b", "weighted")


_FOUR = {"jaccard": 0.25, "levenshtein": 0.25, "tfidf": 0.3, "bm25": 0.1}  # fixed values: the report's weights
_TABLE = (
    "z",
    f"select *, list_avg(list_filter([{', '.join(_FOUR)}], lambda x: x is not null)) as mean_, ("
    + " + ".join(f"coalesce({n} * {w}::double, 0)" for n, w in _FOUR.items()) + ") / ("
    + " + ".join(f"case when {n} is null then 0::double else {w}::double end" for n, w in _FOUR.items())
    + ") as weighted_ from p join jac using (story_id, a, b) join lev using (story_id, a, b) join tf using (story_id, a, b) join bm using (story_id, a, b)",
)


@check(
    "sim9_pair_table",
    with_(*ALL_PARTS, TEXTS, *LCS, LEV, _TABLE, select="select story_id, model_group, a, b, "
          + ", ".join(f"{sql_py_round(n, 4)} as {n}" for n in _FOUR)
          + f", {sql_np_round('mean_', 4)} as mean, {sql_py_round('weighted_', 4)} as weighted from z"),
)
def pair_table(spark, sf):
    return _similarity(spark, sf, "jaccard", "levenshtein", "tfidf", "bm25")


@check(
    "src5_column_groups",
    with_(V, select="select * exclude (n) from (select story_id, variant, upper(substr(variant, 1, 3)) as model_group, "
                    "(select count(distinct w.variant) from v w where upper(substr(w.variant, 1, 3)) = upper(substr(v.variant, 1, 3))) as n "
                    "from v where length(variant) >= 3) where n >= 2"),
)
def column_groups(spark, sf):
    return readers.grouped_variants(views.variants(spark, sf)).select("story_id", "variant", "model_group")
