"""Operators on small fixtures: unit vectors, recorded values and brute force."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillgauge.operators import blocks as bl
from quillgauge.operators import code_metrics as cm
from quillgauge.operators import correspondence as co
from quillgauge.operators import pairs as pz
from quillgauge.operators import prompts as pr
from quillgauge.operators import ranking, selection, stats
from quillgauge.operators.embedding import with_embedding
from quillgauge.operators.positions import quantiles, rank_rows, row_index, value_positions
from quillgauge.operators.skew import even_join, salted_join
from quillgauge.sources import readers

BALANCED = """@startuml
start
:Open page;
:Type name;
if (Name known?) then (yes)
  :Greet;
else (no)
  :Ask again;
endif
|Clerk|
note right
end note
partition Back {
:Store -> done;
}
stop
@enduml"""


def test_code_metrics_of_one_diagram(spark):
    df = spark.createDataFrame([(1, "GBT001", BALANCED), (2, "GBT001", None)], "story_id long, variant string, code string")
    rows = {r.story_id: r for r in cm.code_metrics(df).collect()}
    r = rows[1]
    assert (r.activities, r.decisions, r.forks, r.swimlanes, r.notes, r.partitions, r.edges, r.numberline) == (5, 1, 0, 1, 1, 1, 1, 15)
    raw = 5 * 3 + 4 + 2 + 1.2 + 0.8 + 1.5 + 15 * 0.05
    assert r.negative_score == 0 and r.penalties == []
    assert r.raw_score == pytest.approx(round(raw, 2))
    assert r.percentage_score == round(raw / (raw + 20) * 100, 1)
    assert r.formatted_score == f"{r.percentage_score}% ({r.raw_score})"
    assert (r.functional_complexity, r.organization_score, r.structural_integrity) == (9.5, 2.0, 10.0)
    empty = rows[2]
    assert empty.negative_score == -20 and empty.percentage_score == 0 and empty.formatted_score == "0% (-20.0)"
    assert [p.element for p in empty.penalties] == ["missing_start", "missing_stop"]


def test_line_rules(spark):
    code = "\n".join([
        "IF x  then", "if(x) then", "if (a) then (b)", "switch (q)", "case (1)", ":authenticate;", ":;", ":two options;",
        "FORK", "split", "end  fork", "| a |", "||", "note", "note left", "'comment", "-->", "<--x", "detach", "endswitch",
    ])
    df = spark.createDataFrame([(code,)], "code string")
    r = cm.with_line_counts(df).first()
    # ":authenticate;" contains "then", so it is no activity
    assert (r.activities, r.decisions, r.forks, r.swimlanes, r.detaches, r.options) == (1, 3, 2, 1, 1, 1)
    assert (r.notes, r.edges, r._joins, r._switches, r._endswitches, r.numberline) == (1, 2, 1, 1, 1, 19)


def test_orphans_far_from_the_flow(spark):
    code = "\n".join(["start", ":a;", *["x"] * 12, ":b;", *["x"] * 12, ":c;", "stop"])
    df = spark.createDataFrame([(code,)], "code string")
    r = cm.code_metrics(df).first()
    found = [p for p in r.penalties if "disconnected" in p.explanation]
    assert [p["count"] for p in found] == [1.0]


# Recorded scores of three prompts: characters, score, rate.
RECORDED = [
    ("As a site visitor, I want to post comments about articles, so that others can read them.", 88, 4, 0.89),
    ("As an Older Person, I want to be able to see my training Performance.", 69, 6, 1.41),
    ("As a Website user, I want to access published FABS files so that I can see the new files as they come in.", 105, 5, 1.07),
]


def test_recorded_prompt_scores(spark):
    df = spark.createDataFrame([(p,) for p, *_ in RECORDED], "prompt string")
    got = {r.original_prompt: (r.character_count, r.complexity_score, r.complexity_rate) for r in pr.score_prompts(df).collect()}
    for prompt, *expected in RECORDED:
        assert got[prompt] == tuple(expected)


def test_prompt_features(spark):
    text = "Login then submit the Form2 form before payment; start IF Größe. Ab triggers it, one leads  to two"
    df = spark.createDataFrame([(text,), (" ",), ("NULL",), (None,)], "prompt string")
    r = pr.analyze(df.filter("prompt like 'Login%'")).first()
    assert r.entities == ["Login", "Payment"]  # "payment" contains "ment"
    assert r.verbs == ["login", "submit", "start"]
    assert r.flows == ["decision"]
    assert [tuple(x) for x in r.relationships] == [("sequence", "Login", "Submit"), ("precedes", "Form", "Payment"), ("leads_to", "One", "Two")]
    assert sorted(x.processing_status for x in pr.score_prompts(df).collect()) == ["error", "error", "error", "success"]
    assert pr.standard_prompt(pr.analyze(df)).count() == 1


def test_hot_story_pairs_are_complete(spark):
    rows = [(1, "GBT", f"GBT{i:03d}") for i in range(150)] + [(s, "CLD", f"CLD{i:03d}") for s in (2, 3) for i in range(3)]
    df = spark.createDataFrame(rows, "story_id long, model_group string, variant string")
    got = [(r.story_id, r.a, r.b) for r in pz.pair_up(df, ["story_id", "model_group"], ["variant"], tile=16).collect()]
    expected = {(s, a, b) for s, g, a in rows for t, h, b in rows if s == t and g == h and a < b}
    assert len(got) == len(expected) and set(got) == expected


def test_pair_similarity_properties(spark):
    texts = [":open the door;", ":open the door;", ":close a window;\n:open it;", "", None, "no activity here"]
    df = spark.createDataFrame(
        [(1, "GBT", f"GBT{i:03d}", t) for i, t in enumerate(texts)], "story_id long, model_group string, variant string, code string"
    )
    got = {(r.a, r.b): r for r in pz.pair_similarity(df).collect()}
    assert len(got) == 15
    same = got["GBT000", "GBT001"]
    assert same.jaccard == same.levenshtein == same.tfidf == same.bm25 == same.weighted == 1.0
    empty = got["GBT003", "GBT004"]
    assert empty.jaccard == empty.levenshtein == empty.bm25 == 1.0 and empty.tfidf is None
    one = got["GBT000", "GBT003"]
    assert one.jaccard == one.levenshtein == one.tfidf == one.bm25 == 0.0
    near = got["GBT000", "GBT002"]
    assert near.jaccard == round(1 / 6, 4)
    for r in got.values():
        for m in ("jaccard", "levenshtein", "tfidf", "bm25", "mean", "weighted"):
            assert r[m] is None or 0.0 <= r[m] <= 1.0


def test_bm25_with_the_pair_as_corpus(spark):
    """Against the Okapi formula, counted token by token."""
    rng = random.Random(5)
    texts = ["", "", "aa", "aa aa", *[" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randint(1, 9))) for _ in range(12)]]
    rows = [(1, "G", f"v{i:02}", t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "story_id long, model_group string, variant string, code string")

    def score(query, doc, idf, mean):
        return sum(idf[t] * doc.count(t) * 2.5 / (doc.count(t) + 1.5 * (0.25 + 0.75 * len(doc) / mean)) for t in query)

    def okapi(x, y):
        if not x or not y:
            return float(not x and not y)
        idf = {t: math.log(2 - n + 0.5) - math.log(n + 0.5) for t in {*x, *y} for n in [(t in x) + (t in y)]}
        mean = sum(idf.values()) / len(idf)
        idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
        length = (len(x) + len(y)) / 2
        forth, back = score(x, y, idf, length), score(y, x, idf, length)
        return min(1.0, max(0.0, (forth + back) / (2 * max(forth, back, 1e-9))))

    got = pz.pair_similarity(table, metrics=("bm25",), bm25_corpus="pair").collect()
    assert len(got) == len(texts) * (len(texts) - 1) // 2
    assert all(r.bm25 == okapi(texts[int(r.a[1:])].split(), texts[int(r.b[1:])].split()) for r in got)
    with pytest.raises(ValueError):
        pz.pair_similarity(table, bm25_corpus="other")


def _tfidf(a, b, limit):
    def terms(t):
        w = [x for x in t.lower().split() if len(x) > 1]
        return collections.Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])])

    ca, cb = terms(a), terms(b)
    kept = sorted(set(ca) | set(cb), key=lambda t: (-(ca[t] + cb[t]), t))[:limit]
    idf = {t: 1.0 if ca[t] and cb[t] else 1.0 + math.log(1.5) for t in kept}
    va, vb = ([c[t] * idf[t] for t in kept] for c in (ca, cb))
    norm = math.sqrt(sum(x * x for x in va)) * math.sqrt(sum(x * x for x in vb))
    return sum(x * y for x, y in zip(va, vb)) / norm if norm else 0.0


def test_tfidf_against_brute_force_with_and_without_limit(spark):
    random.seed(3)
    texts = [" ".join(random.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], k=30)) for _ in range(5)]
    df = spark.createDataFrame(
        [(1, "GBT", f"GBT{i:03d}", t) for i, t in enumerate(texts)], "story_id long, model_group string, variant string, code string"
    )
    for limit in (8000, 12):
        for r in pz.pair_similarity(df, metrics=("tfidf",), limit=limit).collect():
            assert r.tfidf == pytest.approx(_tfidf(texts[int(r.a[3:])], texts[int(r.b[3:])], limit), abs=6e-5)


def _bleu(reference, hypothesis):
    def grams(t, n):
        return collections.Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))

    logs, step = 0.0, 1
    for n in range(1, 5):
        h, r = grams(hypothesis, n), grams(reference, n)
        found, size = sum(min(c, r[g]) for g, c in h.items()), max(1, len(hypothesis) - n + 1)
        if n == 1 and found == 0:
            return 0.0
        p = found / size
        if found == 0:
            if len(hypothesis) <= 1:
                continue
            p = 1 / (2**step * 5 / math.log(len(hypothesis))) / size
            step += 1
        logs += math.log(p) / 4
    short = 1.0 if len(hypothesis) > len(reference) else math.exp(1 - len(reference) / len(hypothesis))
    return short * math.exp(logs)


def test_bleu_and_rouge_against_brute_force(spark):
    random.seed(8)
    words = ["red", "green", "blue", "car", "road", "tree"]
    prompts = [" ".join(random.choices(words, k=k)) for k in (6, 12, 20)]
    codes = [" ".join(random.choices(words, k=k)) for k in (7, 12, 25, 40)] + ["short", "entirely different words in this one", prompts[1]]
    stories = spark.createDataFrame(list(enumerate(prompts)), "story_id long, prompt string")
    variants = spark.createDataFrame(
        [(s, f"GBT{i:03d}", c) for s in range(3) for i, c in enumerate(codes)], "story_id long, variant string, code string"
    )
    for r in co.correspondence(variants, stories).collect():
        code, prompt = codes[int(r.variant[3:])], prompts[r.story_id]
        if len(code) < 20:
            assert (r.similarity, r.quality, r.match_rate, r.bleu, r.rouge_l) == (None, 0, None, 0, 0)
            continue
        h, p = code.split(), prompt.split()
        assert r.bleu == pytest.approx(_bleu(p, h), abs=6e-5)
        row = [0] * (len(p) + 1)
        for x in h:
            last = 0
            for j, y in enumerate(p, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert r.rouge_l == pytest.approx(2 * row[-1] / (len(h) + len(p)), abs=6e-5)


def test_only_texts_travel_to_the_join_of_prompts(spark):
    variants = spark.createDataFrame([(1, "ABA000", "a b c d e f g h i j k l")], "story_id long, variant string, code string")
    stories = spark.createDataFrame([(1, "a b c d x f g h i j k l")], "story_id long, prompt string")
    plan = co.correspondence(variants, stories)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.index("Join ")], plan[plan.index("Join "):]
    assert "map_from_arrays" in above and "map_from_arrays" not in below and "split(" not in below


def _skewed(n=3000, seed=4):
    random.seed(seed)
    return [("hot", 7.0) for _ in range(n // 3)] + [
        (random.choice(["hot", "cold"]), float(random.choice([random.randint(0, 50), random.gauss(0, 30)]))) for _ in range(2 * n // 3)
    ]


def test_positions_quantiles_and_ranks_of_skewed_values(spark):
    rows = _skewed()
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    groups = collections.defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    at = value_positions(df, ["k"], "v", ranges=8).collect()
    assert len(at) == len(set(rows))
    for r in at:
        values = groups[r.k]
        assert (r.cnt, r.before, r.n) == (values.count(r.v), sum(x < r.v for x in values), len(values))
    for r in quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.25}).collect():
        assert r.m == pytest.approx(statistics.median(groups[r.k]))
        assert r.q == pytest.approx(statistics.quantiles(groups[r.k], n=4, method="inclusive")[0])
    ranked = rank_rows(value_positions(df, ["k"], "v"), ["k"], "v", chunk=100).collect()
    for k, values in groups.items():
        assert [r.v for r in sorted((r for r in ranked if r.k == k), key=lambda r: r.i)] == sorted(values)


def test_row_index_and_slices(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"))
    assert all(r.row_index == r.id + 1 for r in row_index(df, ["id"]).collect())
    assert sorted(r.id for r in readers.slice_rows(df, ["id"], 990, 5000).collect()) == list(range(990, 1000))
    assert readers.slice_rows(df, ["id"], 20, 10).count() == 1000


def test_salted_join_keeps_every_row(spark):
    many = spark.range(500).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    assert salted_join(many, one, ["k"], F.col("id")).count() == many.join(one, "k").count()
    assert salted_join(many, one, ["k"], F.col("id"), how="left").count() == 500
    for limit in (10, 1000):  # with a hot key and without
        assert even_join(many, one, ["k"], F.col("id"), limit).count() == many.join(one, "k").count()
        assert even_join(many, one, ["k"], F.col("id"), limit, how="left").count() == 500


def test_shapiro_published_vector_and_constants(spark):
    published = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [("p", float(v)) for v in published] + [("c", 3.0)] * 9 + [("two", 1.0), ("two", 2.0), ("three", 1.0), ("three", 2.0), ("three", 3.0)]
    got = {r.k: r for r in stats.shapiro(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert got["p"].w == pytest.approx(0.788815, abs=1e-6) and got["p"].shapiro_p == pytest.approx(0.006704, abs=1e-6)
    assert got["c"].shapiro_p == 1.0 and got["two"].w is None
    assert got["three"].w == pytest.approx(1.0) and got["three"].shapiro_p == pytest.approx(1.0, abs=1e-6)


def test_rank_sum_and_delta_against_brute_force(spark):
    random.seed(2)
    x = [random.randint(0, 9) for _ in range(40)]
    y = [random.randint(2, 11) for _ in range(25)]
    rows = [("k", True, float(v)) for v in x] + [("k", False, float(v)) for v in y]
    r = stats.rank_sum(spark.createDataFrame(rows, "k string, is_x boolean, value double"), ["k"], F.col("is_x")).first()
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert (r.nx, r.ny, r.u) == (40, 25, u)
    assert r.delta == pytest.approx(sum((a > b) - (a < b) for a in x for b in y) / 1000)
    small = [("k", True, 1.0), ("k", True, 2.0), ("k", False, 1.0), ("k", False, 1.0)]
    assert stats.rank_sum(spark.createDataFrame(small, "k string, is_x boolean, value double"), ["k"], F.col("is_x")).first().delta == 0.5


def test_pair_statistics_choose_the_test(spark):
    random.seed(1)
    rows = [("A1", f"X{i}", "intra", round(random.gauss(0.6, 0.05), 4)) for i in range(40)]
    rows += [("A1", f"Y{i}", "inter", round(random.gauss(0.5, 0.05), 4)) for i in range(40)]
    rows += [("B1", f"Z{i}", "intra", 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "a string, b string, kind string, jaccard double")
    got = {r.column: r for r in stats.pair_statistics(df, ["jaccard"]).collect()}
    x, y = ([v for a, _, k, v in rows if a == "A1" and k == kind] for kind in ("intra", "inter"))
    r = got["A1"]
    assert (r.n_all, r.n_intra, r.n_inter, r.model_group) == (80, 40, 40, "A1")
    pooled = math.sqrt((statistics.variance(x) + statistics.variance(y)) / 2)
    assert r.effect_size == pytest.approx((statistics.mean(x) - statistics.mean(y)) / pooled, abs=1e-6)
    assert r.z_stat == pytest.approx((statistics.mean(x) - statistics.mean(y)) / math.sqrt(statistics.variance(x) / 40 + statistics.variance(y) / 40), abs=1e-6)
    assert r.p_value < 0.001 and r.mwu_p < 0.001 and r.power > 0.9
    alone = got["B1"]
    assert alone.std_dev == 0.0 and alone.shapiro_p == 1.0 and alone.z_stat is None and alone.power is None


def test_constant_metric_against_the_centre(spark):
    df = spark.createDataFrame([("q", 80.0)] * 50, "metric string, value double")
    r = stats.metric_statistics(df).first()
    assert (r.mean, r.std_dev, r.shapiro_p, r.p_value, r.effect_size, r.mwu_p) == (80.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    assert r.z_stat == float("inf") and r.ci_low is None and r.power is None


def test_all_missing_feature_keeps_a_row(spark):
    df = spark.createDataFrame([("f", None), ("f", None), ("g", 50.0), ("g", 100.0)], "feature string, value double")
    got = {r.feature: r for r in stats.feature_moments(df, ["feature"]).collect()}
    assert got["f"].missing == 1.0 and got["f"].mean is None and got["f"].std_mean is None
    assert got["g"].mean == 0.75
    ranked = ranking.add_ranking(stats.feature_statistics(df, ["feature"]), "feature").collect()
    assert sorted(r.ranking for r in ranked) == [1, 2]


def test_recorded_selection_strata(spark):
    # ids 1..8 with ties across the first border
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.5, 0.5, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], 1)], "id long, score double")
    got = {r.id: r.stratum for r in selection.strata(df).collect()}
    assert [got[i] for i in range(1, 9)] == ["Low", "Low", "Medium", "Medium", "Medium", "Medium", "High", "High"]
    drawn = selection.stratified_sample(df)
    assert {r.stratum: r["count"] for r in drawn.groupBy("stratum").count().collect()} == {"Low": 2, "Medium": 4, "High": 2}


def test_blocks_and_names(spark):
    cells = [
        "x @startuml\nA\n@enduml y @STARTUML b @ENDUML", "plain", "@startuml only", "  ", None, "@startumlx @enduml",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, c string")
    got = {r.i: r.b for r in df.select("i", bl.blocks(F.coalesce(F.col("c"), F.lit(""))).alias("b")).collect()}
    assert got[0] == ["@startuml\nA\n@enduml", "@STARTUML b @ENDUML"]
    assert got[1] == ["@startuml\nplain\n@enduml\n"] and got[2] == ["@startuml only"]
    assert got[3] == [] and got[4] == [] and got[5] == ["@startumlx @enduml"]
    names = spark.createDataFrame([("a  b/c__d",), ("__",), ("é" * 3 + "x" * 80,)], "t string").select(bl.safe_name(F.col("t")).alias("n")).collect()
    assert [r.n for r in names] == ["a_b_c_d", "unknown", "x" * 49]


def test_prefix_match_collision(spark):
    files = spark.createDataFrame([("GBT001", "Row3_aa.jpg"), ("GBT001", "Row31_bb.jpg"), ("CLD001", "row3.jpg")], "folder string, file string")
    stems = spark.createDataFrame([("Row3",), ("Row31",), ("Row3",)], "stem string")
    got = sorted((r.stem, r.target) for r in bl.match_prefix(files, stems).collect())
    assert got == [("Row3", "GBT001 Row31_bb.jpg"), ("Row3", "GBT001 Row3_aa.jpg"), ("Row31", "GBT001 Row31_bb.jpg")]
    assert bl.match_prefix(files, stems, exact=True).count() == 2


def test_offered_prefixes_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([("a", "Row12_x.jpg"), ("b", "Row3_y.jpg")], "folder string, file string").write.parquet(str(tmp_path / "files"))
    spark.createDataFrame([(f"Row{i}",) for i in range(500)], "stem string").write.parquet(str(tmp_path / "stems"))
    found = bl.match_prefix(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "stems")))
    got = sorted((r.stem, r.target) for r in found.collect())
    assert got == [("Row1", "a Row12_x.jpg"), ("Row12", "a Row12_x.jpg"), ("Row3", "b Row3_y.jpg")]
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()


def test_supplied_encoder(spark):
    df = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string")
    got = {r.t: r.v for r in with_embedding(df, "t", lambda texts: [[float(len(t)), 1.0] for t in texts], "v").collect()}
    assert got == {"ab": [2.0, 1.0], None: [0.0, 1.0], "abcd": [4.0, 1.0]}
