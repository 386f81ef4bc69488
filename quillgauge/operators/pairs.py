"""Variant pairs of a story and their similarity.

Texts are tokenised once per variant, before the self-join; a pair is then compared from
the two rows the join brought together, in the JVM, except for the LCS of the edit ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions.counts import grams, matched, term_counts, total
from quillgauge.functions.numbers import np_round, py_round
from quillgauge.functions.sequences import text_lcs
from quillgauge.functions.text import WORD, WS, fence, let, long_words, strip

# Component weights, vocabulary limit of TF-IDF, and the Okapi parameters.
SIMILARITY_WEIGHTS = {"jaccard": 0.25, "levenshtein": 0.25, "tfidf": 0.30, "bm25": 0.10, "embedding": 0.10}
MAX_FEATURES = 8000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25


def pair_up(
    df: DataFrame, keys: list[str], carry: list[str], name: str = "variant", tile: int = 64, source: DataFrame | None = None
) -> DataFrame:
    """Unordered pairs of a story's variants: (keys, a, b, l, r) with a < b by name.

    ``l`` and ``r`` are structs of the ``carry`` columns. The pairs are the operator's
    result, so their number is quadratic in the variants of one story; variants are the
    columns of a report, which bounds it. Stories are counted inside the plan, from the key
    columns alone (of ``source``, the frame ``df`` was derived from); nothing runs before the
    result is used. Stories of up to ``tile`` variants are one self-join whose two sides share
    a single shuffle. Larger ones are cut into tiles by the hash of the name and joined tile by
    tile, so no task receives all pairs of a large story; without any, AQE drops that branch.
    """
    large = (
        (df if source is None else source).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > tile)
        .select(*keys, F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"))
    )
    rows = df.select(*keys, F.col(name).alias("a"), F.struct(*carry).alias("l"))
    few = rows.join(large.select(*keys), keys, "left_anti")
    joined = few.join(few.withColumnsRenamed({"a": "b", "l": "r"}), keys).filter(F.col("a") < F.col("b"))
    return joined.select(*keys, "a", "b", "l", "r").unionByName(_tiled_pairs(rows.join(large, keys), keys))


def _tiled_pairs(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of the rows (keys, a, l, _tiles) of large stories, tile by tile."""
    side = marked.select(
        *keys, F.col("a").alias("_name"), F.col("l").alias("_row"), "_tiles", F.pmod(F.xxhash64("a"), F.col("_tiles")).cast("int").alias("_tile")
    )
    left = side.select(
        *keys, F.col("_name").alias("_ln"), F.col("_row").alias("_lr"), F.col("_tile").alias("_ti"),
        F.explode(F.sequence("_tile", F.col("_tiles") - 1)).alias("_tj"),
    )
    right = side.select(
        *keys, F.col("_name").alias("_rn"), F.col("_row").alias("_rr"), F.col("_tile").alias("_tj"),
        F.explode(F.sequence(F.lit(0), F.col("_tile"))).alias("_ti"),
    )
    joined = left.join(right, [*keys, "_ti", "_tj"]).filter(
        (F.col("_ti") < F.col("_tj")) | (F.col("_ln") < F.col("_rn"))
    )
    ordered = F.col("_ln") < F.col("_rn")
    return joined.select(
        *keys,
        F.least("_ln", "_rn").alias("a"),
        F.greatest("_ln", "_rn").alias("b"),
        F.when(ordered, F.col("_lr")).otherwise(F.col("_rr")).alias("l"),
        F.when(ordered, F.col("_rr")).otherwise(F.col("_lr")).alias("r"),
    )


def activity_tokens(text: Column) -> Column:
    """Words of two characters and more inside ``:...;`` spans, else those of the whole text."""
    inside = F.regexp_extract_all(F.lower(text), F.lit(f":[{WS}]*([^;]+);"), F.lit(1))
    return let(
        long_words(F.array_join(inside, " ")), lambda t: F.when(F.size(t) > 0, t).otherwise(long_words(text))
    )


def _when_empty(left: Column, right: Column, otherwise: Column) -> Column:
    """1 when both sides are empty, 0 when one is."""
    return F.when((left == 0) & (right == 0), 1.0).when((left == 0) | (right == 0), 0.0).otherwise(otherwise)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of distinct tokens."""
    shared = F.size(F.array_intersect(left, right))
    return _when_empty(F.size(left), F.size(right), shared / (F.size(left) + F.size(right) - shared))


def edit_ratio(left: Column, right: Column) -> Column:
    """Indel ratio 2 LCS / (len1 + len2) of two stripped texts."""
    size = F.length(left) + F.length(right)
    return _when_empty(F.length(left), F.length(right), text_lcs(left, right) * 2.0 / F.when(size > 0, size))


def tfidf_cosine(left: Column, right: Column, limit: int | None = None) -> Column:
    """Cosine of the TF-IDF vectors fitted on just the two texts, from their term counts.

    The smooth idf of a shared term is 1, of any other 1 + ln 1.5, so only the shared terms
    and the two sums of squares are needed. Null when neither text has a term. ``limit`` keeps
    only that many of the most frequent terms of the two texts (``MAX_FEATURES`` is the usual one).
    """
    rare = F.lit((1.0 + 0.4054651081081644) ** 2)

    def score(lc: Column, rc: Column, both: Column) -> Column:
        sums = F.aggregate(
            both,
            F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
            lambda s, v: F.struct(
                (s["xy"] + v["l"] * v["r"]).alias("xy"), (s["xx"] + v["l"] * v["l"]).alias("xx"),
                (s["yy"] + v["r"] * v["r"]).alias("yy"),
            ),
        )

        def cosine(s: Column) -> Column:
            left_norm = s["xx"] + rare * (total(F.transform(lc, lambda v: v * v)) - s["xx"])
            right_norm = s["yy"] + rare * (total(F.transform(rc, lambda v: v * v)) - s["yy"])
            norm = F.sqrt(left_norm) * F.sqrt(right_norm)
            return F.when(norm > 0, s["xy"] / F.when(norm > 0, norm)).otherwise(0.0)

        return let(sums, cosine)

    whole = score(F.map_values(left), F.map_values(right), matched(left, right))

    def limited(kept: Column) -> Column:
        return score(
            F.transform(kept, lambda e: e["l"]),
            F.transform(kept, lambda e: e["r"]),
            F.filter(kept, lambda e: (e["l"] > 0) & (e["r"] > 0)),
        )

    entries = F.map_values(
        F.map_zip_with(
            left, right,
            lambda k, a, b: F.struct(
                (-(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))).alias("order"), k.alias("term"),
                F.coalesce(a, F.lit(0)).alias("l"), F.coalesce(b, F.lit(0)).alias("r"),
            ),
        )
    )
    if limit is None:
        return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(None).cast("double")).otherwise(whole)
    # the vocabulary limit can only bind when the two texts have that many terms together
    big = F.size(left) + F.size(right) > limit
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(None).cast("double")).otherwise(
        F.when(big, let(F.slice(F.sort_array(entries), 1, limit), limited)).otherwise(whole)
    )


def vector_cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when one is missing or zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
        )

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return let(norm, lambda n: F.coalesce(F.when(n > 0, dot(left, right) / F.when(n > 0, n)), F.lit(0.0)))


def bm25_weights(variants: DataFrame, ids: list[str], tokens: str) -> DataFrame:
    """Per variant a map token -> (tf, w): its count and its Okapi weight over the whole corpus.

    Document frequencies come from one combined aggregate. The idf is joined back by token, with
    nothing but an aggregate above, so Spark splits the postings of a token that occurs everywhere.
    """
    counted = fence(variants.select(*ids, F.size(tokens).alias("_dl"), tokens), {"_counts": term_counts(F.col(tokens))})
    postings = counted.select(*ids, "_dl", F.explode("_counts").alias("token", "tf"))
    docs = variants.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    raw = frequency.withColumn("idf", F.ln(docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    # one subquery over the combined counts: mean document length and the floor of the idf
    facts = raw.agg(
        F.struct((F.sum("cf") / docs).alias("avgdl"), (F.avg("idf") * BM25_EPSILON).alias("floor")).alias("s")
    ).scalar()
    idf = raw.select("token", F.when(F.col("idf") < 0, facts["floor"]).otherwise(F.col("idf")).alias("idf"))
    average = facts["avgdl"]
    joined = postings.join(idf, "token")
    length = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_dl") / average)
    weight = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + length)
    # one variant's own tokens: bounded by its text
    return joined.groupBy(*ids).agg(
        F.map_from_entries(
            F.collect_list(F.struct("token", F.struct(F.col("tf"), weight.alias("w")).alias("v")))
        ).alias("bm25_map")
    )


def bm25_similarity(left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Two-way BM25 of a pair, clamped to 0..1."""

    def combine(both: Column) -> Column:
        forth = total(F.transform(both, lambda v: v["l"]["tf"] * v["r"]["w"]))
        back = total(F.transform(both, lambda v: v["r"]["tf"] * v["l"]["w"]))
        return let(
            F.struct(forth.alias("x"), back.alias("y")),
            lambda s: F.greatest(
                F.lit(0.0),
                F.least(F.lit(1.0), (s["x"] + s["y"]) / (2.0 * F.greatest(s["x"], s["y"], F.lit(1e-9)))),
            ),
        )

    return _when_empty(left_size, right_size, let(matched(left, right), combine))


def bm25_of_pair(left_size: Column, right_size: Column) -> Column:
    """Two-way BM25 whose corpus is just the pair: 1 when both texts are empty, else 0.

    A token of one of two texts has the idf ln(1.5 / 1.5) = 0, a shared one a negative idf, for which
    a quarter of the mean idf stands, negative too. No score is above 0, so the clamp gives 0.
    """
    return _when_empty(left_size, right_size, F.lit(0.0))


def mean_of(components: list[Column]) -> Column:
    """Mean of the components that are not null."""
    present = F.filter(F.array(*components), lambda v: v.isNotNull())
    return let(present, lambda p: F.when(F.size(p) > 0, total(p) / F.size(p)))


def weighted_mean(components: dict[str, Column], weights: dict[str, float] = SIMILARITY_WEIGHTS) -> Column:
    """Weighted mean, renormalised over the components that are not null."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, value in components.items():
        top = top + F.coalesce(value * F.lit(weights[name]), F.lit(0.0))
        bottom = bottom + F.when(value.isNotNull(), F.lit(weights[name])).otherwise(0.0)
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom))


def pair_similarity(
    variants: DataFrame,
    within: tuple[str, ...] = ("story_id", "model_group"),
    metrics: tuple[str, ...] = ("jaccard", "levenshtein", "tfidf", "bm25"),
    vector: str | None = None,
    code: str = "code",
    limit: int | None = None,
    bm25_corpus: str = "all",
) -> DataFrame:
    """Similarity of every pair inside ``within``: the components, their mean and weighted mean.

    Null code counts as empty. ``vector`` names a supplied embedding column. ``bm25_corpus`` is
    ``all`` (document frequencies of the whole table) or ``pair`` (of the two texts alone).
    """
    if bm25_corpus not in ("all", "pair"):
        raise ValueError(f"bm25_corpus must be 'all' or 'pair', not {bm25_corpus!r}")
    text = F.coalesce(F.col(code), F.lit(""))
    extra = [vector] if vector else []
    base = variants.select("story_id", "model_group", "variant", text.alias("_code"), *extra)
    base = fence(base, {"_tokens": activity_tokens(F.col("_code"))})
    columns = {"_text": strip(F.col("_code")), "_set": F.array_distinct("_tokens"), "_nt": F.size("_tokens")}
    if "tfidf" in metrics:
        columns["_terms"] = let(
            long_words(F.col("_code")), lambda t: term_counts(F.concat(grams(t, 1), grams(t, 2)))
        )
    ready = fence(base, columns)
    carry = ["model_group", *columns, *extra]
    if "bm25" in metrics and bm25_corpus == "all":
        ids = ["story_id", "variant"]
        # unique on both sides, so the join back has no hot key
        ready = ready.join(bm25_weights(base, ids, "_tokens"), ids, "left").withColumn(
            "_bm25", F.coalesce("bm25_map", F.create_map().cast("map<string,struct<tf:int,w:double>>"))
        )
        carry.append("_bm25")
    carry = [c for c in carry if c not in within]
    pairs = pair_up(ready.drop("_code", "_tokens"), list(within), carry, source=variants)

    def of(side: str, column: str) -> Column:
        return F.col(f"{side}.{column}")

    values: dict[str, Column] = {}
    if "jaccard" in metrics:
        values["jaccard"] = jaccard(of("l", "_set"), of("r", "_set"))
    if "levenshtein" in metrics:
        values["levenshtein"] = edit_ratio(of("l", "_text"), of("r", "_text"))
    if "tfidf" in metrics:
        values["tfidf"] = tfidf_cosine(of("l", "_terms"), of("r", "_terms"), limit)
    if "bm25" in metrics and bm25_corpus == "pair":
        values["bm25"] = bm25_of_pair(of("l", "_nt"), of("r", "_nt"))
    elif "bm25" in metrics:
        values["bm25"] = bm25_similarity(of("l", "_bm25"), of("r", "_bm25"), of("l", "_nt"), of("r", "_nt"))
    if vector:
        values["embedding"] = (vector_cosine(of("l", vector), of("r", vector)) + 1.0) / 2.0
    groups = [] if "model_group" in within else [of("l", "model_group").alias("group_a"), of("r", "model_group").alias("group_b")]
    scored = pairs.select(*within, "a", "b", *groups, *[v.alias(f"_{n}") for n, v in values.items()])
    components = {n: F.col(f"_{n}") for n in values}
    combined = scored.withColumns(
        {"_mean": mean_of(list(components.values())), "_weighted": weighted_mean(components)}
    )
    return combined.select(
        *within, "a", "b", *[c for c in ("group_a", "group_b") if c in combined.columns],
        *[py_round(F.col(f"_{n}"), 4).alias(n) for n in values],
        np_round(F.col("_mean"), 4).alias("mean"),
        py_round(F.col("_weighted"), 4).alias("weighted"),
    )


def with_cross_group(similarity: DataFrame, variants: DataFrame, metrics: list[str]) -> DataFrame:
    """Every pair of a story; pairs of different groups keep null metrics (opt-in report form)."""
    everything = pair_up(variants.select("story_id", "model_group", "variant"), ["story_id"], ["model_group"]).select(
        "story_id", "a", "b", F.col("l.model_group").alias("group_a"), F.col("r.model_group").alias("group_b")
    )
    return everything.join(similarity.select("story_id", "a", "b", *metrics), ["story_id", "a", "b"], "left")


def label_pairs(pairs: DataFrame) -> DataFrame:
    """``intra`` for pairs of one group, ``inter`` for the others."""
    return pairs.withColumn("kind", F.when(F.col("group_a") == F.col("group_b"), "intra").otherwise("inter"))


def pairs_to_columns(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Each pair counts for both of its variants: one row per (column, pair)."""
    return pairs.select(*keep, "a", "b", F.explode(F.array("a", "b")).alias("column"))
