"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.llm import decontaminate, jaccard, licenses, main_text, packing, pii, prefix_trie, quality, substrings, token_files, tree_bpe, turn_repair, warc
from quillgauge.llm.files import work_folder
from quillgauge.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_warc", """
    with p as (
        select page_id, coalesce(html, '') as h from pages
    ), f as (
        select h, min(page_id) as first_id from p where octet_length(encode(h)) >= 100 group by h
    )
    select p.page_id, octet_length(encode(p.h))::bigint as payload_bytes, sha256(p.h) as payload_digest,
        case when f.first_id < p.page_id then 'revisit' else 'response' end as record_type,
        case when f.first_id < p.page_id then f.first_id end as refers_to
    from p left join f on f.h = p.h
""")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = materialize(warc.write_warc(warc.revisits(pages), work_folder(spark, "warc")))
    records = warc.read_warc(spark, files, with_payload=False)
    key = pages.schema["page_id"].dataType.simpleString()

    def page(name: str):
        return F.substring_index(F.substring_index(name, "<urn:x-record:", -1), ">", 1).cast(key)

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


@query("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op4_license_notices")
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


@query("op5_private_spans")
def private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in pii.KINDS]
    base = pii.joined(f"filter(spans, s -> s.kind <> '{pii.TERM}')")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query("op6_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.duplicate_factors(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_main_text")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.main_text(table(spark, sf_dir, "pages"), into="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_token_files")
def packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(
        docs, work_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    rows = token_files.read_token_files(spark, manifest, docs.schema["doc_id"].dataType)
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_turn_repair")
def turn_repair_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = turn_repair.repair_digest(turn_repair.repaired_turns(turn_repair.damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op12_tree_bpe")
def tree_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = tree_bpe.encode_texts(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    decoded = tree_bpe.decode_ids(encoded, path)
    return decoded.select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_prefix_trie")
def prefix_trie_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.ends_digest(*prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))))
