"""The pipeline against a plain version of its stages, and the registered queries on the smallest tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillgauge.llm.quality import MEASURES
from quillgauge.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_operators import sentence

FOLDER = "/root/testdata/sf0.001"


def measures(text):
    w = brute.words(text)
    n, chars, symbols, dup, _ = brute.counts(text)
    lines = sum(1 for x in text.split("\n") if brute.WORD.search(x))
    capitals = sum("A" <= c <= "Z" for c in text)
    echo = sum(a == b for a, b in zip(w, w[1:]))
    counts = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": lines, "n_echo_words": echo, "n_capitals": capitals}
    return counts, {
        "symbol_rate": 1000 * symbols // max(chars, 1), "word_length": 100 * chars // max(n, 1), "dup_line_rate": 1000 * dup // max(lines, 1),
        "echo_rate": 1000 * echo // max(n, 1), "capital_rate": 1000 * capitals // max(chars, 1),
    }


def fails_base(text):
    n, _, _, _, repeated = brute.counts(text)
    return n < 20 or 100 * repeated > 30 * n


def good(rows):
    """Ids of (id, text, lang, source) rows that pass the rules."""
    sound = [(r, *measures(r[1])) for r in rows if not fails_base(r[1] or "")]

    def fences(part):
        out = {}
        for m in MEASURES:
            values = sorted(v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0) for v in (x[2][m] for x in part))
            q1, q3 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            out[m] = max(q3 + 3 * (q3 - q1), sum(values) / len(values)), max(q1 - 3 * (q3 - q1), 0)
        return out

    keep = set()
    for row, counts, _ in sound:
        own = [x for x in sound if x[0][2:4] == row[2:4]]
        lang = [x for x in sound if x[0][2] == row[2]]
        limits = fences(own if len(own) >= 100 else lang if len(lang) >= 100 else sound)
        for m, (count, size, unit, low) in MEASURES.items():
            most, least = (x * counts[size] / unit for x in limits[m])
            if counts[count] > most + 4 * (most + 1) ** 0.5 or low and counts[count] < least - 4 * (least + 1) ** 0.5:
                break
        else:
            keep.add(row[0])
    return keep


def clean(text):
    for _ in range(2):
        out, at = "", 0
        spans = brute.base_spans(text)
        for span in spans.split(",") if spans else []:
            kind, a, b = span.split(":")
            if int(b) > at:
                out += text[at : max(int(a), at)] + ("" if int(a) < at else f"[{kind.upper()}]")
                at = int(b)
        text = out + text[at:]
    return text


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, sentence(rng, rng.randint(20, 50))) for i in range(6)]
    rows = []
    for i in range(260):
        text = sentence(rng, rng.randint(5, 90))
        if i % 11 == 0:
            text += " # $ %" * 40
        if i % 13 == 0:
            text = "\n".join(["the same line again"] * 30)
        if i % 17 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or "x"
            w = text.split(" ")
            w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        if i % 19 == 0:
            text = sentence(rng, 30) + "\n" + items[i % 6][1].upper() + "\n" + sentence(rng, 30)
        if i % 7 == 0:
            text += f" mail x{i}@mail.example.com or +1 (649) 555-{1000 + i}, 10.0.0.{i % 256} 4111 1111 1111 1111"
        rows.append((i, None if i == 50 else text, rng.choice(["en", "en", "de"]), rng.choice(["a", "b"]), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_pipeline_equals_plain_version(spark, tables):
    folder, rows, items = tables
    got = corpus_pipeline.run(spark, folder).collect()
    keep = good(rows)
    left = [r for r in rows if r[0] in keep]
    pairs = [(r[0], r[1]) for r in left]
    left = [r for r, c in zip(left, brute.classes(pairs, 5, 80)) if r[0] == c]
    patterns = [brute.plain(t) for _, t in items]
    left = [r for r in left if all(brute.edit_distance_in(p, brute.plain(r[1])) > len(p) * 20 // 100 for p in patterns)]
    assert len(left) < len(pairs) < len(rows)
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in left:
        ids = tokens.encode(clean(r[1]), add_special_tokens=False).ids + [1]
        want += [(r[0], i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 4096 and sorted(parts)[0][0] == 0 for parts in filled.values())


def test_stages_on_empty_tables_and_odd_columns(spark, tables, tmp_path):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' as kept", "1 as node", "'y' as spans", "doc_id as id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for part in (docs.limit(0), docs.filter("doc_id < 12")):
            out = stage(spark, part, folder)
            assert out.columns == docs.columns and out.count() <= 12, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_queries_run(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert len(set(rows.columns)) == len(rows.columns)
    assert rows.count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
