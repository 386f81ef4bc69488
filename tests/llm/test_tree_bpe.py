"""Encoding in halves against the library on whole texts."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillgauge.llm import queries, tree_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, row string, key string, part string, body string"
PIECES = [
    "the ", "'s", "'", "'ll", "''", "!'", "'re", "'ve ", "l", "ll", "s", "e", "re", "ama", "É", "é", "é", "ß", "̈", "日本語", "ｱ",
    "１２", "٣", "½", "123", " ", "\n\n", "\t", "\xa0", "　", "!!!", "'''", "...", "===", "-", "🙂", "👨‍👩‍👧", "Straße", "Σς", "İ", "ǅ", "</w>", "<|x|>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return tree_bpe.Vocabulary(PATH)


def odd_text(rng, n):
    kind = rng.random()
    if kind < 0.6:
        return "".join(rng.choice(PIECES) for _ in range(n))
    if kind < 0.8:
        few = rng.sample(PIECES, 3)
        return "".join(rng.choice(few) for _ in range(n))
    alphabet = rng.choice(["ab", "a", "ea", "nthe", "'", "!'", "'l", "日本", "é", "tionsing"])
    return "".join(rng.choice(alphabet) for _ in range(n * 9))


def by_tree(words, text, leaf):
    ids = []
    for part, special in words.sections(text):
        if special is not None:
            ids.append(special)
        elif part:
            ids += tree_bpe.tree(words, words.halves(tree_bpe.cuts(part, leaf))).ids.tolist()
    return ids


@pytest.mark.parametrize("long_word", [24, 64])
def test_tree_equals_library(words, library, long_word, monkeypatch):
    monkeypatch.setattr(tree_bpe, "LONG_WORD", long_word)
    rng = random.Random(long_word)
    for _ in range(2500):
        text = odd_text(rng, rng.randint(1, 60))
        if rng.random() < 0.1:
            text = text + "<|endoftext|>" + text + "<|startoftext|>"
        leaf = rng.choice([1, 2, 3, 5, 8, 17, 40])
        assert by_tree(words, text, leaf) == library.encode(text, add_special_tokens=False).ids, (text, leaf)


def test_windows_stay_small(words, library, monkeypatch):
    """A word of 300,000 letters: joins look at a few tokens, not at the word."""
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    halves = words.halves(tree_bpe.cuts(text, 4096))
    seen, plain = [], words.window
    monkeypatch.setattr(words, "window", lambda t, goes_on: (seen.append(len(t)), plain(t, goes_on))[1], raising=False)
    got = tree_bpe.tree(words, halves).ids
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(seen) < 600 and len(seen) < 6 * len(halves)


def test_query(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "DECODE_BLOCK", 5000)
    rng = random.Random(4)
    texts = [None, "", " \n", "One two <|endoftext|>three", *[odd_text(rng, rng.randint(1, 400)) for _ in range(60)]]
    texts += ["".join(rng.choice("abcdefgh 'é日!") for _ in range(70_000)), "x" * 50_000, " " * 40_000, "<|endoftext|>" * 3000, "a b" * 9000]
    texts += [texts[-1], texts[-1]]
    rows = [(i // 2, t, "i", "r", "k", "p", "b") for i, t in enumerate(texts)] + [(None, texts[-5], *"irkpb"), (7, texts[9], *"irkpb")]
    rows += [rows[-1], (33, texts[-1], *"irkpb"), (33, texts[-1], *"irkpb")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_tree_bpe"](spark, str(tmp_path)).collect()
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tree_bpe.decode_ids(tree_bpe.encode_texts(none, PATH), PATH).collect() == []
    one = spark.createDataFrame([(1, "A b", *"irkpb")], SCHEMA)
    row = tree_bpe.decode_ids(tree_bpe.encode_texts(one, PATH), PATH, into="ids").collect()[0]
    assert row.row.ids == "i" and row.row.part == "p" and row.ids == "a</w> b</w>" and row.n_tokens == 2
    with pytest.raises(ValueError):
        tree_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_tasks_hold_little_beside_their_texts(words, monkeypatch):
    monkeypatch.setattr(tree_bpe, "lasting", lambda kind, path: words if kind is tree_bpe.Vocabulary else kind(path))
    texts = [" ".join(f"w{(i * 31 + k) % 5000}" for k in range(400)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([{"doc_id": i} for i in range(len(texts))]), pa.array(texts)], names=["row", "body"])
    list(tree_bpe._encode_short(iter([batch.slice(0, 200)]), PATH))  # the library's own tables are there before
    tracemalloc.start()
    encoded = [part.column("ids") for part in tree_bpe._encode_short(iter([batch]), PATH)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = pa.chunked_array(encoded).combine_chunks()
    assert len(ids) == len(texts) and peak < 50e6
    monkeypatch.setattr(tree_bpe, "lasting", lambda kind, path, made=tree_bpe.Decoder(PATH): made)
    tracemalloc.start()
    rows = sum(part.num_rows for part in tree_bpe._decode(iter([pa.RecordBatch.from_arrays([batch.column("row"), ids], names=["row", "seq"])]), PATH))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 20e6
