"""The trie against a dictionary of prefixes, with borders of partitions anywhere."""

import random

import numpy as np
import pytest

from quillgauge.llm import prefix_trie, queries
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, node string, ids string, a string, first string"


def rows_of(rng, n, words):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, 10)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(words), "x", "y", "z", "f"))
    return rows


@pytest.mark.parametrize("n,words,parts", [
    (60, ["a", None, "éé"], 1), (300, ["a", "b"], 3), (300, ["a"], 9), (80, [f"w{i}" for i in range(50)], 40), (1, ["a"], 2), (4, ["a"], 30),
])
def test_query(spark, tmp_path, n, words, parts):
    rng = random.Random(n + parts)
    rows = rows_of(rng, n, words)
    rows += rows[:3] + [(None, 1, "user", "a", *"xyzf"), (-3, 1, "user", "a", *"xyzf"), (-5, 1, "user", "b", *"xyzf")]
    rows += [(c, t, "user", "same", *"xyzf") for c in range(10_000, 10_000 + 10 * n, 5) for t in range(3)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = [tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = brute.trie([r[:4] for r in rows])
    order = lambda r: (r[1], r[0], r[3:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_chunks_of_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", "same", *"xyzf") for c in range(0, 500, 5) for t in range(2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(brute.trie([r[:4] for r in rows]), key=lambda r: r[:2])


def test_extents():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 4, n)
        table = prefix_trie.SparseTable(values)
        start, floor = rng.integers(0, n, 200), rng.integers(0, 4, 200)
        for s, f, left, right in zip(start, floor, table.left(start, floor), table.right(start, floor)):
            r = s
            while r + 1 < n and values[r + 1] >= f:
                r += 1
            p = s
            while p > 0 and values[p] >= f:
                p -= 1
            assert (left, right) == (p, r)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect() == []
