"""Each operator against a plain version, on small tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgauge.llm import decontaminate, jaccard, licenses, main_text, packing, pii, quality, substrings, token_files, warc
from quillgauge.llm.arrays import lasting, slices
from quillgauge.llm.files import make_folder
from quillgauge.llm.tokens import PieceEncoder, encoder
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, id string, counts long, node long, marks string"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta tion ing The of on a é ñandú reed 日本".split()) + str(rng.randint(0, 60)) for _ in range(n))


def messy_rows(seed=1):
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated ids and personal data."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 150)) for _ in range(25)]
    passage = sentence(rng, 70)
    texts = [None, "", " \n\t ", "one", "One TWO three", *base, base[0], base[0], base[3].upper(), sentence(rng, 6000)]
    for text in base[:12]:
        w = text.split(" ")
        for edits in (1, 4):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = f"edit{rng.randint(0, 9)}"
            texts.append(" ".join(v))
        texts.append(text + "\n" + passage + "\nlast " + rng.choice(base[:3]))
    texts += ["write a.b@c.de or +1 (649) 555-1648, 10.0.0.256, 10.0.0.255 4111 1111 1111 1111 🙂 x@y.z", "line\nline\nline\n" * 9, "*** # " * 30]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None, "k", "s", "i", 5, 7, "m") for i, t in enumerate(texts)]
    rows += [rows[9], rows[10], (10, base[5], "en", "a", 1, None, None, None, None, None, None), (None, base[1], "en", "a", 1, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return messy_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x) for x in row)


def test_encoder_equals_library():
    rng = random.Random(1)
    alphabet = list("abcXYZ  \n\t\r.,!'’é ñÑß×÷Ωςσ日本　\xa0\x85\x1c 123 sť́JI🙂​") + ["'s", "'S", "<|endoftext|>", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["", " ", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        plain.encode_special_tokens = True
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        got, encoder = [], PieceEncoder(public_tokenizers.path(name))
        for part in slices(pa.array(texts), limit=3000):
            ids, counts = encoder.encode(part)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    for bits in (1, 3, 8, 13, 16, 17, 31, 32):
        for n in (0, 1, 7, 1000):
            ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
            assert (token_files.unpack(token_files.pack(ids, bits), bits, n) == ids).all()
            assert len(token_files.pack(ids, bits)) == (n * bits + 7) // 8


def test_token_files(spark, docs, rows, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    folder = f"file://{tmp_path}/tokens"
    make_folder(folder)
    manifest = token_files.write_token_files(docs, folder, path, 0)
    got = token_files.read_token_files(spark, manifest, docs.schema["doc_id"].dataType, docs_per_task=7)
    got = sorted(got.collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""))):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r.id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    empty = token_files.write_token_files(none, folder, path, 0)
    assert token_files.read_token_files(spark, empty, docs.schema["doc_id"].dataType).collect() == []


def test_packing(docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=64).collect()
    want = []
    for row in rows:
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids + [1]
        want += [(row[0], i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())) for i in range(0, len(ids), 64)]
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) <= 1.1 * sum(r.length for r in got) / 64 + 1
    assert packing.pack_documents(none, path).collect() == []


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        histogram = {rng.randint(1, 40): rng.randint(0, 50) for _ in range(12)}
        plan, opened = packing.plan_slots(histogram, 40)
        places = {}
        for length, rank, n, sequence, offset in zip(*(plan[c].tolist() for c in ("length", "rank", "n", "sequence", "offset"))):
            for i in range(n):
                places.setdefault(length, {})[rank + i] = 1
                places.setdefault(("s", sequence + i), []).append((offset, length))
        assert {k: len(v) for k, v in places.items() if not isinstance(k, tuple)} == {k: n for k, n in histogram.items() if n}
        room = []
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):  # best fit, one by one
            fits = [i for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= length
            else:
                room.append(40 - length)
        assert opened == len(room)


def test_quality(docs, rows, none):
    got = quality.judge_documents(docs, keep=["doc_id", "text"]).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.counts[c] for c in names) == brute.counts(r.text)
        assert r.base_failed == (r.counts.n_words < 20 or 100 * r.counts.n_repeat_words > 30 * r.counts.n_words)
        assert not (r.base_failed and r.kept)
    symbols = next(r for r in got if (r.text or "").startswith("*** #"))
    assert not symbols.kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=key) == sorted(((r.doc_id, r.text) for r in got if r.kept), key=key)
    assert quality.keep_good(none).collect() == [] and quality.judge_documents(none).collect() == []


def test_limits_follow_the_stratum(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 60) + (" # $" if i % 2 else ""), "en", "s") for i in range(150)] + [(999, sentence(rng, 60) + " # $" * 30, "en", "s")]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(150))


def test_limits_of_a_source_are_its_own(spark):
    """A source rich in symbols keeps its texts, where its language has none; few bad texts do not raise its limit to theirs."""
    rng = random.Random(15)

    def cells(n):
        return " ".join(f"{w} |" for w in sentence(rng, n).split(" "))

    rows = [(i, sentence(rng, 60), "en", "prose") for i in range(800)]
    rows += [(1000 + i, cells(rng.randint(40, 50)) + sentence(rng, 20), "en", "tables") for i in range(150)]
    rows += [(2000 + i, cells(50), "en", "prose") for i in range(30)]
    rows += [(3000 + i, cells(50), "en", "few") for i in range(20)]
    rows += [(4000, sentence(rng, 25) + " *", "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert {d for d in kept if d < 2000} == {r[0] for r in rows if r[0] < 2000}
    assert not {d for d in kept if 2000 <= d < 4000} and 4000 in kept


INTERNAL = [
    "_lang", "_source", "symbol_rate_high", "word_length_low", "_limits_", "_quality_counts_", "_quality_kept_", "_text_", "_lowered_text_", "_body", "_base",
    "_key", "_more", "_near", "_terms", "_one", "_row", "_private_spans_", "_private_once_", "_private_rest_", "_host_", "_HTML_", "_low_", "row", "body",
]


def test_columns_named_like_internal_ones(spark, docs):
    """Columns that an operator would use itself come through as they were."""
    extra = [F.lit(f"user {c}").alias(c) for c in INTERNAL]
    wide = docs.select("doc_id", "text", "lang", "source", *extra)
    bench = spark.createDataFrame([(1, "nothing of this kind is anywhere in these texts at all")], "item_id long, text string")
    for got in (quality.keep_good(wide), decontaminate.drop_leaking(wide, bench), pii.sanitised(wide), jaccard.one_of_each_class(wide)):
        assert got.columns == wide.columns
        found = got.collect()
        assert found and all(r[c] == f"user {c}" for r in found for c in INTERNAL)
    spans = pii.private_spans(wide).collect()
    assert len(spans) == wide.count() and all(r[c] == f"user {c}" for r in spans for c in INTERNAL)
    judged = quality.judge_documents(wide.withColumn("kept", F.lit("mine")), keep=["doc_id", "kept", "_lang"])
    assert judged.columns.count("kept") == 1 and {r._lang for r in judged.collect()} == {"user _lang"}
    assert substrings.duplicate_factors(wide).count() == wide.count()
    pages = spark.createDataFrame([(1, "http://h/x", "<article><p>one</p></article>")], "page_id long, url string, html string").select("*", *extra)
    found = main_text.main_text(pages).collect()
    assert [r.main_text for r in found] == ["one"] and all(r[c] == f"user {c}" for r in found for c in INTERNAL)


def test_jaccard(docs, rows, none, monkeypatch):
    for words, percent in ((4, 85), (5, 80)):
        pairs = [(r[0], r[1]) for r in rows]
        want = [(d, len(brute.shingles(t, words)), c if brute.shingles(t, words) else d) for (d, t), c in zip(pairs, brute.classes(pairs, words, percent))]
        for group in (16, 1):  # a group bound of one sends everything the way of large groups
            monkeypatch.setattr(jaccard, "GROUP", group)
            got = [tuple(r)[:3] for r in jaccard.similar_classes(docs, words, percent).collect()]
            assert sorted(got, key=key) == sorted(want, key=key)
    monkeypatch.undo()
    assert jaccard.similar_classes(none).collect() == []
    one = jaccard.one_of_each_class(docs)
    assert one.columns == docs.columns
    ids = [r.doc_id for r in one.collect()]
    component = {d: c if brute.shingles(t, 5) else d for (d, t), c in zip(pairs, brute.classes(pairs, 5, 80)) if d is not None}
    assert set(ids) - {None} == {d for d, c in component.items() if d == c}


def test_families_of_near_copies(spark):
    """Many members of which few are similar to one another; links only through some of them."""
    rng = random.Random(6)
    base = sentence(rng, 120).split(" ")
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(zip(range(80), brute.classes(rows, 4, 85)))


def test_every_link_is_counted(spark, monkeypatch):
    rng = random.Random(15)
    base = sentence(rng, 120).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (102, None), (103, ""), (104, "alone"), (105, "two"), (106, "TWO")]
    sets = [brute.shingles(t, 4) for _, t in rows]
    want = {d: sum(i != j and bool(a & b) and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)) for i, ((d, _), a) in enumerate(zip(rows, sets))}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for tile in (64, 7):
        monkeypatch.setattr(jaccard, "TILE", tile)
        assert {r.doc_id: r.n_links for r in jaccard.similar_classes(table, 4, 85).collect()} == want
    left, right = [np.array([1, 5, 9], np.uint64), np.array([2], np.uint64)], [np.array([5, 9, 11], np.uint64)]
    assert jaccard._common(left, right, columns=1).tolist() == [[2], [0]]


def test_pairs_of_a_family_grow_with_its_sets(spark, monkeypatch):
    rng, n, rows, seen = random.Random(5), 500, [], []
    base = [f"w{i}" for i in range(150)]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(base)), rng.randint(0, 6)):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    verified = jaccard._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    sets = [{tuple(text.split()[k : k + 4]) for k in range(147)} for _, text in rows]
    links = {i: [j for j in range(n) if j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] for i in range(n)}
    lowest = {i: i for i in links}
    for _ in range(20):
        lowest = {i: min([lowest[i], *(lowest[j] for j in links[i])]) for i in links}
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (lowest[i], len(links[i])) for i in links}
    assert sum(map(len, links.values())) / 2 > 30 * n and sum(seen) < 10 * n, seen


def test_signatures_lose_no_pair():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.choice([2, 3, 5, 7, 8, 10, 12, 15, 20, 30, 60, 100, 300])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 10))):
            if rng.random() < 0.6 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            if rng.random() > 0.3:
                b.add(rng.getrandbits(64))
        if a == b or 100 * len(a & b) < 85 * len(a | b):
            continue
        found, owner, sure = jaccard.signatures(np.array(sorted(a) + sorted(b), np.uint64), np.array([len(a), len(b)]), 85)
        shared = set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())
        assert shared and len(shared) >= max(sure)


def test_licenses(docs, spark, none):
    apache, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT (line)"]
    rng = random.Random(8)
    edited = apache.split(" ")
    edited[3] = "changed"
    rows = [(1, sentence(rng, 200) + "\n" + apache.upper() + "\n" + sentence(rng, 90)), (2, mit), (3, "x " + " ".join(edited)), (4, apache[: len(apache) // 2]), (5, None)]
    got = licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "Apache-2.0"), (1, "Apache-2.0 (line)"), (2, "MIT (line)"), (3, "Apache-2.0"), (4, "Apache-2.0 (line)")}
    whole = next(r for r in got if (r.doc_id, r.license) == (1, "Apache-2.0"))
    assert (whole.first_word, whole.n_words, whole.n_found) == (200, len(brute.plain(apache)), whole.n_shingles)
    assert licenses.license_notices(docs).collect() == [] and licenses.license_notices(none).collect() == []
    with pytest.raises(ValueError):
        licenses.license_notices(none, {"short": "three short words"})


def test_private_spans(docs, rows, none):
    got = pii.private_spans(docs, keep=["doc_id", "text"]).select("doc_id", "text", pii.joined("spans").alias("s")).collect()
    assert len(got) == len(rows)
    assert all(r.s == brute.base_spans(r.text) for r in got)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    before = {(r[0], r[1]) for r in rows}
    for r in clean.collect():
        assert (r.doc_id, r.text) in before or "[EMAIL]" in r.text and brute.base_spans(r.text) == ""
    assert pii.sanitised(none).collect() == []


def test_base_spans_at_random(spark):
    rng = random.Random(4)
    alphabet = ["1", "2", "0", "25", "256", ".", "@", "a", "b.c", "-", " ", "+", "(", "%", "🙂", "é", "\n", "4111111111111111", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "0001.2.3.00255", "+1 (649) 555-1648"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a" * 3000 + "@" + "b" * 3000, "1" * 5000, "a@b.c_d@e.f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("spans", pii.base_spans("text"))
    got = dict(rows.select("i", pii.joined("spans")).collect())
    assert [got[i] for i in range(len(texts))] == [brute.base_spans(t) for t in texts]


def test_spans_of_a_text_with_very_many(spark):
    """Work and result stay in proportion: 60,000 addresses in one text, then replaced."""
    text = "".join(f"h{i % 7}é 10.0.{i % 256}.{i // 256} " for i in range(60_000))
    row = spark.createDataFrame([(text,)], "text string").withColumn("spans", pii.base_spans("text"))
    got = row.select("text", "spans", F.expr(pii._generalised("text", "spans")).alias("clean")).first()
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got.spans) == brute.base_spans(text)
    assert got.clean == "".join(f"h{i % 7}é [IP] " for i in range(60_000))


def test_span_arithmetic_at_random(spark):
    """Replacing, and terms outside base spans, against plain Python, over and at the block borders."""
    rng = random.Random(21)
    rows = []
    for n in (0, 1, 2, 63, 64, 65, 200, 4097):
        text = "".join(rng.choice("abé🙂 \n") for _ in range(3 * n + 5))
        spans = sorted((a, rng.randint(0, 4), a + rng.randint(1, 9)) for a in (rng.randint(0, len(text) - 1) for _ in range(n)))
        kinds = [*pii.KINDS, pii.TERM]
        rows.append((n, text, [(a, k, min(e, len(text)), kinds[k], "") for a, k, e in spans]))
    table = spark.createDataFrame(rows, f"n int, text string, spans {pii.SPAN}").withColumn("spans", F.array_sort("spans"))
    base, more = (f"filter(spans, s -> s.kind {sign} 'term')" for sign in ("<>", "="))
    table = table.select("*", F.expr(base).alias("base"), F.expr(more).alias("more"))
    for r in table.select("*", F.expr(pii._generalised("text", "spans")).alias("clean"), F.expr(pii._outside("base", "more")).alias("free")).collect():
        at, out = 0, ""
        for s in r.spans:
            if s.end > at:
                out += r.text[at : s.start] + ("" if s.start < at or s.kind == "term" else f"[{s.kind.upper()}]")
                at = s.end
        assert r.clean == out + r.text[at:]
        assert r.free == [m for m in r.more if not any(b.start < m.end and m.start < b.end for b in r.base)]


def test_disclosing_terms(spark):
    rng = random.Random(9)
    rows = [(i, f"{sentence(rng, 20)} Kowalski {rng.choice(['wrote', 'said', 'sent'])} {sentence(rng, 3)} jan@mail.example the {sentence(rng, 9)}") for i in range(6)]
    rows += [(10 + i, sentence(rng, 30) + " the end") for i in range(60)] + [(100, "kowalski alone, no address")]
    got = {r.doc_id: r.spans for r in pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in range(6):
        terms = {text[i][s.start : s.end] for s in got[i] if s.kind == "term"}
        assert "Kowalski" in terms and "the" not in terms
    assert all(not got[i] for i in got if i >= 10)  # texts without an entity stay as they are
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Kowalski" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == text[100]


def test_terms_of_entities_in_one_or_two_texts(spark):
    rng = random.Random(12)
    rows = [(0, f"{sentence(rng, 9)} Nowak wrote anna@mail.example the {sentence(rng, 9)}"), (1, f"{sentence(rng, 9)} Zielinska wrote +1 (649) 555-1648 {sentence(rng, 9)}")]
    rows += [(2, f"{sentence(rng, 9)} zielinska wrote +1 (649) 555-1648, the {sentence(rng, 9)}")]
    rows += [(10 + i, sentence(rng, 30) + f" the end, wrote {i}") for i in range(2000)]
    text = dict(rows)
    got = {r.doc_id: {text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"} for r in pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(3)] == [{"Nowak"}, {"Zielinska"}, {"zielinska"}]
    assert not any(got[i] for i in got if i >= 10)


def test_copies_count_once_in_every_number(spark):
    rng = random.Random(13)
    rows = [(i, f"{sentence(rng, 9)} Wojcik wrote ewa@mail.example the {sentence(rng, 9)}") for i in range(3)]
    rows += [(10 + i, sentence(rng, 20) + " the end, wrote") for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    text = dict(rows)
    for r in pii.private_spans(table).collect():
        assert {text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"} == (set() if 10 <= r.doc_id < 1000 else {"Wojcik"})


def test_leaks(spark, docs, none):
    rng = random.Random(10)
    items = [(i, sentence(rng, rng.randint(8, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "--")]
    rows, want = [], set()
    for doc in range(40):
        text = sentence(rng, rng.randint(0, 80)).split(" ")
        if doc % 2:
            number, item = items[rng.randrange(12)]
            w = item.split(" ")
            for _ in range(rng.randint(0, len(w) // 4)):
                kind, at = rng.randrange(3), rng.randrange(len(w))
                w[at : at + 1] = [["zz"], [], [w[at], "yy"]][kind]
            text[5:5] = [x.upper() + "," for x in w]
        rows.append((doc, " ".join(text)))
    for doc, text in rows:
        for number, item in items:
            pattern = brute.plain(item)
            if pattern and brute.edit_distance_in(pattern, brute.plain(text)) <= len(pattern) * 20 // 100:
                want.add((doc, number))
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    for r in got:
        assert brute.edit_distance_in(brute.plain(dict(items)[r.item_id]), brute.plain(dict(rows)[r.doc_id])) == r.distance
    assert {r.doc_id for r in decontaminate.drop_leaking(table, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontaminate.benchmark_leaks(none, bench).collect() == []
    assert decontaminate.benchmark_leaks(table, bench.limit(0)).collect() == []


def test_substrings(docs, rows, none):
    for size in (50, 5):
        got = substrings.duplicate_factors(docs, size).collect()
        want = [(r[0], len(brute.words(r[1])), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, k in zip(rows, brute.kept_words([(r[0], r[1]) for r in rows], size))]
        assert sorted(((r.doc_id, r.n_words, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=key) == sorted(want, key=key)
        for r in got:
            covered = {i for f in r.factors for i in range(f.first_word, f.first_word + f.n_words)}
            assert len(covered) == r.n_removed and all(f.n_words >= size and f.reference < r.doc_id for f in r.factors)
        texts = {}
        for d, t, *_ in rows:
            texts.setdefault(d, []).append(brute.words(t))
        for r in got:
            own = [t for t in texts[r.doc_id] if len(t) == r.n_words]
            for f in r.factors:  # a factor is a copy of its reference, word by word
                copies = [t[f.reference_word : f.reference_word + f.n_words] for t in texts[f.reference]]
                assert any(t[f.first_word : f.first_word + f.n_words] in copies for t in own)
            ends = [f.first_word + f.n_words for f in r.factors]
            assert ends == sorted(set(ends)) and all(a >= b for a, b in zip([f.first_word for f in r.factors][2:], ends))  # none lies within its neighbours
    assert substrings.duplicate_factors(none).collect() == []


def test_factors_keep_their_places(spark):
    rng = random.Random(21)
    a, b, own = (sentence(rng, n).split(" ") for n in (200, 90, 40))
    rows = [(1, a), (2, own[:5] + b), (3, own + a[20:100] + own + a[130:190] + b[10:80]), (4, a[60:120] + a[110:180]), (5, ["x"] * 300), (6, ["x"] * 200),
            (7, a), (7, own), (8, b[:60] + own[:1] + ["x"] * 49)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r.doc_id, r.n_words): [tuple(f) for f in r.factors] for r in substrings.duplicate_factors(docs).collect()}
    assert found[3, 290] == [(40, 80, 1, 20), (160, 60, 1, 130), (220, 70, 2, 15)]
    assert found[4, 130] == [(0, 60, 1, 60), (60, 70, 1, 110)]
    # 49 words, or words that go on in another place, are no factor
    assert found[8, 110] == [(0, 60, 2, 5)]
    # every window of a text of one word is the same: places do not go on, four copies cover it
    assert found[6, 200] == [(0, 50, 5, 0), (50, 50, 5, 0), (100, 50, 5, 0), (150, 50, 5, 0)]
    # two rows of one id: one a whole copy, the other stays
    assert found[7, 200] == [(0, 200, 1, 0)] and found[7, 40] == []


def page_rows():
    rng = random.Random(11)
    rows = []
    for i in range(30):
        article = f"<article><h1>T&amp;t {i}</h1><p>{sentence(rng, 30)}<p><b>x &lt; y<br></b>{sentence(rng, 5)}</p></article>"
        rows.append((i, f"http://h{i % 2}.example.com/{i}", f"<html><head><title>t</title><script>if(a<b){{'</p>'}}</script></head><body><nav>menu</nav><div class='share-box'>s</div>{article}<footer>f</footer>", "e"))
    same = "<div id=main><div><p>one text that is on every page</p></div></div>"
    rows += [(100 + i, "https://plain.example/x", f"<body>{same}<div><p>{sentence(rng, 12)}</p></div></body>", "e") for i in range(12)]
    rows += [(200, None, None, None), (201, "", "", "e"), (202, "http://h0.example.com/q", "no tags < at all &amp; x", "e"), (203, "u", "<p" + " a" * 20000, "e"), rows[3]]
    return rows


def test_main_text(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.main_text(pages, into="text").collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        if r.page_id < 100:
            assert r.text == brute.article(source[r.page_id])
        elif r.page_id < 200:
            assert "on every page" not in r.text and r.text == brute.article("<article>" + source[r.page_id].split("</div></div>")[1] + "</article>")
    text = {r.page_id: r.text for r in got}
    assert (text[200], text[201], text[202]) == ("", "", "no tags < at all & x")
    assert main_text.main_text(pages.limit(0)).collect() == []


def test_copies_of_a_page_are_one_page_of_its_host(spark):
    rng = random.Random(14)
    text = [sentence(rng, 20) for _ in range(30)]
    rows = [(i, "http://one.example/x", f"<body><div><p>{text[i]}</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://one.example/x", rows[0][2]) for i in range(900)]
    # hosts of one page whose domain shows what is alike, and a page that is most of its host's text
    rows += [(2000 + i, f"http://h{i}.many.example/", f"<body><div id=x><p>same words</p></div><div><p>{text[i]}</p></div></body>") for i in range(20)]
    rows += [(3000 + i, "http://two.example/", f"<body><div id=x><p>{text[0]}</p></div><p>{i} more</p></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in main_text.main_text(pages, into="text").collect()}
    assert all(got[i] == text[i] for i in range(30)) and all(got[100 + i] == text[0] for i in range(900))
    assert all(got[2000 + i] == text[i] for i in range(20))
    assert all(got[3000 + i] == f"{text[0]}\n{i} more" for i in range(20))


def test_landmarks_are_not_removed_by_their_own_words():
    text = "the text of this page with a few words"
    for page in (
        f"<html class='has-banner'><body class='no-sidebar'><div><p>{text}</div></body>",
        f"<body><nav>x</nav><main class='with-sidebar'><p>{text}</main>",
        f"<body><article class='post share-enabled'><p>{text}</article>",
        f"<body><article class='sponsored'><p>{text}</article>",
        f"<body><main><p>{text}</p><section id=comments><article><p>nice</article><article>yes</article></section></main>",
        f"<body><div><p>{text}</p></div><article class='comment c1'><p>I think so too</article><aside><article>teaser</article></aside>",
        f"<body><div><p>{text} {text} {text}</p></div><article><p>ok</article>",
        f"<body><article><header><p>{text}</header></article><div class=comments>no</div>",
    ):
        got = main_text.page_text(page, frozenset()).split("\n")[0]
        assert got in (text, f"{text} {text} {text}"), page
    assert main_text.page_text(f"<main><p>{text}</p><div class=comments><article>no</article></div></main>", frozenset()) == text


def test_warc(spark, tmp_path):
    rows = page_rows()
    rows += [(300, "http://copy/", rows[5][2], "e"), (299, "u\r\nx: y", rows[5][2], "e"), (301, "short", "abc", "e"), (302, "short", "abc", "e"), (303, "日", "日本" * 60, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    make_folder(folder)
    files = warc.write_warc(warc.revisits(pages), folder).collect()
    files = spark.createDataFrame([f.asDict() for f in files], "path string, n_records long, n_bytes long")
    first = {}
    for r in rows:
        payload = (r[2] or "").encode()
        if len(payload) >= 100:
            first[payload] = min(r[0], first.get(payload, r[0]))
    want = []
    for r in rows:
        payload = (r[2] or "").encode()
        again = first.get(payload, r[0]) < r[0]
        want.append((r[0], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[payload] if again else None, None if again else payload))
    for size in (97, 4096, 1 << 23):  # every cut of the files gives each record once
        got = warc.read_warc(spark, files, size).collect()
        found = [
            (int(warc.record_key(r.record_id)), r.payload_bytes, r.payload_digest, r.record_type,
             int(warc.record_key(r.refers_to)) if r.refers_to else None, None if r.payload is None else bytes(r.payload)) for r in got
        ]
        assert sorted(found, key=key) == sorted(want, key=key)
    empty = warc.write_warc(warc.revisits(pages.limit(0)), folder)
    assert warc.read_warc(spark, empty).collect() == []


class Caught:
    """Stands for a table; gives back the function that its rows would go through."""

    def __init__(self, df):
        self.schema, self.columns = df.schema, df.columns

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


def test_tasks_hold_little_beside_their_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows = [" ".join(f"w{(i * 31 + k) % 5000}" for k in range(400)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    for function in (jaccard._named(Caught(docs), 5, "doc_id", "text"), quality.with_counts(Caught(docs), "counts")):
        encoder(path)
        tracemalloc.start()
        counted = sum(part.num_rows for part in function(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert counted == len(rows) and peak < 60e6
        assert path not in lasting()  # what an encoder learned in this worker is not for these tasks
