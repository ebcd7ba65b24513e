"""Fill-in-the-middle, importance resampling and merge-type pieces against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from helpers import CASES, LONG, SF, documents, lower
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texelyard.llm import fillmiddle, pieces, resampling
from texelyard.llm.queries import QUERIES
from texelyard.llm.tokens import library_path

MODEL = "piece_bpe_32k.model"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- fill-in-the-middle ------------------------------------------------------

UNIT = {"code_point": re.compile("(?s)."), "word": re.compile(r"(?s)[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), "line": re.compile("[^\n]*\n|[^\n]+")}
TEXTS = ["", "a", "abc", "é中😀 x", "a\n\nb\n", " lead  and\ttrail ", "\n", "😀" * 50, "ab cd\n" * 40]


@pytest.mark.parametrize("unit", fillmiddle.UNITS)
@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_every_cut_is_found(unit, block):
    for text in TEXTS:
        raw = text.encode()
        tree = fillmiddle.BlockTree(np.frombuffer(raw, np.uint8), unit, block)
        units = plain_units(text, unit)
        assert tree.units == len(units) and tree.code_points == len(text)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head)), (text, unit, block, k)


def plain_units(text, unit):
    if unit != "word":
        return UNIT[unit].findall(text)
    out = []
    for k, c in enumerate(text):
        space = c in " \t\n\x0b\x0c\r"
        if not k or (not space and text[k - 1] in " \t\n\x0b\x0c\r"):
            out.append("")
        out[-1] += c
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.sampled_from(fillmiddle.UNITS), st.integers(1, 9))
def test_cuts_of_any_text(text, unit, block):
    text = text.encode("utf-8", "ignore").decode()
    tree = fillmiddle.BlockTree(np.frombuffer(text.encode(), np.uint8), unit, block)
    units = plain_units(text, unit)
    assert [tree.cut(k)[1] for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def plain_fill(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


FILL_CASES = [*CASES, *[(k, f"text {k} with < and <P and S> é😀\n" * (k % 7 + 1)) for k in range(20, 120)], (200, "a <M> in it"), (201, "<S>"), (202, "<<P>>")]


def test_fill_of_every_case(spark):
    docs = documents(spark, FILL_CASES)
    found = fillmiddle.fill_in_middle(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = Counter((d, *plain_fill(d, t)) for d, t in FILL_CASES)
    assert Counter(map(tuple, found.collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    rebuilt = found.select("doc_id", fillmiddle.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter(map(tuple, rebuilt.collect())) == Counter((d, t or "") for d, t in FILL_CASES)
    digests = fillmiddle.fill_digest(found).collect()
    assert Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in digests) == Counter((d, sha(plain_fill(d, t)[4]), sha(t or "")) for d, t in FILL_CASES)
    assert fillmiddle.fill_digest(fillmiddle.fill_in_middle(documents(spark, []))).count() == 0
    for name in ("n", "form", "output", "dice", "text_"):
        renamed = docs.withColumnRenamed("doc_id", "id").withColumnRenamed("row", name)
        assert fillmiddle.fill_in_middle(renamed, key="id").count() == len(FILL_CASES)


def test_fill_by_words_and_other_sentinels(spark):
    marks = ("«p", "«s", "«m")
    docs = spark.createDataFrame([(k, "one two\tthree  four\nfive " * (k % 4 + 1)) for k in range(60)], "id long, body string")
    found = fillmiddle.fill_in_middle(docs, 5, "id", "body", "word", 0, 50, marks, 8)
    back = found.select("id", "n", "form", "output", fillmiddle.restored(F.col("output"), F.col("form"), marks).alias("body"))
    rows = back.collect()
    assert {r.form for r in rows} == {"psm", "spm"}
    assert Counter((r.id, r.body) for r in rows) == Counter(map(tuple, docs.collect()))
    for r in rows:
        assert r.n == 5 * (r.id % 4 + 1)
        prefix = r.output.split(marks[0])[1].split("«")[0]
        assert not prefix or prefix[-1] in " \t\n"


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("<", "<S>", "x<")])
def test_unsafe_sentinels(marks):
    with pytest.raises(ValueError):
        fillmiddle.check_sentinels(marks)


# -- importance resampling ---------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, most=2):
    words = WORD.findall(lower(text).encode())
    return words, [b" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=25, seed=7, least=20, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f) % buckets

    own = [Counter(map(bucket, plain_features(t)[1])) for _, t in docs]
    s, t = sum(own, Counter()), sum((Counter(map(bucket, plain_features(x)[1])) for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for (doc_id, text), held in zip(docs, own):
        total = sum(n * math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b, n in held.items())
        n = sum(held.values())
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = total // n if n else 0
        rows.append((doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_features(text)[0])))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = Counter((*r[:4], k + 1) for k, r in enumerate(drawn))
    return ranks + Counter((*r[:4], None) for r in rows) - Counter((*r[:4], None) for r in drawn)


MANY = [*CASES, *[(k, " ".join(f"w{(k * j) % 31} Straße" for j in range(k % 40))) for k in range(300, 500)], *[(77, "same words here " * 9)] * 30, *[(None, "null key " * 12)] * 20]
TARGET = ["w1 w2 w3 straße w4", None, "", "Same words", "w7 straße w14 straße"]


def test_resample_of_every_case(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 3_000)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    for percent in (25, 90, 0):
        found = resampling.resample(documents(spark, MANY), target, percent)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, found.collect())) == plain_resample(MANY, TARGET, percent)
    none = spark.createDataFrame([], target.schema)
    assert Counter(map(tuple, resampling.resample(documents(spark, MANY), none).collect())) == plain_resample(MANY, [])
    assert resampling.resample(documents(spark, []), target).count() == 0
    for name in ("n_words", "buckets", "cells", "score", "key", "rank"):
        clash = documents(spark, MANY[:3]).withColumnRenamed("doc_id", name)
        assert resampling.resample(clash, target, key=name).columns[0] == name


def test_resampling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op12_crc_resampling"](spark, SF).collect())) == plain_resample(docs, target)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30))
def test_matrices_give_the_crc(features):
    assert resampling.crc_column(pa.array(features, pa.binary())).tolist() == [zlib.crc32(f) for f in features]
    part = pa.array([b"xx", *features], pa.binary()).slice(1)
    assert resampling.crc_column(part).tolist() == [zlib.crc32(f) for f in features]


def test_long_features_and_small_matrices(monkeypatch):
    monkeypatch.setattr(resampling, "COLUMNS", 5)
    monkeypatch.setattr(resampling, "CELLS", 16)
    features = [bytes([k % 251]) * (k % 23) for k in range(200)]
    assert resampling.crc_column(pa.array(features, pa.binary())).tolist() == [zlib.crc32(f) for f in features]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .é中", max_size=20), max_size=8), st.integers(1, 3))
def test_buckets_of_any_texts(texts, most):
    n_words, n_features, found = resampling.text_buckets(pa.array(["skipped words", *texts], pa.string()).slice(1), 10_000, most)
    bounds = np.concatenate([[0], np.cumsum(n_features)])
    for k, text in enumerate(texts):
        words, features = plain_features(text, most)
        assert n_words[k] == len(words)
        assert found[bounds[k] : bounds[k + 1]].tolist() == [zlib.crc32(f) % 10_000 for f in features]


# -- pieces ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=library_path(MODEL))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.PieceVocabulary(library_path(MODEL))


ODD = [" ", "  ", "   ", "\n", "\t", "a", "b", "the", "ing", "é", "é", "中", "執", "😀", "\U0010ffff", "▁", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "1", "er", "ation", "​", " " * 17, "　"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14) | st.lists(st.text(max_size=8), max_size=4))
def test_pieces_are_the_librarys(library, vocabulary, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = vocabulary.encode(text)
    assert ids == library.encode(text)
    assert vocabulary.decode(np.array([*ids, 2])).decode() == library.decode([*ids, 2])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 68, 229, 233, 131, 259, 260, 29871]) | st.integers(0, 31_999), max_size=8))
def test_any_ids_decode_as_in_the_library(library, vocabulary, ids):
    assert vocabulary.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_long_runs_without_spaces(library, vocabulary):
    rng = random.Random(4)
    runs = ["a" * 30_000, " " * 3_000 + "x", "ab" * 10_000, "".join(rng.choice("ACGT") for _ in range(50_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000))]
    for text in runs:
        assert vocabulary.encode(text) == library.encode(text)


def test_full_tables_change_nothing(library):
    small = pieces.PieceVocabulary(library_path(MODEL), memo=5, pairs=7)
    for _, text in CASES * 2:
        assert small.encode(text) == library.encode(text or "")
    assert len(small.memo) <= 5 and len(small.pairs) <= 7


def test_compatibility_is_merging_alone(library, vocabulary):
    rng = random.Random(9)
    normal = [i for i in range(259, 32_000) if vocabulary.name[i].rfind("▁") == 0 and library.encode(vocabulary.name[i][1:]) == [i]]
    inner = [i for i in range(259, 32_000) if "▁" not in vocabulary.name[i]]
    for _ in range(3_000):
        left, right = rng.choice(normal), rng.choice(inner)
        text = (vocabulary.name[left] + vocabulary.name[right])[1:]
        if text:
            assert vocabulary.compatible(left, right) == (library.encode(text) == [left, right]), text


def test_pieces_of_every_case(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_BYTES", 1_000)
    docs = documents(spark)
    encoded = pieces.encode_pieces(docs)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    want = {(d, t): [*library.encode(t or ""), 2] for d, t in CASES}
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in encoded.collect()) == Counter((d, tuple(want[d, t])) for d, t in CASES)
    decoded = pieces.decode_pieces(encoded).collect()
    assert Counter((r.doc_id, r.decoded) for r in decoded) == Counter((d, library.decode(want[d, t])) for d, t in CASES)
    digests = Counter(map(tuple, pieces.piece_digest(encoded).collect()))
    assert digests == Counter((d, len(want[d, t]), sha(" ".join(map(str, want[d, t]))), sha(library.decode(want[d, t]))) for d, t in CASES)
    assert pieces.piece_digest(pieces.encode_pieces(documents(spark, []))).count() == 0
    clash = docs.withColumnRenamed("doc_id", "ids").withColumnRenamed("row", "n_tokens")
    assert pieces.encode_pieces(clash, key="ids").columns == ["ids", "n_tokens", "ids_"]
    assert pieces.decode_pieces(encoded.withColumn("decoded", F.lit(1))).columns[-1] == "decoded_"


def test_pieces_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for r in docs:
        ids = [*library.encode(r.text or ""), 2]
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, QUERIES["op13_backtracking_pieces"](spark, SF).collect())) == want


def test_word_models_are_refused():
    assert LONG
    with pytest.raises(ValueError):
        pieces._check(type("Other", (), {"normalize": lambda self, t: t.lower()})(), [])
