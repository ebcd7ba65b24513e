"""Token ids: encoder, files, counts and packing against the library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import CASES, SF, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texelyard.llm import packing, tokencache, tokenfile, tokens
from texelyard.llm.queries import QUERIES
from texelyard.session import new_folder
from tokenizers import Tokenizer

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.library_path(NAME))


def plain(library, text, *end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4")


def test_pieces_give_the_librarys_ids(library, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2_000)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " ", "a", "B", "é", "1", "<|endoftext|>", "'s", ",", "中", "\x1f", "😀", "　", " "]
    texts = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]]
    worker = tokens.JsonEncoder(tokens.library_path(NAME))
    seen = 0
    for at, ids, bounds in worker.column(pa.array(texts)):
        for k in range(len(bounds) - 1):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(library, texts[at + k]).tolist(), texts[at + k]
            seen += 1
    assert seen == len(texts)


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    worker = tokens.JsonEncoder(tokens.library_path(NAME))
    texts = [t for _, t in CASES] * 2
    got = [ids[b[k] : b[k + 1]].tolist() for _, ids, b in worker.column(pa.array(texts)) for k in range(len(b) - 1)]
    assert got == [plain(library, t).tolist() for t in texts]
    assert len(worker.memo) <= 3


def test_a_known_word_is_not_encoded_again_for_what_follows_it(library, monkeypatch):
    worker = tokens.JsonEncoder(tokens.library_path(NAME))
    list(worker.column(pa.array(["see words and größer ones then"])))
    asked, encode = [], worker.encode
    monkeypatch.setattr(worker, "encode", lambda text: asked.append(text) or encode(text))
    texts = ["see words, and größer'll.\n\nwords<|endoftext|>", "see größerß words\x1f ones", "see wordsʼ, ones²", "see wordś. and1"]
    got = [ids[b[k] : b[k + 1]].tolist() for _, ids, b in worker.column(pa.array(texts)) for k in range(len(b) - 1)]
    assert got == [plain(library, t).tolist() for t in texts]
    # Asked: what does not begin with a known word, and the text in which a space follows white space.
    assert sorted(asked) == sorted([" größerß wordsʼ, ones² wordś.", texts[1]])


def test_word_vocabulary_is_encoded_whole():
    name = "word_bpe_49k.json"
    worker = tokens.JsonEncoder(tokens.library_path(name))
    assert not worker.splits_at_space
    own = Tokenizer.from_file(tokens.library_path(name))
    _, ids, _ = next(worker.column(pa.array(["Hello  World again"])))
    assert ids.tolist() == own.encode("Hello  World again", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(50, 100))
def test_segment_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    found = tokenfile.Segment(tokenfile.encode_segment([None, 7], ids, np.array([len(ids), 0]), percentile))
    assert found.doc_ids == [None, 7]
    assert (found.blocks(0, found.n_blocks) == ids).all()
    for start in (0, len(ids) // 2, max(0, len(ids) - 1)):
        assert (found.read(start, len(ids) - start) == ids[start:]).all()


def test_token_files_read_back(spark, library):
    folder = new_folder(spark, "test")
    tokenfile.write_token_files(documents(spark), folder, shards=3, segment_ids=500)
    rows = sorted(tokenfile.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    ids = [None if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d) and len(rows) == len(CASES)
    start = 0
    want = defaultdict(list)
    for d, t in CASES:
        want[d].append(plain(library, t, 2).tobytes())
    for r in rows:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        want[r.doc_id].remove(bytes(r.ids))
        start += r.n_tokens
    assert not any(want.values())
    digests = tokenfile.read_token_digests(spark, folder)
    assert sorted(r.ids_crc32 for r in digests.collect()) == sorted(zlib.crc32(r.ids) for r in rows)


def test_token_files_of_no_documents(spark):
    folder = new_folder(spark, "test")
    tokenfile.write_token_files(documents(spark, []), folder)
    assert tokenfile.read_token_files(spark, folder).count() == 0


def test_query_token_files(spark, library):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = {}, 0
    for d, t in docs:
        ids = plain(library, t, 2)
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_files"](spark, SF).collect()} == want


def test_counts_come_from_the_cache(spark, library):
    folder = new_folder(spark, "cache")
    docs = documents(spark)
    want = sorted((str(d), len((t or "").encode()), len(plain(library, t)), len(plain(library, t)) > 1024) for d, t in CASES)
    for _ in range(2):
        got = tokencache.count_tokens(docs, folder)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    distinct = len({t or "" for _, t in CASES})
    assert spark.read.parquet(folder).count() == distinct
    # A stored count is used as it is, and another tokenizer has counts of its own.
    release = tokencache.tokenizer_version(NAME)
    assert tokencache.read_cache(spark, folder, release).count() == distinct
    assert tokencache.count_tokens(docs, folder, "piece_bpe_32k.model").count() == len(CASES)
    assert spark.read.parquet(folder).count() == 2 * distinct
    assert tokencache.count_tokens(documents(spark, []), new_folder(spark, "cache")).count() == 0


def test_two_runs_that_count_one_content(spark, monkeypatch):
    folder = new_folder(spark, "cache")
    tokencache.count_tokens(documents(spark, [(1, "known")]), folder)
    read, calls = tokencache._stored, []

    def after_another_run(spark, folder, release):
        """The other run appends the same contents just before this one reads what is stored."""
        calls.append(folder)
        if len(calls) == 2:
            read(spark, folder, release).select("content", "n_tokens").write.parquet(f"{folder}/tokenizer={release}/run=other")
        return read(spark, folder, release)

    monkeypatch.setattr(tokencache, "_stored", after_another_run)
    rows = tokencache.count_tokens(documents(spark, [(1, "known"), (2, "both")]), folder).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and len(calls) == 2


def test_query_counts(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: (len(r.text.encode()), len(plain(library, r.text))) for r in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op6_cached_token_counts"](spark, SF).collect()} == want


def check_pieces(rows, ids_of, capacity):
    """Every id in one piece, sequences gapless; returns the ids of padding."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += capacity - at
    for d, copies in ids_of.items():
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, copies))
        for r in own:
            assert any(r.doc_tokens == len(c) and zlib.crc32(c[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for c in copies)
    return padding


def test_packing_keeps_every_id(spark, library):
    ids_of = defaultdict(list)
    for d, t in CASES:
        ids_of[d].append(plain(library, t, 1))
    rows = packing.pack_documents(documents(spark).coalesce(1), 64, shard_ids=2_000).collect()
    check_pieces(rows, ids_of, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_a_second_run_has_only_hits(spark, monkeypatch):
    """The documents of the query twice on one cache: the second time nothing is encoded."""
    docs, folder = spark.read.parquet(f"{SF}/documents.parquet"), new_folder(spark, "cache")
    first = Counter(map(tuple, tokencache.count_tokens(docs, folder).collect()))
    stored = tokencache.read_cache(spark, folder, tokencache.tokenizer_version(NAME))
    held = stored.count()
    second = Counter(map(tuple, tokencache.count_tokens(docs, folder).collect()))
    runs = spark.read.parquet(folder).groupBy("run").count().collect()
    assert first == second and len(runs) == 1 and stored.count() == held == docs.select("text").distinct().count()


def test_neighbours_follow_their_seed():
    # Documents 0 and 3 share rare ids, 1 and 2 share others; 9 is in all of them.
    texts = [[9, 100, 101, 102], [9, 200, 201], [9, 200, 201, 202], [9, 100, 101, 103], [9], []]
    ids = np.array(sum(texts, []), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    index = packing.Index(ids, bounds)
    order = [k for k, *_ in packing.pack(index, np.diff(bounds) + 1, 1000)]
    assert order[:2] == [0, 3] and order.index(2) == order.index(1) + 1 and sorted(order) == list(range(6))


def test_bm25_equals_the_formula():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 12, n) for n in (0, 3, 9, 14)]
    bounds = np.cumsum([0, *map(len, texts)])
    index = packing.Index(np.concatenate(texts).astype(np.uint32), bounds)
    mean = np.mean([len(t) for t in texts])
    for seed, query in enumerate(texts):
        want = np.zeros(len(texts))
        for term in set(query.tolist()):
            holders = sum(term in t for t in texts)
            for k, t in enumerate(texts):
                times = (t == term).sum()
                if times:
                    idf = np.log(1 + (len(texts) - holders + 0.5) / (holders + 0.5))
                    want[k] += idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * len(t) / mean))
        assert np.allclose(index.scores(seed), want, rtol=1e-5)


def bm25_of_all_ids(texts, seed):
    mean = np.mean([len(t) for t in texts])
    want = np.zeros(len(texts))
    counts = [dict(zip(*np.unique(t, return_counts=True))) for t in texts]
    for term in set(texts[seed].tolist()):
        holders = sum(term in c for c in counts)
        for k, c in enumerate(counts):
            times = c.get(term, 0)
            idf = np.log(1 + (len(texts) - holders + 0.5) / (holders + 0.5))
            want[k] += idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * len(texts[k]) / mean))
    return want


def test_long_seeds_ask_for_all_their_ids():
    rng = np.random.default_rng(4)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(50, 400)), 3_000) for _ in range(120)]
    index = packing.Index(np.concatenate(texts).astype(np.uint32), np.cumsum([0, *map(len, texts)]))
    assert 0 < len(index.dense) and len(index.holder)
    for seed in range(0, 120, 6):
        want, got = bm25_of_all_ids(texts, seed), index.scores(seed)
        assert np.allclose(got, want, rtol=1e-4)
        want[seed] = got[seed] = 0
        assert len(set(np.argsort(-got)[:10]) & set(np.argsort(-want)[:10])) >= 9


def test_related_documents_meet_whatever_file_they_are_in(spark):
    rng = random.Random(3)
    common = [f"w{k}" for k in range(40)]
    own = [[f"{rng.choice('bcdfg')}{rng.randint(100, 999)}q" for _ in range(12)] for _ in range(40)]
    rows = [(t * 10 + part, " ".join(rng.choices(common, k=30) + rng.choices(own[t], k=30))) for part in range(10) for t in range(40)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 10), "doc_id long, text string")
    pieces = packing.pack_documents(docs, 512, shard_ids=12_000).collect()
    task = {r.doc_id: r.sequence_id >> 32 for r in pieces}
    assert len(task) == 400 and len(set(task.values())) > 2
    mates = [task[a] == task[b] for a in task for b in task if a < b and a // 10 == b // 10]
    others = [task[a] == task[b] for a in task for b in task if a < b and a // 10 != b // 10]
    assert np.mean(mates) > 0.7 > 0.5 > np.mean(others)


def placed_rows(spark, texts):
    rows = [(k, key, len(ids), False, np.array(ids, "<u2").tobytes()) for k, (key, ids) in enumerate(texts)]
    return spark.createDataFrame(rows, packing.PLACED)


def test_a_key_that_fills_several_tasks_is_dealt_among_them(spark):
    texts = [(7, [5, 6, 7])] * 3_000 + [(k, [k, k + 1]) for k in range(100, 1_100)]
    dealt, tasks = packing.deal(placed_rows(spark, texts), 1_500)
    assert tasks == 10
    held = Counter()
    for r in dealt.collect():
        held[r.task] += r.n_ids + 1
    assert len(held) == 10 and max(held.values()) < 1.3 * 1_500
    assert packing.deal(placed_rows(spark, []), 10)[1] == 1


def test_many_tasks_are_balanced(spark):
    """As many tasks as 30 GB would have, on the documents of sf0.1: none has four times its share of ids, or its largest document."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    placed = packing.map_text(docs, packing._place(NAME, packing._placement(docs, NAME)), packing.PLACED).cache()
    total = sum(r.n_ids + 1 for r in placed.select("n_ids").collect())
    for tasks in (14, 100):
        dealt, made = packing.deal(placed, -(-total // tasks))
        held = {r.task: r.held for r in dealt.groupBy("task").agg(F.sum(F.col("n_ids") + 1).alias("held")).collect()}
        assert made == tasks == len(held)
        assert max(held.values()) < 2 * total / tasks
    # 3,576 tasks hold some 3,000 documents each at that size, not three: each key gets forty times its documents.
    many = placed.withColumn("doc_id", F.explode(F.sequence(F.col("doc_id") * 40, F.col("doc_id") * 40 + 39)))
    dealt, made = packing.deal(many, -(-total * 40 // 3_576))
    held = [r.held for r in dealt.groupBy("task").agg(F.sum(F.col("n_ids") + 1).alias("held")).collect()]
    assert made == len(held) == 3_576 and max(held) < 4 * 40 * total / 3_576
    placed.unpersist()


def test_packing_is_the_same_on_any_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(7, "text").write.parquet(str(tmp_path / "seven"))
    docs.orderBy(F.desc("doc_id")).coalesce(1).write.parquet(str(tmp_path / "one"))
    found = [packing.pack_documents(spark.read.parquet(str(tmp_path / name)), 512, shard_ids=20_000, with_ids=False).collect() for name in ("seven", "one")]
    assert len(found[0]) > 200 and Counter(map(tuple, found[0])) == Counter(map(tuple, found[1]))


def plain_pack(texts, capacity):
    """The greedy fill written plainly, scores by the formula."""
    used, out, sequence, room, seed, last = set(), [], -1, 0, None, None
    while len(used) < len(texts) or seed is not None:
        if seed is not None:
            k, start = seed
        else:
            k = -1
            if room and last is not None:
                scores = bm25_of_all_ids(texts, last)
                left = [j for j in range(len(texts)) if j not in used and scores[j] > 0]
                k = max(left, key=lambda j: (scores[j], -j), default=-1)
            fresh = k < 0
            k, start = (min(set(range(len(texts))) - used) if fresh else k), 0
            if fresh:
                last = k
        if not room:
            sequence, room, last = sequence + 1, capacity, k
        used.add(k)
        length = min(room, len(texts[k]) + 1 - start)
        out.append((k, start, length, sequence, capacity - room))
        room -= length
        seed = (k, start + length) if start + length < len(texts[k]) + 1 else None
    return out


def test_greedy_fill_against_a_plain_one():
    rng = np.random.default_rng(12)
    for trial in range(12):
        texts = [rng.integers(0, 400, rng.integers(1, 60)) for _ in range(60)]
        index = packing.Index(np.concatenate(texts).astype(np.uint32), np.cumsum([0, *map(len, texts)]))
        got = list(packing.pack(index, np.array([len(t) + 1 for t in texts]), 64 + 7 * trial))
        assert got == plain_pack(texts, 64 + 7 * trial)


def test_all_shards_give_the_best_neighbours(spark):
    """Asking every shard equals BM25 over all documents; packing then puts best neighbours in one shard."""
    rng = np.random.default_rng(2)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(5, 80)), 3_000) for _ in range(240)]
    dealt, tasks = packing.deal(placed_rows(spark, [(int(rng.integers(0, 50)), t) for t in texts]), 700)
    assert tasks >= 10
    numbered = dealt.withColumn("row", F.col("doc_id"))
    best = {}
    for asked in (1, 5, None):
        found = packing.nearest(numbered, tasks, asked, 700, 10).collect()
        lists = defaultdict(list)
        for r in sorted(found, key=lambda r: (-r.score, r.found)):
            lists[r.query].append(r.found)
        best[asked] = lists
    hits = Counter()
    for seed in range(240):
        want = bm25_of_all_ids(texts, seed)
        want[seed] = 0
        top = set(np.argsort(-want)[:10].tolist())
        for asked, lists in best.items():
            hits[asked] += len(top & set(lists[seed])) / 10
    assert hits[None] / 240 > 0.99 and hits[1] / 240 < hits[5] / 240 < 0.9


def test_asking_all_shards_packs_best_neighbours_together(spark, library):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(60)], k=30) + [f"{k // 2}q{j}" for j in range(20)])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids_of = {k: [plain(library, t, 1)] for k, t in rows}
    together = {}
    for asked in (1, None):
        pieces = packing.pack_documents(docs, 512, shard_ids=3_000, ask=asked).collect()
        check_pieces(pieces, ids_of, 512)
        shard = {r.doc_id: r.sequence_id >> 32 for r in pieces}
        together[asked] = np.mean([shard[k] == shard[k + 1] for k in range(0, 300, 2)])
    assert together[None] > 0.9 > together[1]


def test_query_packing(spark, library):
    ids_of = {r.doc_id: [plain(library, r.text, 1)] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_retrieval_packing"](spark, SF).collect()
    padding = check_pieces(rows, ids_of, 2048)
    assert padding < 0.05 * sum(len(c[0]) for c in ids_of.values())
