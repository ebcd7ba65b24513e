"""Document statistics, boosted trees and the byte network."""

import math
import zlib
from collections import Counter

import numpy as np
from helpers import CASES, LONG, SF, WORD, documents
from texelyard.llm import boosting, bytecnn, labels, rules
from texelyard.llm.queries import QUERIES
from texelyard.llm.stats import BASE, NAMES, text_stats

SMALL = "/root/testdata/sf0.01"


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = {k + i for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for i in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(hit)


def test_stats_equal_brute_force(spark):
    texts = [t for _, t in CASES] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["a a a a", "x y z x y z", "l\nl\n l\nl", "#*$%&|<> # |", "a b c"]
    for text in texts:
        assert text_stats(text)[: len(BASE)] == brute_stats(text)


def test_query_rules(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = QUERIES["op10_boosted_rules"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    good = bad = 0
    for r in rows:
        want = brute_stats(texts[r.doc_id])
        assert tuple(r[n] for n in BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in quality and not r.base_failed:
            good += quality[r.doc_id] == 1 and not r.kept
            bad += quality[r.doc_id] == 0 and r.kept
    assert good <= 1 and bad <= 2


def walked(forest, values):
    """Sum of one value per tree, from root to leaf, then the probability."""
    total = forest.base
    for root in forest.roots.tolist():
        at = root
        while forest.left[at] != at:
            at = forest.left[at] if values[forest.feature[at]] <= forest.cut[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + math.exp(-total))


def test_kept_of_the_query_by_walked_trees(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    forest = rules.fit_rules(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op10_boosted_rules"](spark, SMALL).collect()
    for r in rows:
        counts = text_stats(texts[r.doc_id])
        words, *_ = counts
        score = walked(forest, rules.features(np.array([counts]))[0].tolist())
        assert abs(score - r.score) < 1e-9
        assert r.kept == (words >= 50 and 100 * counts[NAMES.index("n_repeat_words")] <= 50 * words and score >= rules.KEEP_SCORE)
    assert 0 < sum(r.kept for r in rows) < len(rows)


def plain_probability(net, text):
    """The network without its folded table: embed, convolve, pool and combine position by position."""
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    raw = (text or "").encode()
    raw += bytes(max(bytecnn.WIDTH, -(-len(raw) // bytecnn.STRIDE) * bytecnn.STRIDE + bytecnn.WIDTH - bytecnn.STRIDE) - len(raw))
    embedded = w["embed"][list(raw)]
    responses = []
    for at in range(0, len(raw) - bytecnn.WIDTH + 1, bytecnn.STRIDE):
        responses.append(sum(embedded[at + k] @ w["filters"][k] for k in range(bytecnn.WIDTH)))
    pools = []
    for first in range(0, max(1, len(responses) - (bytecnn.CHUNK - bytecnn.HOP)), bytecnn.HOP):
        best = np.max(responses[first : first + bytecnn.CHUNK], axis=0)
        pools.append(np.maximum(best + w["filter_bias"], 0))
    vector = np.concatenate([np.mean(pools, axis=0), np.max(pools, axis=0)])
    hidden = np.tanh(vector @ w["dense"] + w["dense_bias"])
    return 1 / (1 + math.exp(-(hidden @ w["out"] + w["out_bias"])))


def test_scores_of_the_query_by_a_plain_network(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    net = bytecnn.fit_network(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op4_byte_cnn_quality"](spark, SMALL).collect():
        if r.doc_id % 10 == 0:
            want = plain_probability(net, texts[r.doc_id])
            assert abs(r.score - want) < 1e-3
            assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_judge_handles_every_case(spark):
    forest = boosting.fit(np.zeros((0, len(rules.BOUNDS))), np.zeros(0), rules.BOUNDS)
    rows = rules.judge(documents(spark), forest).collect()
    assert len(rows) == len(CASES) and all(r.score == 0.5 for r in rows)
    assert [r.kept for r in rows if r.row.text == LONG] == [False]  # its windows repeat
    kept = rules.kept_documents(documents(spark), forest)
    assert kept.columns == documents(spark).columns
    assert rules.judge(documents(spark, []), forest).count() == 0


def test_forest_is_monotone_where_bound():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 3))
    labels_ = (rows[:, 0] + np.sin(3 * rows[:, 1]) + rng.normal(size=3000) > 0).astype(float)
    forest = boosting.fit(rows, labels_, np.array([1, 0, -1]))
    grid = np.repeat(rng.normal(size=(200, 3)), 40, axis=0)
    for feature, sign in ((0, 1), (2, -1)):
        probe = grid.copy()
        probe[:, feature] = np.tile(np.linspace(-4, 4, 40), 200)
        steps = np.diff(forest.score(probe).reshape(200, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert ((forest.score(rows) > 0.5) == labels_).mean() > 0.75


def test_flat_nodes_equal_recursion():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 2))
    forest = boosting.fit(rows, (rows.sum(axis=1) > 0).astype(float), np.zeros(2), boosting.Growth(trees=7))

    def walk(node, row):
        if forest.left[node] == node:
            return forest.value[node]
        return walk(forest.left[node] if row[forest.feature[node]] <= forest.cut[node] else forest.right[node], row)

    want = [1 / (1 + np.exp(-(forest.base + sum(walk(r, row) for r in forest.roots)))) for row in rows[:50]]
    assert np.allclose(forest.score(rows[:50]), want)


def test_sample_keeps_fold_and_bounds(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    sample = labels.labelled_sample(docs, marks, rows=40)
    assert len(sample) == 40 and sample == labels.labelled_sample(docs.repartition(7), marks.repartition(3), rows=40)
    ids = {r.text: r.doc_id for r in docs.collect()}
    assert any(zlib.crc32(str(ids[t]).encode()) % 5 for t, _ in sample)
    assert sum(len(t.encode()) for t, _ in labels.labelled_sample(docs, marks, most_bytes=1 << 20)) <= 1 << 20
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    assert labels.labelled_sample(documents(spark), odd) == [(CASES[7][1], 1)] if zlib.crc32(b"7") % 5 else True
    assert labels.labelled_sample(documents(spark, []), odd) == []


def test_network_slopes_equal_differences():
    rng = np.random.default_rng(0)
    net = bytecnn.fresh(rng)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    net.fold()
    texts = [bytecnn.padded("abc defg " * k + "%%%") for k in (1, 30, 120)]
    marks = np.array([1.0, 0.0, 1.0])

    def loss():
        net.fold()
        p = np.concatenate([net.head(v[None])[1] for v in map(vector, texts)])
        return -(marks * np.log(p) + (1 - marks) * np.log(1 - p)).mean()

    def vector(text):
        got = net.responses(text)
        first = bytecnn.chunk_starts(len(got))
        pools = np.stack([got[f : f + bytecnn.CHUNK].max(axis=0) for f in first])
        pools = np.maximum(pools + net.weights["filter_bias"], 0)
        return np.concatenate([pools.mean(axis=0), pools.max(axis=0)])

    slopes = bytecnn._slopes(net, texts, marks)
    for name, at in (("embed", (97, 3)), ("filters", (2, 1, 5)), ("filter_bias", (4,)), ("dense", (6, 2)), ("dense_bias", (3,)), ("out", (5,)), ("out_bias", ())):
        kept = net.weights[name][at]
        net.weights[name][at] = kept + 1e-5
        up = loss()
        net.weights[name][at] = kept - 1e-5
        down = loss()
        net.weights[name][at] = kept
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-4, name


def test_every_byte_is_seen():
    net = bytecnn.fresh(np.random.default_rng(1))
    for n in (1, 7, 8, 9, 511, 513, 4_000, 9_999):
        text = bytecnn.padded("a" * n)
        got = net.responses(text)
        assert (len(got) - 1) * bytecnn.STRIDE + bytecnn.WIDTH >= n
        first = bytecnn.chunk_starts(len(got))
        assert first[-1] + bytecnn.CHUNK >= len(got) and (np.diff(first) <= bytecnn.CHUNK).all()
    brute = np.stack([net.responses(bytecnn.padded("xy z" * 700))[f : f + bytecnn.CHUNK].max(axis=0) for f in bytecnn.chunk_starts(len(net.responses(bytecnn.padded("xy z" * 700))))])
    want = np.maximum(brute + net.weights["filter_bias"], 0)
    assert np.allclose(net.vector("xy z" * 700), np.concatenate([want.mean(axis=0), want.max(axis=0)]))


def test_query_network(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = QUERIES["op4_byte_cnn_quality"](spark, SMALL).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_network_scores_every_case(spark):
    net = bytecnn.train([])
    rows = bytecnn.score_documents(documents(spark), net).collect()
    assert len(rows) == len(CASES) and all(0 <= r.score <= 1 for r in rows)
    assert bytecnn.score_digest(bytecnn.score_documents(documents(spark), net)).filter("held_out IS NULL").count() == 0
    assert bytecnn.score_documents(documents(spark, []), net).count() == 0
