"""Curve shards, url templates and the pipeline."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from compare import connect, differences
from helpers import CASES, SF, documents
from pyspark.sql import functions as F
from texelyard.llm import decontam, hilbert, secrets, simhash, urltree
from texelyard.llm.oracle import ORACLE
from texelyard.llm.queries import QUERIES, URL_RULES
from texelyard.session import new_folder


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (3, 4)])
def test_curve_visits_neighbours(spark, axes, bits):
    side = 1 << bits
    cells = spark.range(side**axes).select(*[F.expr(f"(id div {side**k}) % {side}").alias(f"a{k}") for k in range(axes)])
    names = cells.columns
    rows = sorted(cells.withColumn("curve", hilbert.curve_index(names, bits)).collect(), key=lambda r: r.curve)
    assert [r.curve for r in rows] == list(range(side**axes))
    assert all(sum(abs(p[n] - q[n]) for n in names) == 1 for p, q in zip(rows, rows[1:]))


def check_shards(rows, n):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values(), default=0) - min((counts[s] for s in range(n)), default=0) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def test_shards_of_every_case(spark):
    docs = documents(spark)
    placed = hilbert.curve_shards(docs, 8)
    assert placed.columns == [*docs.columns, "curve", "shard", "slot"]
    check_shards(placed.collect(), 8)
    assert hilbert.curve_shards(documents(spark, []), 8).count() == 0
    clash = docs.withColumnsRenamed({"row": "shard", "fp": "_curve", "words": "_digest"})
    assert hilbert.curve_shards(clash, 3).columns == [*clash.columns, "curve", "shard_", "slot"]
    assert hilbert.curve_shards(clash, 3).count() == len(CASES)


def test_a_hot_cell_is_cut(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE_LEAST", 4)
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    placed = hilbert.curve_shards(hot, 8)
    rows = placed.collect()
    check_shards(rows, 8)
    assert {r.doc_id for r in rows} == set(range(3000))
    again = {r.doc_id: (r.shard, r.slot) for r in hilbert.curve_shards(hot.repartition(5), 8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


@pytest.mark.parametrize("key", [None, 7])
def test_a_hot_key_is_cut(spark, monkeypatch, key):
    """One key, or none, in a third of the rows of one cell: kept values part them."""
    monkeypatch.setattr(hilbert, "SLICE_LEAST", 4)
    ids = F.when(F.col("id") % 3 == 0, F.lit(key)).otherwise(F.col("id") + 100)
    hot = spark.range(3000).select(ids.cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"), F.col("id").alias("v"))
    placed = hilbert.curve_shards(hot, 8)
    check_shards(placed.collect(), 8)
    assert sorted(r.v for r in placed.collect()) == list(range(3000))
    again = {r.v: (r.shard, r.slot) for r in hilbert.curve_shards(hot.repartition(5), 8).collect()}
    assert again == {r.v: (r.shard, r.slot) for r in placed.collect()}
    slot = placed.filter(F.col("doc_id").eqNullSafe(F.lit(key))).groupBy("shard").count().collect()
    assert len(slot) == 8 and max(r["count"] for r in slot) < 250


def test_shard_plan_is_native_and_moves_no_text(spark):
    plan = QUERIES["op9_hilbert_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_written_shards_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = new_folder(spark, "shards")
    hilbert.write_shards(docs, folder, 8)
    back = spark.read.parquet(folder)
    assert back.count() == docs.count()
    spread = [r.n for r in back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).collect()]
    assert sum(spread) < 8 * docs.select("lang").distinct().count()


def test_query_shards(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_hilbert_shards"](spark, SF).collect()
    check_shards(rows, 8)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


# -- urls --------------------------------------------------------------------------


def brute_url(url):
    import re

    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    name = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in name), re.match("[^?#]*", rest[len(name) :])[0]


def brute_rule(name, path):
    fits = [r for r in URL_RULES if (lambda h, p: (name == h or name.endswith("." + h)) and path.startswith("/" + p))(*r[1].split("/", 1))]
    return max(fits, key=lambda r: len(r[1]), default=None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://www.example.com/en/", "http://example.com", "http://example.com/en/5",
    "http://a.net/es/1", "http://ÀB.net/fr/9.html", "http://x.org//a//b/", "http://x.org/a/b#c://d", "http://net/es/", "http://evilnet/es/1", "http://x.org/" + "deep/" * 30,
    "http://x.org/?q=://y/", "a://b://c/d",
]


def test_urls_of_every_case(spark):
    pages = spark.createDataFrame([*[(k, u, "h") for k, u in enumerate(URLS)], (0, None, "h"), (None, URLS[4], None)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad int")
    rows = urltree.judge_urls(pages, none, URL_RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[4] if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path) == brute_url(url)
        rule = brute_rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((rule[1], rule[0]) if rule else (None, "allow"))
    assert urltree.judge_urls(pages.limit(0), none, URL_RULES).count() == 0
    assert [r.template for r in rows if r.page_id == 14] == ["/" + "deep/" * 29 + "{deep}"]


def test_templates_generalise_merge_and_reject(spark):
    urls = [f"http://h.org/user/name{k}/photo/{k}" for k in range(60)] + [f"http://h.org/{s}/{k}.html" for s in ("good", "fine", "spam") for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = [(u, int("spam" in u)) for u in urls if ".html" in u] + [(urls[0], None)]
    rows = urltree.judge_urls(pages, spark.createDataFrame(marks, "url string, bad int"), []).collect()
    told = defaultdict(set)
    for r in rows:
        told[r.template].add(r.verdict)
    assert told == {"/user/*/{photo}/*": {"allow"}, "/{fine|good}/*.html": {"allow"}, "/{spam}/*.html": {"block"}}
    spam = next(r.purity for r in rows if "spam" in r.template)
    assert abs(spam - (40 + 8 * 41 / 122) / 48) < 1e-9


@pytest.mark.parametrize("siblings", [10, 60])
def test_a_section_is_judged_alike_among_few_siblings_and_many(spark, siblings):
    """A bad section with many labels, one with few, and pages of one visit each."""
    urls = [f"http://h.org/{s}/{k}.html" for s, n in (("spam", 200), ("junk", 8)) for k in range(n)]
    urls += [f"http://h.org/fine{s}/{k}.html" for s in range(siblings) for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = [(u, int("fine" not in u)) for u in urls]
    rows = urltree.judge_urls(pages, spark.createDataFrame(marks, "url string, bad int"), []).collect()
    assert {r.path.split("/")[1] for r in rows if r.verdict == "block"} == {"spam", "junk"}


def judged(spark, sections):
    """Verdict by section of pages in (section, pages, labelled, bad) lists."""
    urls, marks = [], []
    for section, n, told, bad in sections:
        own = [f"http://h.org/{section}/{k}" for k in range(n)]
        urls += own
        marks += [(u, int(k < bad)) for k, u in enumerate(own[:told])]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urltree.judge_urls(pages, spark.createDataFrame(marks, "url string, bad int"), []).collect()
    out = defaultdict(set)
    for r in rows:
        out[r.path.rsplit("/", 1)[0][1:]].add(r.verdict)
    assert all(len(v) == 1 for v in out.values())
    return {k: min(v) for k, v in out.items()}, {r.path.rsplit("/", 1)[0][1:]: r.template for r in rows}


def test_siblings_without_labels_bridge_nothing(spark):
    found, named = judged(spark, [("aaa", 500, 500, 0), ("bbb", 5, 0, 0), ("ccc", 500, 500, 500)])
    assert found == {"aaa": "allow", "bbb": "allow", "ccc": "block"}
    assert named == {"aaa": "/{aaa}/*", "bbb": "/{bbb}/*", "ccc": "/{ccc}/*"}
    assert judged(spark, [("a", 50, 50, 50), ("b", 5, 0, 0), ("c", 50, 50, 48)])[0]["b"] == "block"


def test_a_chain_of_few_labels_is_cut(spark):
    found, named = judged(spark, [("a", 3, 3, 0), ("b", 3, 3, 1), ("c", 3, 3, 2), ("d", 3, 3, 3)])
    assert found == {"a": "allow", "b": "allow", "c": "block", "d": "block"}
    assert named["a"] == named["b"] == "/{a|b}/*" and named["c"] == named["d"] == "/{c|d}/*"


@pytest.mark.parametrize("depth", [7, 12, 200])
def test_sections_at_any_depth(spark, depth):
    above = "/".join(f"s{k}" for k in range(depth))
    found, _ = judged(spark, [(f"{above}/good", 300, 300, 0), (f"{above}/bad", 300, 300, 300)])
    assert found == {f"{above}/good": "allow", f"{above}/bad": "block"}


def test_wide_nodes_above_one_another(spark):
    sections = [(f"u{k}/v{j}/{end}", 1, int((k + j) % 10 == 0), int(end == "spam")) for k in range(20) for j in range(20) for end in ("fine", "spam")]
    found, named = judged(spark, sections)
    assert {named[s[0]] for s in sections} == {"/*/*/{fine}/*", "/*/*/{spam}/*"}
    assert all((v == "block") == k.endswith("spam") for k, v in found.items())


def test_statement_has_the_rule_of_the_code(spark, tmp_path):
    """Wide nodes, supported and differing segments, unlabelled siblings, chains and deep paths in one table."""
    sections = [("wide/one", 40, 10), ("wide/two", 8, 8), ("wide/three", 6, 1), *[(f"wide/v{k}", 2, k % 2) for k in range(16)]]
    sections += [(f"many/v{k}/x{j}", 1, (k + j) % 3 == 0) for k in range(18) for j in range(18)]
    sections += [("x/a", 3, 0), ("x/b", 3, 1), ("x/c", 3, 2), ("x/d", 3, 3), ("x/none", 0, 0), ("/".join("abcdefghijklm") + "/good", 30, 0), ("/".join("abcdefghijklm") + "/bad", 30, 30)]
    urls, labels, at = [], [], 0
    for section, told, bad in sections:
        for k in range(max(told, 2)):
            urls.append((at, f"http://{'h' if at % 2 else 'H'}.org/{section}/{at}.html"))
            labels += [(at, int(k >= bad), 0)] if k < told else []
            at += 1
    urls += [(at, None), (at, "no"), (at, "x://h.org/wide/one/7"), (None, "x://h.org/wide/one/8")]
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels")
    for name in ("pages", "labels"):
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    rows = QUERIES["op3_url_templates"](spark, str(tmp_path))
    assert differences(connect(str(tmp_path)), ORACLE["op3_url_templates"], rows) is None
    assert {"/{wide}/*/*.html", "/wide/{one}/*.html", "/wide/{two}/*.html", "/x/{none}/*.html", "/{many}/*/*/*.html"} <= {r.template for r in rows.collect()}


def test_query_urls(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_url_templates"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        assert (r.host, r.path) == brute_url(urls[r.page_id])
        rule = brute_rule(r.host, r.path)
        assert r.rule == (rule and rule[1]) and (rule is None or r.verdict == rule[0])


# -- pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    (_, rules_), (_, dedup), (_, decontaminate), (_, redact), (_, pack) = corpus_pipeline.STAGES
    kept = rules_(spark, given, sf)
    judged = {r.doc_id for r in QUERIES["op10_boosted_rules"](spark, sf).filter("kept").collect()}
    assert kept.columns == given.columns and {r.doc_id for r in kept.collect()} == judged
    single = dedup(spark, kept, sf)
    named = {r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert single.columns == given.columns and sorted(r.doc_id for r in single.collect()) == sorted(named)
    clean = decontaminate(spark, single, sf)
    leaks = decontam.leak_digest(decontam.find_leaks(single, spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert clean.columns == given.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in leaks.filter("NOT contaminated").collect()}
    safe = redact(spark, clean, sf)
    before = {r.doc_id: r.text for r in clean.collect()}
    assert safe.columns == given.columns
    for r in safe.collect():
        assert (r.text == before[r.doc_id]) == (not secrets.find_spans(before[r.doc_id])) and r.n_chars == len(r.text)
        assert not secrets.base_spans(r.text)
    pieces = pack(spark, safe, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)
    whole = sorted(map(str, pieces.drop("sequence_id", "offset", "start", "length", "ids", "ids_crc32").distinct().collect()))
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.drop("sequence_id", "offset", "start", "length", "ids", "ids_crc32").distinct().collect())) == whole


def test_pipeline_takes_every_case(spark):
    docs = documents(spark)
    for name, apply in corpus_pipeline.STAGES[1:]:
        docs = apply(spark, docs, SF)
    assert docs.count() > 0
    docs = documents(spark, [])
    for name, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SF)
    assert docs.count() == 0
