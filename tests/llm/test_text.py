"""Decontamination, secrets and near copies against brute force."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import CASES, SF, WORD, documents, lower
from hypothesis import given, settings
from hypothesis import strategies as st
from texelyard.llm import components, decontam, secrets, simhash, vptree
from texelyard.llm.queries import QUERIES

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# -- decontamination -------------------------------------------------------------


def brute_leaks(text, items, window=10):
    words = ITEM_WORD.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        own = ITEM_WORD.findall(lower(item))
        for k in range(max(1, len(own) - window + 1) if own else 0):
            piece = own[k : k + window]
            for at in range(len(words) - len(piece) + 1):
                if words[at : at + len(piece)] == piece:
                    hit |= set(range(at, at + len(piece)))
                    found.add("" if name is None else str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


ITEMS = [
    (1, "Quick brown FOX"),
    (2, "the lazy dog the quick brown fox jumps over the lazy dog the quick"),
    (2, "the lazy dog the quick brown fox jumps over the lazy dog the quick"),
    (10, "wörter"),
    (3, None),
    (4, " ... "),
    (None, "dog the"),
]


def test_leaks_in_every_case(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted((str(d), *brute_leaks(t, ITEMS)) for d, t in CASES if len(t or "") < 10_000)
    docs = documents(spark, [c for c in CASES if len(c[1] or "") < 10_000])
    for block_bytes in (1 << 20, 80):  # one pass, several passes
        found = decontam.find_leaks(docs, bench, block_bytes=block_bytes)
        rows = decontam.leak_digest(found).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
        for r in found.collect():
            for span in r.chars:
                cut = r.row.text[span.start : span.end]
                assert ITEM_WORD.match(lower(cut)) and ITEM_WORD.match(lower(cut)[-1])
    clean = decontam.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not w[-1] for w in want)


def test_leaks_with_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leak_digest(decontam.find_leaks(documents(spark), bench)).filter("contaminated").count() == 0
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find_leaks(documents(spark, []), bench).count() == 0


def test_query_leaks(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = defaultdict(set)
    for name, text in items:
        own = ITEM_WORD.findall(lower(text))
        for k in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[k : k + 10])].add(str(name))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = ITEM_WORD.findall(lower(r.text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[at : at + size])):
                    hit |= set(range(at, at + size))
                    found |= owners
        want[r.doc_id] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    rows = QUERIES["op2_aho_decontamination"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
    assert any(w[-1] for w in want.values())


# -- secrets -----------------------------------------------------------------------

NAMED = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({NAMED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "api_key", "APIKEY", "ſecret", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJ012345", "deadbeef", "0123456789abcdef", "é", "\n", ";", "+", "x.y_z-", "bearer "]), max_size=14))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    spans = secrets.find_spans(text)
    assert [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind != "lexed"] == brute_secrets(text)
    assert [(s.start, secrets.KINDS.index(s.kind)) for s in spans] == sorted((s.start, secrets.KINDS.index(s.kind)) for s in spans)
    secrets.redacted(text, spans)


def lexed(text):
    return [text[s.start : s.end] for s in secrets.find_spans(text) if s.kind == "lexed"]


def test_lexer_follows_names_and_constants():
    assert lexed('DB_KEY = "aB3dE6gH9kL2mN5p"\npassword = DB_KEY') == ["aB3dE6gH9kL2mN5p"]
    assert lexed('const authToken: string = "ey9aK" + "32kdLs83jf";') == ["ey9aK", "32kdLs83jf"]
    assert lexed("private_key: 'Zx81-kQ_77!pLm?'") == ["Zx81-kQ_77!pLm?"]
    assert lexed("Authorization: Bearer abcDEF123456ghi") == ["abcDEF123456ghi"]
    assert lexed('db_pwd := "q8#Lm2$Rt9!"') == ["q8#Lm2$Rt9!"]
    for harmless in ('password = "changeme"', "the token: then we go", "url: http://a.b/token", 'colour = "aB3dE6gH9kL2mN5p"', "pwd == q8Lm2Rt9xx", 'secret = "${FROM_ENV}"'):
        assert lexed(harmless) == [], harmless


@pytest.mark.parametrize("use", ["$KEY", "${KEY}", '"$KEY"', '"${KEY}"', "'${KEY}'"])
def test_lexer_follows_references(use):
    assert lexed(f"KEY=aB3dE6gH9kL2mN5p\npassword={use}\n") == ["aB3dE6gH9kL2mN5p"]
    assert lexed(f"OTHER=aB3dE6gH9kL2mN5p\npassword={use}\n") == []


def plain_lexed(text):
    """Lexed spans with every value written out, part by part."""
    constants, found, done, floor = {}, set(), 0, 0
    for m in secrets.OPERATOR.finditer(text):
        if m.group() in ("==", "!=", "<=", ">=") or m.start() < done:
            continue
        name = secrets._name_before(text, m.start(), floor)
        if name is None:
            continue
        at = m.end()
        typed = re.compile(r" *[A-Za-z_][A-Za-z0-9_.\[\]<>]* *=(?![=>])").match(text, at) if m.group() == ":" else None
        at = typed.end() if typed else at
        spans, at, word = plain_value(text, at, constants)
        if spans is None:
            continue
        constants[name] = spans
        told = [(name, spans)]
        if text.startswith("//", m.end()):
            told += [(q[1], [q.span(2)]) for q in secrets.IN_ADDRESS.finditer(text, m.end(), at)]
        found |= {s for n, v in told if secrets.is_sensitive(n) and plain_score(text, v) >= 3 for s in v if s[1] > s[0]}
        done, floor = max(done, m.end() if word else at), m.end() if word else at
    return found


def plain_value(text, at, constants):
    at += len(text[at:]) - len(text[at:].lstrip(" \t"))
    at += len(re.match(r"(?:[Bb](?:earer|asic) +)?", text[at:])[0])
    out, count, word = [], 0, False
    while True:
        string = re.match(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'', text[at:])
        refs = None if string else secrets.BARE_REFERENCES.match(text, at)
        bare = None if string else secrets.BARE.match(text, at)
        if string:
            start, end = at + 1, at + string.end() - 1
            out += plain_parts(text, start, end, constants) or [(start, end)]
            word, at = False, at + string.end()
        elif refs and (parts := plain_parts(text, *refs.span(), constants)):
            out += parts
            word, at = False, refs.end()
        elif bare:
            known = constants.get(bare[0].removeprefix("$").rstrip("."))
            out += known or [bare.span()]
            word, at = re.fullmatch(r"\$?[A-Za-z_][A-Za-z0-9_.-]*", bare[0]) is not None, bare.end()
        else:
            break
        count += 1
        plus = re.match(r" *\+ *", text[at:])
        if not plus:
            break
        word, at = False, at + plus.end()
    return (out if count else None), at, word and count == 1


def plain_parts(text, start, end, constants):
    out, done, hit = [], start, False
    for m in re.finditer(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))", text[start:end]):
        known = constants.get(m[1] or m[2])
        if known is None:
            continue
        out += ([(done, start + m.start())] if start + m.start() > done else []) + known
        done, hit = start + m.end(), True
    return (out + ([(done, end)] if end > done else [])) if hit else None


def plain_score(text, spans):
    value = "".join(text[a:b].strip() for a, b in spans)
    low = value.lower()
    if len(value) < 8 or low in secrets.PLACEHOLDERS or low.startswith(secrets.BEGINNINGS):
        return 0
    times = Counter(value.encode()).values()
    bits = -sum(n / sum(times) * math.log2(n / sum(times)) for n in times) + 1e-6
    kinds = sum(any(map(f, value)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    mixed = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
    return (bits >= 2.5) + (bits >= 3.5) + (kinds >= 2) + mixed + (len(value) >= 16) - 2 * (" " in value)


CODE = ["a", "b", "KEY", "password", "api_key", "token", " ", " ", "=", " = ", ": ", ":", "=>", "==", " + ", "+", '"', "'", "${a}", "$b", "${KEY}", "xY12kLmn", "aB3dE6gH9kL2",
        "changeme", "Bearer ", "http://h/p?", "//", "&", "\n", "\n", "\\", "str = ", "é", "(", ";", " two words 12 "]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(CODE), max_size=40))
def test_lexer_against_values_written_out(parts):
    text = "".join(parts)
    base = [(s.start, s.end) for s in secrets.base_spans(text)]
    want = {s for s in plain_lexed(text) if not any(a <= s[0] and s[1] <= b for a, b in base)}
    assert {(s.start, s.end) for s in secrets.find_spans(text) if s.kind == "lexed"} == want


@pytest.mark.parametrize("text,found", [
    ('a = "abcdefgh1234"\n' + "a = a + a\n" * 40 + "password = a", ["abcdefgh1234"]),
    ('a = "abcdefgh1234"\n' + "a = a + a\n" * 20_000 + "password = a", ["abcdefgh1234"]),
    ("".join(f'a = a + "k{k}"\n' for k in range(20_000)) + "password = a", None),
    ("key " + "a://" * 250_000, []),
    ("key " + "a=//" * 250_000, []),
    ("key " + "password=" * 100_000, None),
    ("key " + "a:b=" * 200_000, None),
    ("key = " + '"x" + ' * 150_000 + '"y"', None),
    ("api_key = A\n" * 60_000, []),
])
def test_lexer_is_bounded(text, found):
    begun = time.process_time()
    spans = secrets.find_spans(text)
    assert time.process_time() - begun < 6
    if found is not None:
        assert [text[s.start : s.end] for s in spans if s.kind == "lexed"] == found


@pytest.mark.parametrize("use", ['password="${A}"', "password=A", "password=$A", "password=${A}"])
def test_long_constants_are_found(use):
    literal = "aB3dE6gH9k" * 9_000
    text = f'A="{literal}"\n{use}'
    assert [text[s.start : s.end] for s in secrets.find_spans(text) if s.kind == "lexed"] == [literal]


@pytest.mark.parametrize("text,found", [
    ("see https://h/x?user=me&password=Zx81kQ02mmPq&y=1", "Zx81kQ02mmPq"),
    ("a = password2 = 'Zx81kQ02mmPq'", "Zx81kQ02mmPq"),
])
def test_names_inside_other_values(text, found):
    assert found in [text[s.value : s.end] for s in secrets.find_spans(text)]


def test_secrets_in_every_case(spark):
    docs = documents(spark)
    rows = secrets.secret_digest(secrets.scan_secrets(docs)).collect()
    want = sorted((str(d), hashlib.sha256(",".join(brute_secrets(t)).encode()).hexdigest()) for d, t in CASES)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    clean = secrets.without_secrets(docs)
    assert clean.schema.simpleString() == docs.schema.simpleString()
    got = {r.doc_id: r for r in clean.filter("doc_id = 9 OR doc_id = 6").collect()}
    assert got[9].text == "password = '[REDACTED]'\n[REDACTED] [REDACTED]" and got[9].n_chars == len(got[9].text)
    assert got[6].text == "one" and got[6].n_chars is None
    assert secrets.without_secrets(documents(spark, [])).count() == 0


def test_query_secrets(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_assignment_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(","))
    assert any(r.spans for r in rows)


# -- near copies -------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=2):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    own = np.array(points, np.uint64)
    for i in range(len(own)):
        for j in (np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= radius) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(own))]


def test_fingerprints_equal_brute_force(spark):
    texts = [t for _, t in CASES] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for text in texts:
        if len(text or "") < 5_000:
            assert simhash.fingerprint(text) == brute_fingerprint(text)
    grams = simhash.CHUNK
    simhash.CHUNK = 7
    try:
        assert all(simhash.fingerprint(t) == brute_fingerprint(t) for t in texts if len(t or "") < 2_000)
    finally:
        simhash.CHUNK = grams


def points_with_clusters(rng, n):
    base = rng.integers(0, 2**63, n // 2, dtype=np.int64).astype(np.uint64)
    near = base.copy()
    for _ in range(2):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    middle = np.uint64(rng.integers(0, 2**63))
    ball = np.array([int(middle) ^ sum(1 << int(b) for b in rng.choice(64, 3, False)) for _ in range(n // 4)], np.uint64)
    return np.unique(np.concatenate([base, near, ball, np.array([0, 3, 2**64 - 1], np.uint64)]))


def test_tree_joins_exactly_what_brute_force_joins():
    points = points_with_clusters(np.random.default_rng(3), 2_400)
    tree = vptree.build(points[::4], 40, 2)
    rows, leaves = tree.shards(points, 2)
    assert tree.leaves > 8 and set(rows.tolist()) == set(range(len(points)))
    assert len(rows) < 4 * len(points)
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for leaf in range(tree.leaves):
        for u, v in zip(*map(np.ndarray.tolist, vptree.links(points[rows[leaves == leaf]], 2))):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    want = brute_components(points.tolist())
    assert [find(int(p)) for p in points] == [int(points[k]) for k in want]


def test_points_that_no_vantage_point_parts():
    points = np.array([1 << b for b in range(64)] + [(1 << a) | (1 << b) for a in range(64) for b in range(a)], np.uint64)
    u, v = vptree.links(points, 2)
    assert len(set(u.tolist()) | set(v.tolist())) == len(points)


def test_components_of_stars_and_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 90)] + [(200, 200), (300, 301), (301, 300), (301, 302)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(90)}, 300: 300, 301: 300, 302: 300}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_in_every_case(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) if len(t or "") < 10_000 else simhash.fingerprint(t) for _, t in CASES]
    roots = brute_components(prints)
    least = {}
    for (d, _), root in zip(CASES, roots):
        least[root] = d if least.get(root) is None else least[root] if d is None else min(d, least[root])
    want = sorted((str(d), f"{p:016x}", str(least[root])) for (d, _), p, root in zip(CASES, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    kept = simhash.one_per_group(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, least.values()))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_per_group(documents(spark, [])).count() == 0


def test_query_near_duplicates(spark):
    docs = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in QUERIES["op5_vp_tree_simhash"](spark, "/root/testdata/sf0.01").collect()}
    roots = brute_components([int(rows[r.doc_id].fingerprint, 16) for r in docs])
    assert [rows[r.doc_id].component_id for r in docs] == [docs[k].doc_id for k in roots]
    assert len(set(roots)) < len(roots)
