"""Archive, packed-file, companion and report operators on small edge tables."""

import random
import struct

from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.operators import assets, companions, packed, report
from texelyard.sources import archive


def blob(entries, magic=rules.PACKED_MAGIC, stored=None, cut=None):
    """A packed file of (id, size) entries; ``stored`` overrides ids in the data."""
    out = struct.pack("<II", magic, len(entries)) + b"".join(struct.pack("<iI", *e) for e in entries)
    for k, (ident, size) in enumerate(entries):
        out += bytes(-len(out) % 8) + bytes(8)
        out += (struct.pack("<i", (stored or {}).get(k, ident)) + bytes(size))[:size]
    return bytearray(out[:cut] if cut is not None else out)


def walk(data):
    """Index of one file, entry by entry."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != rules.PACKED_MAGIC:
        return []
    n = struct.unpack_from("<I", data, 4)[0]
    if 8 + 8 * n > len(data):
        return []
    at, found = 8 + 8 * n, []
    for k in range(n):
        ident, size = struct.unpack_from("<iI", data, 8 + 8 * k)
        at = (at + 7) // 8 * 8 + 8
        if at + size > len(data):
            break
        if struct.unpack_from("<i", data, at)[0] == ident:
            found.append((k, n, ident, size, at))
        at += size
    return found


def test_packed_index_edges(spark):
    rng = random.Random(3)
    files = {
        1: blob([(5, 8), (-7, 13), (9, 4)]),
        2: blob([(5, 8)], magic=7),
        3: bytearray(b"\xf5\x00\xcf"),
        4: blob([(1, 8), (2, 8)], cut=20),
        5: blob([(1, 9), (2, 17), (3, 6)], stored={1: 99}),
        6: blob([(1, 8), (2, 8)], cut=-1),
        7: blob([]),
        8: bytearray(b""),
        9: blob([(rng.randrange(-(2**31), 2**31), rng.randrange(4, 60)) for _ in range(500)]),
        10: blob([(2**31 - 1, 4), (-1, 5)]),
    }
    df = spark.createDataFrame(list(files.items()), "f bigint, blob binary")
    got = {}
    for r in packed.packed_index(df).collect():
        got.setdefault(r.f, []).append((r.i, r.n, r.sno, r.size, r.start))
    assert {f: sorted(rows) for f, rows in got.items()} == {f: w for f, d in files.items() if (w := walk(d))}


def test_offsets_with_one_dominant_file(spark):
    rng = random.Random(1)
    rows = [(1, i, 20000, rng.randrange(50), rng.randrange(1, 200)) for i in range(20000)]
    rows += [(f, 0, 1, f, 10) for f in range(2, 50)]
    df = spark.createDataFrame(rows, "f bigint, i bigint, n bigint, sno bigint, size int")
    index = packed.packed_offsets(df)
    got = {(r.f, r.i): r.start for r in index.collect()}
    run = 0
    for f, i, n, _, size in rows:
        run = run if f == 1 else 0
        assert got[f, i] == 8 + 8 * n + 8 * (i + 1) + run
        run += (size + 7) // 8 * 8
    last = {}
    for f, i, _, sno, size in rows:
        last[sno] = max(last.get(sno, (0, 0, 0)), (f, i, size))
    assert {r.sno: (r.f, r.i, r.size) for r in packed.last_writer(index).collect()} == last


def test_slices_carry_the_header(spark):
    blobs = spark.createDataFrame([(1, blob([(5, 8), (6, 12)]))], "f bigint, blob binary")
    index = packed.packed_index(blobs)
    got = {r.sno: bytes(r.data) for r in archive.packed_slices(blobs, index, 0xDEADBEEF, F.lit(77)).collect()}
    head = struct.pack("<IIII", 0xDEADBEEF, 77, 0, 0)
    assert got == {5: head + struct.pack("<i", 5) + bytes(4), 6: head + struct.pack("<i", 6) + bytes(8)}


def test_packed_file_names(spark):
    names = {
        "base:Texture-Base-enUS.dat": True,
        "base\\Texture-a-b-c.dat": True,
        "Texture-a.dat": False,
        "Texture-a-0xBEEF.dat": False,
        "Texture-a-0x.dat": True,
        "Material-a-b.dat": False,
        "x-y/Texture-a-b.dat": True,
        "Texture-a-b.bin": False,
        "Texture-a-b.0x1.dat": True,
    }
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r[0] for r in archive.packed_files(df).collect()} == {n for n, keep in names.items() if keep}


def test_listing_and_toc_are_sorted(spark):
    listing = spark.createDataFrame([(p,) for p in ["b.DDS", "a/x.tex", "dir.png/file", "c", "B.blp"]], "path string")
    assert [r[0] for r in archive.supported_listing(listing).collect()] == ["B.blp", "a/x.tex", "b.DDS"]
    toc = spark.createDataFrame(
        [("b", "Texture", 2), ("a", "Texture", 1), (" \t", "Texture", 3), ("é", "Texture", 4), ("c", "Sound", 5)],
        "name string, group_name string, sno int",
    )
    assert [r[0] for r in archive.toc_textures(toc).collect()] == ["a", "b"]


def test_companions(spark):
    listed = ["payload/a.tex", "paylow/a.tex", "payload/b.tex", "paylow/c.tex", "payload/b.tex"]
    meta = ["meta/a.tex", "meta/b.tex", "meta/c.tex", "meta/d.tex", "none/a.tex"]
    got = companions.resolve_companions(
        spark.createDataFrame([(m,) for m in meta], "path string"),
        spark.createDataFrame([(p,) for p in listed], "path string"),
    ).collect()
    assert sorted((r.path, r.companion, r.payload, r.paylow) for r in got) == [
        ("meta/a.tex", "both", "payload/a.tex", "paylow/a.tex"),
        ("meta/b.tex", "payload", "payload/b.tex", None),
        ("meta/c.tex", "paylow", "paylow/c.tex", None),
        ("meta/d.tex", "none", None, None),
        ("none/a.tex", "none", None, None),
    ]


def test_triplets_and_their_bytes(spark):
    magic = 0xDEADBEEF
    head = struct.pack("<IIII", magic, 0, 0, 0)
    files = {
        "Base\\meta\\Texture\\one.tex": b"M1",
        "base:meta\\1": b"unused",
        "base:meta\\2": b"M2",
        "base:meta\\5": b"",
        "base:payload\\1": head + b"P1",
        "base:payload\\2": b"P2",
        "base:payload\\3": b"P3",
        "base:payload\\4": b"",
        "base:payload\\5": b"P5",
        "base:payload\\6": b"P6",
        "base:paylow\\1": head + b"L1",
    }
    blobs = spark.createDataFrame(
        [(p, len(d), bytearray(d)) for p, d in files.items()], "path string, length bigint, data binary"
    )
    toc = spark.createDataFrame([(n, i) for i, n in enumerate(["one", "two", "three", "four", "five", "six"], 1)], "name string, sno int")
    index = spark.createDataFrame([(3, 9, 0, 40, 2)], "sno int, f bigint, i bigint, start bigint, size int")
    slices = spark.createDataFrame([(3, bytearray(head + b"M3"))], "sno int, data binary")
    found = companions.resolve_triplet(toc, blobs.drop("data"), index)
    assert {r.sno: r.meta_source for r in found.collect()} == {1: "name", 2: "id", 3: "packed"}
    full = companions.attach_bytes(found, blobs, slices, magic).collect()
    assert {r.sno: tuple(None if c is None else bytes(c) for c in r[2:]) for r in full} == {
        1: (b"M1", b"P1", b"L1"),
        2: (b"M2", b"P2", None),
        3: (head + b"M3", b"P3", None),
    }
    assert {r.sno for r in companions.unavailable(toc, found).collect()} == {4, 5, 6}


def test_hash_defaults_to_zero(spark):
    slices = spark.createDataFrame([(1,)], "sno int")
    hashes = spark.createDataFrame([("Sound", 5)], "group_name string, format_hash int")
    assert companions.attach_hash(slices, hashes).first().format_hash == 0


def insert_all(paths, entries=(), folder=rules.VIRTUAL_FOLDER):
    """Tree nodes by inserting sorted paths one by one."""
    nodes = {}
    for path in sorted(paths, key=lambda p: p.encode()):
        start, at = 0, ()
        while start < len(path):
            stops = [i for i in (path.find("/", start), path.find("\\", start)) if i >= 0]
            stop = min(stops, default=len(path))
            at = (*at, path[start:stop])
            nodes.setdefault(at, stop >= len(path))
            start = stop + 1
    if entries:
        nodes.setdefault((folder,), False)
        nodes |= {(folder, f"{e}.tex"): True for e in entries}
    return {("/".join(k), len(k), leaf) for k, leaf in nodes.items()}


def test_tree(spark):
    paths = ["a/b/c.png", "a\\b", "a/d", "a/d/e.png", "/x.png", "//y", "z/", "\\", "p//q", "Diablo IV Textures/r.png", "solo"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    toc = spark.createDataFrame([("t1", 4), ("t2", 5)], "name string, sno int")
    got = {(r.node_path, r.depth, r.is_file) for r in report.tree_nodes(df, toc).collect()}
    assert got == insert_all(paths, ["t1", "t2"])
    alone = report.tree_nodes(df).collect()
    assert {(r.node_path, r.depth, r.is_file) for r in alone} == insert_all(paths)
    for r in alone:
        if r.depth > 1:
            assert r.node_path == f"{r.parent_path}/{r.name}"


def test_search_is_ascii_case_insensitive(spark):
    df = spark.createDataFrame([("a/Stone.png",), ("É.png",), ("é.png",)], "path string")
    assert [r[0] for r in assets.search(df, "STONE").collect()] == ["a/Stone.png"]
    assert [r[0] for r in assets.search(df, "É").collect()] == ["É.png"]
    assert assets.search(df, "").count() == 3


def test_recent_items_for_a_dominant_user(spark):
    events = spark.range(20000).selectExpr(
        "if(id % 3 < 2, 1L, id % 50) AS user_id", "concat('i', id % 700) AS item", "timestamp_seconds(id) AS ts"
    )
    got = {}
    for r in report.recent_items(events).collect():
        got.setdefault(r.user_id, {})[r.position] = r.item
    newest = {}
    for r in sorted(events.collect(), key=lambda r: r.ts):
        seen = newest.setdefault(r.user_id, [])
        if r.item in seen:
            seen.remove(r.item)
        seen.insert(0, r.item)
        del seen[10:]
    assert {u: [got[u][k] for k in sorted(got[u])] for u in got} == newest


def test_recent_items_trims_before_the_shuffle(spark):
    events = spark.range(99).selectExpr("id % 3 AS user_id", "concat('i', id % 7) AS item", "timestamp_seconds(id) AS ts")
    plan = report.recent_items(events)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_summary_of_an_empty_batch(spark):
    row = report.batch_summary(spark.createDataFrame([], "success boolean")).first()
    assert (row.total, row.fraction, row.done) == (0, 0.0, True)


def test_issue_report_keeps_order(spark):
    df = spark.createDataFrame([("m", ["b", "a"]), ("n", [])], "message string, issues array<string>")
    assert [r.message for r in report.issue_report(df).collect()] == ["m\n  b\n  a", "n"]


def test_running_sum_keeps_rows_without_a_group(spark):
    from texelyard.operators.running import blocked_running_sum

    df = spark.createDataFrame([(None, k, 1) for k in range(5)] + [(1, k, 2) for k in range(3)], "g int, o int, v int")
    got = blocked_running_sum(df, "g", F.col("o") % 1 + F.shiftright("o", 1), ["o"], F.col("v"), "before", "total").collect()
    assert sorted((r.g or 0, r.o, r.before, r.total) for r in got) == [
        *[(0, k, k, 5) for k in range(5)], *[(1, k, 2 * k, 6) for k in range(3)],
    ]


def test_running_sums_get_tasks_by_rows(spark, monkeypatch):
    """Tasks sized by shuffled bytes took 833 MB each on 36 million rows; the session has 8 here."""
    from texelyard.operators import running

    monkeypatch.setattr(running, "ROWS_A_TASK", 100)
    df = spark.range(2_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    got = running.blocked_running_sum(df, "g", F.shiftright("o", 4), ["o"], F.col("v"), "before", "total")
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 400
    assert got.filter("before != o div 3 OR total < 666").isEmpty()
