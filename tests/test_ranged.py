"""Packed files by byte ranges, and the filter that keeps unwanted bytes where they are."""

import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import differences
from pyspark.sql import functions as F

from texelyard import fixtures as fx
from texelyard.catalog import QUERIES
from texelyard.functions import rules
from texelyard.operators import companions, packed
from texelyard.operators.bloom import might_contain
from texelyard.oracle import ORACLE
from texelyard.sources import files, ranged


def blob(entries, magic=rules.PACKED_MAGIC, count=None):
    """A packed file of (id, stored id, bytes after the id)."""
    index = b"".join(struct.pack("<iI", sno, 4 + len(rest)) for sno, _, rest in entries)
    body = b"".join(bytes(8) + (struct.pack("<i", stored) + rest).ljust((4 + len(rest) + 7) // 8 * 8, b"\0") for _, stored, rest in entries)
    return struct.pack("<II", magic, len(entries) if count is None else count) + index + body


BLOBS = {
    "a.dat": blob([(1, 1, b"one"), (-2, -2, b"two" * 9), (3, 4, b"mismatch"), (5, 5, b"")]),
    "b.dat": blob([(1, 1, b"later"), (7, 7, bytes(40))]),
    "magic.dat": blob([(9, 9, b"x")], magic=1),
    "short.dat": blob([(10, 10, b"abcd")])[:-1],
    "over.dat": blob([(11, 11, b"abcd")], count=99),
    "tiny.dat": b"1234",
    "none.dat": blob([]),
    "empty.dat": b"",
}


@pytest.fixture
def folder(tmp_path):
    for name, data in BLOBS.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_ranged_index_equals_the_index_of_values(spark, folder):
    found = ranged.ranged_index(files.scan_assets(spark, str(folder)))
    values = spark.createDataFrame([(f"file:{folder}/{k}", bytearray(v)) for k, v in BLOBS.items()], "f string, blob binary")
    columns = ["f", "i", "n", "sno", "size", "start"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, packed.packed_index(values).select(columns).collect()))
    slices = {r.sno: bytes(r.data)[16:] for r in ranged.ranged_slices(found, 1, 2).collect()}
    assert slices[1] == struct.pack("<i", 1) + b"later" and slices[-2][4:] == b"two" * 9 and 3 not in slices and 10 not in slices


def test_an_id_that_is_cut_short_is_no_entry(spark, tmp_path):
    whole = struct.pack("<IIiI", rules.PACKED_MAGIC, 1, 27, 3) + bytes(8) + struct.pack("<i", 27)
    for name, data in (("whole.dat", whole), ("cut.dat", whole[:-1])):
        (tmp_path / name).write_bytes(data)
    index = ranged.ranged_index(files.scan_assets(spark, str(tmp_path))).collect()
    assert [(r.f.rsplit("/", 1)[1], r.sno, r.size) for r in index] == [("whole.dat", 27, 3)]


@pytest.mark.parametrize("query", ["ranged_slices", "triplet_bytes"])
def test_a_last_entry_shorter_than_its_id(spark, tmp_path, query):
    """Line quantity 1 makes an entry of 3 bytes; as the last of its file it was written without the end of its id."""
    lines = [(1, 1, 1, 27, 5), (1, 1, 2, 27, 1), (2, 2, 1, 39, 1)]
    frame = spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity int")
    frame = frame.withColumns({"l_extendedprice": F.lit(1.0), "l_shipdate": F.lit("1995-01-01").cast("date")})
    frame.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.createDataFrame([(27, "blue tin", 3), (39, "red tin", 4)], "p_partkey long, p_name string, p_size int")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    rows = QUERIES[query](spark, str(tmp_path))
    assert rows.count() == 2 and differences(con, ORACLE[query], rows) is None


@pytest.mark.parametrize("query", ["ranged_slices", "triplet_bytes"])
def test_the_latest_file_has_the_largest_number(spark, tmp_path, query):
    """Both files hold part 27; a name of eleven digits came before one of ten."""
    lines = [(9_000_000_001, 1, 1, 27, 5), (10_000_000_001, 2, 1, 27, 6)]
    frame = spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity int")
    frame = frame.withColumns({"l_extendedprice": F.lit(1.0), "l_shipdate": F.lit("1995-01-01").cast("date")})
    frame.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(27, "blue tin", 3)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    rows = QUERIES[query](spark, str(tmp_path))
    assert rows.count() == 1 and differences(con, ORACLE[query], rows) is None


def test_the_bytes_of_large_ids(spark, tmp_path):
    """257 times such an id is more than an INT, but the id itself is not."""
    lines = spark.createDataFrame([(1, 1, 1, 9_000_003, 5.0)], "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    lines = lines.withColumns({"l_extendedprice": F.lit(1.0), "l_shipdate": F.lit("1995-01-01").cast("date")})
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.createDataFrame([(9_000_003, "red tin", 3), (9_000_006, "blue tin", 4), (9_000_009, "tin", 5)], "p_partkey long, p_name string, p_size int")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = {r.sno: (r.data, r.payload_data, r.paylow_data) for r in QUERIES["triplet_bytes"](spark, str(tmp_path)).collect()}
    packed_meta = struct.pack("<IIIIi", fx.HEADER_MAGIC, 77, 0, 0, 9_000_003) + b"\xab" * 11
    fill = {sno: (bytes([sno % 256]) * length).hex().upper() for sno, length in ((9_000_003, 4), (9_000_006, 5), (9_000_009, 6))}
    assert found == {sno: (packed_meta.hex().upper() if sno == 9_000_003 else f, f, f) for sno, f in fill.items()}


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file: its second entry lies behind 3 GB that nobody asks for."""
    big = 3 << 30
    path = tmp_path / "big.dat"
    with open(path, "wb") as out:
        out.write(struct.pack("<II", rules.PACKED_MAGIC, 2) + struct.pack("<iIiI", 21, big, 22, 8) + bytes(8) + struct.pack("<i", 99))
        out.seek(8 + 16 + 8 + big + 8)
        out.write(struct.pack("<i", 22) + b"last")
    index = ranged.ranged_index(files.scan_assets(spark, str(tmp_path)))
    assert [(r.sno, r.start) for r in index.collect()] == [(22, 8 + 16 + 8 + big + 8)]
    assert [bytes(r.data)[16:] for r in ranged.ranged_slices(index, 1, 2).collect()] == [struct.pack("<i", 22) + b"last"]


def test_index_parts_become_rows_few_at_a_time():
    """A batch of parts has millions of entries; all at once, with a path each, took over a gigabyte."""
    sizes = [4_096] * 40 + [1, ranged.INDEX_ENTRIES, 3]
    words = [np.stack([np.arange(n) + 1_000_000 * k, np.full(n, k)], 1).astype("<u4").tobytes() for k, n in enumerate(sizes)]
    columns = {"path": [f"file:/p{k}" for k in range(len(sizes))], "n": [n + 70_000 for n in sizes], "first": [70_000] * len(sizes), "data": words}
    found = list(ranged._entries(iter([pa.RecordBatch.from_pydict(columns)])))
    assert max(b.num_rows for b in found) <= ranged.INDEX_ENTRIES
    rows = pa.Table.from_batches(found).to_pydict()
    part = np.repeat(np.arange(len(sizes)), sizes)
    at = np.concatenate([np.arange(n) for n in sizes])
    assert rows["f"] == [f"file:/p{k}" for k in part] and rows["i"] == (70_000 + at).tolist() and rows["n"] == (np.array(sizes)[part] + 70_000).tolist()
    assert rows["sno"] == (at + 1_000_000 * part).tolist() and rows["size"] == part.tolist()


def test_only_wanted_bytes_are_read(folder, monkeypatch):
    import pyarrow.fs as pafs

    read = []

    class Spy:
        def __init__(self, source):
            self.source = source

        def read_at(self, size, start):
            read.append(size)
            return self.source.read_at(size, start)

        def __getattr__(self, name):
            return getattr(self.source, name)

    class System:
        def open_input_file(self, place):
            return Spy(pafs.LocalFileSystem().open_input_file(place))

    monkeypatch.setattr(pafs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda path: (System(), path.removeprefix("file:")))}))
    rows = [(f"file:{folder}/a.dat", 0, 8), (f"file:{folder}/a.dat", 48, 5), (f"file:{folder}/b.dat", 8, 16), ("file:/gone", 0, 9), (f"file:{folder}/b.dat", 9_999, 3)]
    batch = pa.RecordBatch.from_pydict(dict(zip(("path", "start", "size"), map(list, zip(*rows)))))
    found = [r for b in ranged._reader(["path", "start", "size"], ["path", "start", "size", "data"])(iter([batch])) for r in b.to_pylist()]
    assert [len(r["data"]) if r["data"] is not None else None for r in found] == [8, 5, 16, None, 0]
    assert sum(read) == 8 + 5 + 16


def test_filter_keeps_every_wanted_key(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("k"))
    wanted = keys.filter(F.col("k").endswith("7"))
    passed = keys.filter(might_contain(wanted, F.col("k"), 2_000))
    assert wanted.join(passed, "k", "left_anti").count() == 0
    assert 2_000 <= passed.count() < 2_000 + 18_000 * 0.03
    assert keys.filter(might_contain(wanted.limit(0), F.col("k"), 0)).count() == 0
    assert keys.filter(might_contain(wanted, F.lit(None).cast("string"), 2_000)).count() in (0, 20_000)


def test_unwanted_contents_are_dropped_before_the_exchange(spark):
    blobs = spark.range(5_000).select(F.concat(F.lit("base:payload\\"), "id").alias("path"), F.lit(b"x" * 100).alias("data"))
    triplets = spark.range(10).select(
        F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("int").alias("sno"), F.lit("id").alias("meta_source"), F.lit(None).cast("string").alias("meta"),
        F.concat(F.lit("base:payload\\"), "id").alias("payload"), F.lit(None).cast("string").alias("paylow"),
    )
    slices = spark.createDataFrame([], "sno int, data binary")
    plan = companions.attach_bytes(triplets, blobs, slices, 7)._jdf.queryExecution().optimizedPlan().toString()
    contents = next(line for line in plan.splitlines() if "Filter" in line and "xxhash64" in line)
    assert "scalar-subquery" in contents or "ScalarSubquery" in contents or "get(" in contents
    names = triplets.select(F.col("payload").alias("path"))
    assert blobs.filter(might_contain(names, F.col("path"), 10)).count() < 150
