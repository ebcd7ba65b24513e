"""Batches that stop and go on, commits, and recent items kept as a table."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from texelyard.operators import report
from texelyard.plans import resume
from texelyard.sources import commits
from texelyard.spec import JobSpec
from texelyard.streaming import recent

SIDE = 2


@pytest.fixture
def spec(tmp_path):
    return JobSpec(input_dir="in", output_dir=str(tmp_path / "out"), generate_mipmaps=False)


def batch(spark, n=12, broken=()):
    """Assets and 2x2 pixels; ids in ``broken`` did not load."""
    ids = spark.range(n).withColumnRenamed("id", "texture_id")
    lost = F.when(F.col("texture_id").isin(list(broken)), "Failed to load")
    assets = ids.select(
        "texture_id", F.concat(F.lit("in/t"), "texture_id", F.lit("_diff.png")).alias("path"), F.lit("RGBA8").alias("pixel_format"),
        F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(1).alias("mip_count"), lost.alias("load_error"),
    )
    spots = ids.crossJoin(spark.range(SIDE * SIDE).withColumnRenamed("id", "at"))
    value = (F.col("texture_id") * 4 + F.col("at")).cast("int")
    rows = spots.select(
        "texture_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(0).alias("mip"), (F.col("at") % SIDE).cast("int").alias("x"),
        F.floor(F.col("at") / SIDE).cast("int").alias("y"), value.alias("r"), value.alias("g"), value.alias("b"), F.lit(255).alias("a"),
    )
    return assets, rows


def reds(spark, spec):
    rows = resume.converted_pixels(spark, spec.output_dir).collect()
    return sorted((r.texture_id, r.x, r.y, r.r) for r in rows)


def all_reds(ids):
    return sorted((i, at % SIDE, at // SIDE, i * 4 + at) for i in ids for at in range(SIDE * SIDE))


def made(spark, spec):
    """Ids by attempt."""
    found = {}
    for r in resume.held_outputs(spark, spec.output_dir).collect():
        found.setdefault(r.attempt, []).append(r.texture_id)
    return found


def test_a_stopped_batch_writes_only_the_rest(spark, spec):
    assets, rows = batch(spark, broken=(3,))
    seen = []

    def stop(snapshot):
        seen.append(snapshot)
        if len(seen) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        resume.convert_shares(assets, rows, spec, shares=4, told=stop)
    first = made(spark, spec)
    early = sorted(i for ids in first.values() for i in ids)
    assert len(first) == 2 and 0 < len(early) < 11
    assert [(s.processed, s.done) for s in seen][0] == (1, False) and seen[-1].success == len(early)
    assert reds(spark, spec) == all_reds(early)

    again = []
    summary = resume.convert_shares(assets, rows, spec, shares=4, told=again.append).first()
    assert {k: v for k, v in made(spark, spec).items() if k in first} == first
    assert sorted(i for ids in made(spark, spec).values() for i in ids) == [i for i in range(12) if i != 3]
    assert reds(spark, spec) == all_reds(i for i in range(12) if i != 3)
    last = again[-1]
    assert (summary.total, summary.processed, summary.success, summary.fail, summary.done, summary.fraction) == (
        last.total, last.processed, last.success, last.fail, last.done, last.fraction) == (12, 12, 11, 1, True, 1.0)
    assert again[0].success == len(early) and not again[0].done and len(again) == 3

    once_more = []
    resume.convert_shares(assets, rows, spec, shares=7, told=once_more.append)
    assert [s.done for s in once_more] == [True] and len(made(spark, spec)) == len(first) + 2


def test_an_attempt_without_a_commit_is_never_read(spark, spec, monkeypatch):
    assets, rows = batch(spark, 5)

    def lost(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(resume, "publish_next", lost)
        with pytest.raises(OSError):
            resume.convert_shares(assets, rows, spec, shares=1)
    assert reds(spark, spec) == [] and resume.outputs(spark, spec.output_dir).isEmpty()
    resume.convert_shares(assets, rows, spec, shares=1)
    assert reds(spark, spec) == all_reds(range(5))


def test_shares_left_over_are_not_processed(spark, spec):
    assets, rows = batch(spark)
    summary = resume.convert_shares(assets, rows, spec, shares=4, at_most=1).first()
    assert 0 < summary.processed < 12 and not summary.done and summary.message is None


def test_outputs_of_another_batch_are_replaced_one_by_one(spark, spec):
    assets, rows = batch(spark, 6)
    resume.convert_shares(assets, rows, spec, shares=2)
    other, brighter = replace(spec, dds_format_general=1), rows.withColumn("r", F.col("r") + 100)
    kept = resume.convert_shares(assets, brighter, other, shares=2).first()
    assert (kept.success, kept.fail, kept.done) == (0, 6, True) and reds(spark, spec) == all_reds(range(6))
    plan = resume.settled_plan(assets, other)
    assert {r.message for r in resume.judge_outputs(plan, other).collect()} == {resume.KEPT}
    some = resume.convert_shares(assets, brighter, other, shares=2, replace=F.col("held_path").like("%t2%") | (F.col("texture_id") == 5)).first()
    assert (some.success, some.fail) == (2, 4)
    assert reds(spark, spec) == sorted((i, x, y, r + (100 if i in (2, 5) else 0)) for i, x, y, r in all_reds(range(6)))
    assert {r.target_format for r in resume.outputs(spark, spec.output_dir).filter("texture_id IN (2, 5)").collect()} == {"BC1"}
    assert resume.outputs(spark, spec.output_dir).count() == 6


def test_an_empty_batch_is_done(spark, spec):
    assets, rows = batch(spark, 0)
    seen = []
    summary = resume.convert_shares(assets, rows, spec, told=seen.append).first()
    assert (summary.total, summary.done) == (0, True) and seen == [resume.Snapshot(0, 0, 0, 0)] and seen[0].done


def test_options_decide_the_digest(spec):
    same = replace(spec, output_dir="elsewhere", formats=frozenset(sorted(spec.formats, reverse=True)))
    assert resume.options_digest(same) == resume.options_digest(spec) != resume.options_digest(replace(spec, jpeg_quality=1))


def test_a_number_is_given_once(spark, tmp_path):
    folder = str(tmp_path)
    assert commits.committed(spark, folder).isEmpty() and commits.last_number(spark, folder) == 0
    one, two, three = (commits.new_attempt() for _ in range(3))
    assert commits.publish(spark, folder, one, 1) and not commits.publish(spark, folder, two, 1)
    assert commits.publish(spark, folder, two, 2) and commits.publish_next(spark, folder, three) == 3
    assert {(r.number, r.attempt) for r in commits.committed(spark, folder).collect()} == {(1, one), (2, two), (3, three)}


def openings(seed, rows):
    rng, start = random.Random(seed), datetime(2026, 1, 1)
    user = lambda: rng.choice([1, 1, 1, 2, 3, None])
    return [(user(), rng.choice([None, *"abcdefghijklmnop"]), start + timedelta(seconds=rng.randrange(40))) for _ in range(rows)]


def shown(df):
    return sorted(((r.user_id, r.item, r.ts, r.position) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_merged_updates_equal_one_pass(spark, tmp_path, seed):
    schema = "user_id bigint, item string, ts timestamp"
    rows = openings(seed, 120)
    whole = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "recent")
    assert recent.read_recent(spark, folder).isEmpty()
    for part in (rows[80:], rows[:10], [], rows[5:85], rows[80:]):
        recent.update_recent(spark.createDataFrame(part, schema), folder, 4)
    assert shown(recent.read_recent(spark, folder)) == shown(report.recent_items(whole, 4))


def test_a_second_update_starts_from_the_first(spark, tmp_path, monkeypatch):
    schema = "user_id bigint, item string, ts timestamp"
    rows = openings(9, 60)
    folder = str(tmp_path / "recent")
    real, calls = recent.publish, []

    def overtaken(*args):
        calls.append(args)
        if len(calls) == 1:
            recent.update_recent(spark.createDataFrame(rows[:30], schema), folder)
        return real(*args)

    monkeypatch.setattr(recent, "publish", overtaken)
    assert recent.update_recent(spark.createDataFrame(rows[30:], schema), folder) == 2 and len(calls) == 3
    assert shown(recent.read_recent(spark, folder)) == shown(report.recent_items(spark.createDataFrame(rows, schema)))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "user_id bigint, item string, ts timestamp"
    rows = openings(4, 90)
    arriving, folder, checkpoint = (str(tmp_path / name) for name in ("arriving", "recent", "checkpoint"))
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        recent.keep_recent(stream, folder, checkpoint, 5, availableNow=True).awaitTermination()
    assert commits.last_number(spark, folder) == 3
    assert shown(recent.read_recent(spark, folder)) == shown(report.recent_items(spark.createDataFrame(rows, schema), 5))
